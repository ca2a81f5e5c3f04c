"""The corpus pipeline, stage by stage, against plain Python with the same trained model."""

import math
import re
from collections import Counter, defaultdict
from hashlib import md5

import corpus_pipeline
import pyarrow as pa
from conftest import COLUMNS, prose
from test_llm_text import brute_classes, plain_local_alignment

from shredkit.llm import decontaminate, shard, toxicity


def documents():
    """(doc_id, text, lang, source, n_chars) with cases for every stage."""
    item = prose(900, 30)
    texts = [(i, prose(i, 60)) for i in range(40)]
    texts += [(40 + i, f"{prose(40 + i, 30)} you vile idiot {prose(70 + i, 20)} filthy scum") for i in range(30)]
    texts += [(70 + i, prose(i, 60) + " end") for i in range(6)] + [(76, prose(7, 60)), (77, prose(7, 60))]
    texts += [(80 + i, f"{prose(180 + i, 40)} {item} {prose(280 + i, 10)}") for i in range(5)]
    texts += [(90, None), (91, ""), (None, prose(500, 20)), (92, prose(501, 9))]
    rows = [(d, t, "en", "c" if d == 92 else "ab"[(d or 0) % 2], len(t or "")) for d, t in texts]
    return rows, [(1, item), (2, prose(901, 20))]


def poisson_copies(name, rate):
    parts = max(1, math.ceil(rate / 16))
    mean, n = rate / parts, 0
    for i in range(1, parts + 1):
        u = (int(md5(f"17|{name}|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        p = c = math.exp(-mean)
        for k in range(1, 98):
            if c >= u:
                break
            n, p = n + 1, p * mean / k
            c += p
    return n


def plain_stages(rows, bench, model):
    scores = toxicity.score_texts(model, pa.array([r[1] for r in rows], pa.string()))
    rows = [r for r, s in zip(rows, scores, strict=True) if s < 0.3]
    yield rows
    classes = brute_classes([(r[0], r[1]) for r in rows])
    rows = [r for r in rows if r[0] is None or classes[r[0]] == r[0]]
    yield rows
    fold = lambda t: re.sub(r"[\x00-/:-@\[-`{-\x7f]+", " ", t or "").lower().split()
    least = decontaminate.THRESHOLD * 2
    rows = [r for r in rows if r[0] is None or all(
        plain_local_alignment(fold(t), fold(r[1])) < least * len(fold(t)) for _, t in bench)]
    yield rows
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len((r[1] or "").encode())
    rate = {s: sum(size.values()) / len(size) / n if n else 1.0 for s, n in size.items()}
    who = lambda r: "#" + md5((r[1] or "").encode()).hexdigest() if r[0] is None else r[0]
    rows = [r for r in rows for _ in range(poisson_copies(who(r), rate[r[3]]))]
    yield rows
    units, groups = defaultdict(list), defaultdict(int)
    for r in rows:
        groups[md5((r[1] or "").encode()).hexdigest()[:15]] += len((r[1] or "").encode()) + 1
    total = sum(groups.values())
    for r in rows:
        h = md5((r[1] or "").encode()).hexdigest()[:15]
        heavy = groups[h] > 0.01 * total / 8
        units[(heavy, h, (shard.NO_ID if r[0] is None else r[0]) if heavy else 0)].append(r)
    out, before, slots = [], 0, Counter()
    for key in sorted(units):
        unit = sorted(units[key], key=lambda r: shard.NO_ID if r[0] is None else r[0])
        n = sum(len((r[1] or "").encode()) + 1 for r in unit)
        place = 8 * (2 * before + n) // (2 * total)
        for r in unit:
            out.append((*r, len((r[1] or "").encode()) + 1, place, slots[place]))
            slots[place] += 1
        before += n
    yield out


def test_pipeline_matches_plain_stages(spark, tmp_path, monkeypatch):
    rows, bench = documents()
    labels = [(r[0], 1, int("vile" in (r[1] or ""))) for r in rows if r[0] is not None and r[0] < 70]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen, models, keep, train = [], [], corpus_pipeline.saved, toxicity.train

    def trained(*args):
        models.append(train(*args))
        return models[-1]

    def kept(df, name):
        seen.append(keep(df, name))
        return seen[-1]

    monkeypatch.setattr(toxicity, "train", trained)
    monkeypatch.setattr(corpus_pipeline, "saved", kept)
    seen.append(corpus_pipeline.run(spark, str(tmp_path)))
    want = list(plain_stages(rows, bench, models[0]))
    assert len(models) == 1 and len(seen) == len(want) == len(corpus_pipeline.STAGES)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for (name, _), df, plain in zip(corpus_pipeline.STAGES, seen, want, strict=True):
        assert df.columns == columns + (["size", "shard", "slot"] if name == "sharding" else []), name
        assert Counter(tuple(r) for r in df.collect()) == Counter(plain), name
    # every stage had something to do
    n = [len(rows), *map(len, want)]
    assert n[0] > n[1] > n[2] > n[3] > 30 and max(Counter(r[0] for r in want[3]).values()) > 10
    assert len({r[6] for r in want[4]}) > 4
