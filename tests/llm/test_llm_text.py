"""Licenses, classifiers, decontamination, substrings, near duplicates and search."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest import prose
from pyspark.sql import functions as F

from shredkit.llm import decontaminate, labels, licenses, neardup, quality, substrings, topk, toxicity
from shredkit.llm.components import connected_components
from shredkit.llm.words import mix


# -- licenses ---------------------------------------------------------------

def test_patience_aligns_in_order():
    a, b = "a x c d y f".split(), "a b c d e f".split()
    assert licenses.patience(a, b) == [(0, 0), (2, 2), (3, 3), (5, 5)]
    # words become unique inside a gap
    a, b = "k a q a m".split(), "k a q a m".split()
    assert len(licenses.patience(["z"] + a, b)) == 5


@pytest.mark.parametrize("seed", range(20))
def test_longest_increasing_is_longest(seed):
    r = random.Random(seed)
    js = r.sample(range(30), 12)
    chain = licenses.longest_increasing(list(enumerate(js)))
    best = [1] * len(js)
    for i in range(len(js)):
        best[i] = 1 + max([best[k] for k in range(i) if js[k] < js[i]], default=0)
    assert len(chain) == max(best)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(chain, chain[1:], strict=False))


def test_license_scan(spark, messy, nothing):
    mit = licenses.TEMPLATES["MIT"]
    edited = " ".join(w for i, w in enumerate(mit.split()) if i % 12)
    rows = [(1, prose(1, 4000) + " " + mit.upper() + " " + prose(2, 50)), (2, edited),
            (3, "Released under the MIT License.\n" * 3), (4, prose(3, 500)), (5, None), (6, "license license"),
            (7, "Licensed under CC BY-NC 4.0.")]
    got = collections.defaultdict(list)
    for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"]].append((r["license"], round(r["coverage"], 2)))
    assert got[1] == [("MIT", 1.0)]
    assert got[2][0][0] == "MIT" and got[2][0][1] >= 0.85
    assert got[3] == [("MIT-notice", 1.0)] * 3
    assert got[7] == [("CC-BY-NC-4.0-notice", 1.0)]
    assert set(got) == {1, 2, 3, 7}
    assert licenses.scan_licenses(messy).collect() == []
    assert licenses.scan_licenses(nothing).collect() == []


def test_license_notices_match_a_plain_search(spark, sf_small, small_docs):
    short = {n: t for n, t in licenses.TEMPLATES.items() if len(t) < 80}
    got = collections.Counter((r["doc_id"], r["license"]) for r in licenses.scan_licenses(small_docs).collect()
                              if r["coverage"] == 1.0)
    want = collections.Counter()
    for r in small_docs.collect():
        for n, t in short.items():
            k = len(re.findall(re.escape(t), r["text"] or ""))
            if k:
                want[(r["doc_id"], n)] = k
    assert got == want and want


# -- classifiers --------------------------------------------------------------

def accuracy(rows, labels):
    held = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    return sum(p == y for _, p, y in held) / len(held), held


@pytest.mark.parametrize("module,label,least", [(quality, "quality", 0.9), (toxicity, "toxic", 0.85)])
def test_classifier_on_held_out_labels(spark, module, label, least):
    sf = "/root/testdata/sf0.01"
    docs, marks = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = module.classify(docs, marks).collect()
    assert len(rows) == docs.count()
    share, held = accuracy(rows, {r["doc_id"]: r[label] for r in marks.collect()})
    assert len(held) > 50 and share >= least
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


@pytest.mark.parametrize("module,score", [(quality, "score_quality"), (toxicity, "score_toxicity")])
def test_classifier_takes_messy_rows(spark, messy, nothing, module, score):
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (6, 0, 0), (7, 1, 0), (8, None, None), (None, 1, 1), (99, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    model = module.train(messy, labels)
    out = getattr(module, score)(messy, model)
    rows = out.collect()
    assert len(rows) == messy.count()
    assert all(0 <= r["score"] <= 1 for r in rows)
    same = {r["score"] for r in rows if r["doc_id"] in (1, 2)}
    assert len(same) == 1
    assert len({r["score"] for r in rows if not r["text"]}) == 1
    assert module.classify(messy, labels).count() == messy.count()
    assert module.classify(nothing, labels.limit(0)).collect() == []
    assert module.classify(messy, labels.limit(0)).count() == messy.count()


def test_quality_gradients_match_differences():
    texts = [np.frombuffer(prose(i, 60 + 90 * i).encode(), np.uint8) for i in range(4)]
    y = np.array([0, 1, 1, 0], np.float32)
    net = quality.new_network(3)
    net.out[:] = np.random.default_rng(0).normal(0, 0.3, net.out.shape)
    for p in net.parameters():
        p[...] = p
    for name in ("embed", "filters", "bias", "out", "out_bias", "mean", "scale"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    blocks = [quality._blocks(t) for t in texts]
    counts = np.array([len(b) for b in blocks])
    every = np.concatenate(blocks)

    def loss():
        x = (quality._features(net, quality._block_maxima(net, every), counts) - net.mean) / net.scale
        z = x @ net.out + net.out_bias
        return float(np.mean(np.log1p(np.exp(-z)) + (1 - y) * z))

    grads = quality._gradients(net, every, counts, y, 0.0)
    r = np.random.default_rng(1)
    for p, g in zip(net.parameters(), grads, strict=True):
        for _ in range(6):
            i = tuple(int(r.integers(n)) for n in p.shape)
            old, e = p[i], 1e-3
            p[i] = old + e
            up = loss()
            p[i] = old - e
            down = loss()
            p[i] = old
            assert abs((up - down) / (2 * e) - g[i]) < 3e-3


def test_toxicity_reads_the_end_of_a_long_text():
    import pyarrow as pa

    weight = np.zeros(1 << toxicity.BITS, np.float32)
    raw = np.frombuffer(b" idiot ", np.uint8)
    _, _, _, feats = next(toxicity.hits(raw, np.array([0, 7]), np.ones(1 << toxicity.BITS, bool)))
    weight[feats] = 1
    model = toxicity.LinearModel(weight, -3.0)
    pad = "q " * (toxicity.SLICE // 2 - 2)
    for shift in range(8):
        s = toxicity.score_texts(model, pa.array([pad[shift:] + " IDIOT " + "q " * 99, "q " * 50, None]))
        assert s[0] > 0.9 and s[1] < 0.1 and s[2] == s[1]


def test_training_sample_sums_sizes_without_texts(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, i % 2, "x" * r.randrange(1, 160)) for i in range(60)]
    spark.createDataFrame([(d, t) for d, _, t in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    known = spark.createDataFrame([(d, y) for d, y, _ in rows], "doc_id long, quality int")
    got = labels.training_sample(docs, known, "quality", 4, 2, 1000, 1000)
    want, upto = [], 0
    for d, y, t in sorted(rows, key=lambda x: hashlib.md5(str(x[0]).encode()).hexdigest()):
        if zlib.crc32(str(d).encode()) % 4 != 2 and len(t) <= 125:
            upto += len(t)
            want += [(d, y, t.encode())] if upto <= 1000 else []
    assert [(x["doc_id"], x["label"], bytes(x["text"])) for x in got] == sorted(want) and want
    plan = labels.within_bytes(docs, 1000)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window ["):].splitlines()[1]
    assert "octet_length(text#" in below and not re.search(r"[\[ ]text#", below), plan


# -- decontamination ----------------------------------------------------------

def plain_local_alignment(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


@pytest.mark.parametrize("seed", range(15))
def test_smith_waterman_scores(seed):
    r = np.random.default_rng(seed)
    item = r.integers(1, 5, r.integers(1, 12)).astype(np.uint64)
    passages = r.integers(1, 5, (6, 14)).astype(np.uint64)
    best, _ = decontaminate.smith_waterman(item, passages)
    assert best.tolist() == [plain_local_alignment(item.tolist(), p.tolist()) for p in passages]


def test_decontamination_finds_copies_edits_and_nothing_else(spark, messy, nothing):
    items = [(i, prose(1000 + i, 40)) for i in range(6)] + [(6, None), (7, ""), (8, "just three words"), (None, "x y z w")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    edited = " ".join("changed" if i % 9 == 4 else w for i, w in enumerate(items[2][1].split()))
    rows = [(1, prose(1, 900) + " " + items[0][1] + " " + prose(2, 900)), (2, items[1][1].upper().replace(" ", ", ")),
            (3, prose(3, 70) + " " + edited), (4, prose(4, 3000)), (5, None), (6, ""), (None, items[0][1]),
            (7, "here are just three words"), (1, items[3][1])]
    # an item that is copied nearly everywhere is still found everywhere
    rows += [(100 + i, prose(50 + i, 30) + " " + items[4][1]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (decontaminate.BLOCK_BYTES, 300):
        got = {(r["doc_id"], r["item_id"]): r["score"]
               for r in decontaminate.contaminated(docs, bench, block_bytes=block).collect()}
        assert set(got) == {(1, 0), (2, 1), (3, 2), (7, 8), (1, 3)} | {(100 + i, 4) for i in range(40)}
        assert got[(1, 0)] == got[(2, 1)] == 1.0 and 0.7 <= got[(3, 2)] < 1
    left = {r["doc_id"] for r in decontaminate.remove_contaminated(docs, bench).collect()}
    assert left == {4, 5, 6, None}
    assert decontaminate.remove_contaminated(messy, bench).count() == messy.count()
    assert decontaminate.contaminated(nothing, bench).collect() == []
    assert decontaminate.remove_contaminated(messy, bench.limit(0)).count() == messy.count()


def test_decontamination_matches_aligning_every_place(spark, sf_small, small_docs):
    bench = spark.read.parquet(f"{sf_small}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(small_docs, bench).collect()}
    fold = lambda t: re.sub(rb"[\x00-/:-@\[-`{-\x7f]+", b" ", (t or "").encode()).lower().split()
    items = {r["item_id"]: fold(r["text"]) for r in bench.collect()}
    want = set()
    for r in small_docs.collect():
        words = fold(r["text"])
        code = {w: i + 1 for i, w in enumerate(dict.fromkeys(words))}
        h = np.array([code[w] for w in words] or [0], np.uint64)
        for i, item in items.items():
            if sum(w in code for w in item) * 2 < decontaminate.THRESHOLD * 2 * len(item):
                continue  # too few common words for any alignment
            q = np.array([code.get(w, 0) or 10**9 + n for n, w in enumerate(item)], np.uint64)
            size = 4 * len(item)
            pieces = [h[a:a + size] for a in range(0, max(1, len(h) - size // 2), size // 2)]
            passages = np.zeros((len(pieces), size), np.uint64)
            for n, p in enumerate(pieces):
                passages[n, :len(p)] = p
            if decontaminate.smith_waterman(q, passages)[0].max() >= decontaminate.THRESHOLD * 2 * len(item):
                want.add((r["doc_id"], i))
    assert got == want and want


def test_decontamination_finds_edited_and_half_copies_that_are_frequent(spark):
    """Most seeds of both items are in no document, the others in all of theirs."""
    first, second = (" ".join(f"w{i}x{k}" for k in range(n)) for i, n in enumerate((37, 59)))
    edited = " ".join("changed" if k in (6, 14, 22, 30) else w for k, w in enumerate(first.split()))
    half = " ".join(second.split()[:30])
    whole = prose(1000, 40)
    bench = spark.createDataFrame([(1, first), (2, second), (3, whole)], "item_id long, text string")
    rows = [(i, f"{prose(i, 40)} {edited if i < 40 else half} {prose(100 + i, 40)}") for i in range(80)]
    rows += [(100 + i, prose(200 + i, 60)) for i in range(20)] + [(200, whole)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == {(i, 1 if i < 40 else 2) for i in range(80)} | {(200, 3)}
    assert {round(s, 2) for s in got.values()} == {0.84, 0.51, 1.0}


def test_decontamination_finds_copies_without_long_intact_runs(spark):
    """Every replaced copy that scores the threshold is found, also where no four (or three)
    consecutive words are left."""
    r = random.Random(5)
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in (6, 7, 10, 15, 20, 37, 59)}
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    rows, want = [], set()
    for n, item in items.items():
        gone = [set(range(3, n, 4)), set(range(2, n, 3))]
        gone += [{k for k in range(n) if r.random() < p} for p in (0.2, 0.25, 0.4) for _ in range(40)]
        for drop in gone:
            copy = ["changed" if k in drop else w for k, w in enumerate(item)]
            if plain_local_alignment(item, copy) >= decontaminate.THRESHOLD * 2 * n:
                want.add((len(rows), n))
            rows.append((len(rows), " ".join([prose(len(rows), 20), *copy, prose(len(rows) + 1, 20)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(docs, bench).collect()}
    assert got == want and len(want) > 400


def zipf_prose(seed, n, vocabulary=3000):
    r = np.random.default_rng(seed)
    p = 1 / np.arange(1, vocabulary + 1)
    return [f"z{i}" for i in r.choice(vocabulary, n, p=p / p.sum())]


def edit(r, words, share):
    """Words replaced at a share of the places."""
    return [f"new{r.randrange(10**6)}" if r.random() < share else w for w in words]


def test_decontamination_by_rare_seeds_equals_aligning_every_place(spark):
    """Ordinary prose on both sides: all items share word pairs with all documents."""
    r = random.Random(11)
    items = [zipf_prose(i, r.choice([8, 15, 30, 60])) for i in range(300)]
    rows, planted = [], set()
    for d in range(40):
        words = zipf_prose(10_000 + d, 300)
        for _ in range(2):
            i = r.randrange(len(items))
            at = r.randrange(len(words))
            words[at:at] = edit(r, items[i], r.choice([0.0, 0.1, 0.25, 0.4]))
        rows.append((d, " ".join(words)))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] * 2, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(x["doc_id"], x["item_id"]): x for x in decontaminate.contaminated(docs, bench).collect()}
    code = {w: n + 1 for n, w in enumerate(dict.fromkeys(w for _, t in rows for w in t.split()))}
    texts = [np.array([code[w] for w in t.split()], np.uint64) for _, t in rows]
    width = max(map(len, texts))
    passages = np.zeros((len(texts), width), np.uint64)
    for k, t in enumerate(texts):
        passages[k, :len(t)] = t
    want = {}
    for i, item in enumerate(items):
        q = np.array([code.get(w, 10**9 + n) for n, w in enumerate(item)], np.uint64)
        best, _ = decontaminate.smith_waterman(q, passages)
        for d in np.flatnonzero(best >= decontaminate.THRESHOLD * 2 * len(item)).tolist():
            want[d, i] = best[d] / (2 * len(item))
    assert set(got) == set(want) and len(want) > 60
    assert all(abs(got[k]["score"] - v) < 1e-9 for k, v in want.items())
    for (d, i), x in got.items():  # the stated place scores as much
        place = rows[d][1].split()[x["start"]:x["end"]]
        assert abs(plain_local_alignment(items[i], place) / (2 * len(items[i])) - x["score"]) < 1e-9
        assert items[i].count(place[0]) and items[i].count(place[-1])


def test_common_seeds_are_not_looked_for():
    """Hit rows of a slice stay few where a large benchmark shares its pairs with the text."""
    import pyarrow as pa
    from shredkit.llm.words import FOLDED, words_of

    items = [{"item_id": i, "text": " ".join(zipf_prose(i, 60, 20_000))} for i in range(2000)]
    texts = pa.array([" ".join(zipf_prose(10**6 + i, 1000, 20_000)) for i in range(10)])
    block = decontaminate.read_block(items)
    index = decontaminate.SeedIndex(block.seed, block.lengths())
    counted = next(decontaminate._count_seeds(index)(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])))
    held = dict(zip(counted.column(0).to_numpy().view(np.uint64).tolist(), counted.column(1).to_pylist()))
    rare = decontaminate.rarest(block, held, decontaminate.THRESHOLD)
    few = decontaminate.SeedIndex(rare.seed, rare.lengths())

    def hits(b, i, limit):
        parts = [p for w in words_of(texts, FOLDED) for p in decontaminate.seed_hits(w, b, i)]
        assert max(len(p[0]) for p in parts) < 2 * limit
        return sum(len(p[0]) for p in parts), sum(len(decontaminate._frequent(*p, b)) for p in parts)

    every, _ = hits(block, index, decontaminate.EXPAND)
    rows, kept = hits(rare, few, decontaminate.EXPAND)
    assert rows < every / 4 and kept < rows / 100
    decontaminate.EXPAND, old = 2000, decontaminate.EXPAND  # in parts: the same hits
    try:
        assert hits(rare, few, 2000) == (rows, kept)
    finally:
        decontaminate.EXPAND = old


def test_least_pairs_is_a_lower_bound():
    r = random.Random(2)
    for _ in range(4000):
        n = r.randrange(6, 40)
        item = list(range(n))
        copy = [w if r.random() > 0.4 else -1 - k for k, w in enumerate(item)]
        copy = [w for w in copy if w >= 0 or r.random() < 0.7]  # some are dropped
        if plain_local_alignment(item, copy) >= decontaminate.THRESHOLD * 2 * n:
            pairs = sum(a >= 0 and b == a + 1 for a, b in zip(copy, copy[1:]))
            assert pairs >= decontaminate.least_pairs(n, decontaminate.THRESHOLD)


def test_recall_on_replaced_words(spark):
    r = random.Random(4)
    items = {i: zipf_prose(i, 40) for i in range(100)}
    rows, tried = [], {}
    for share in (0.1, 0.2, 0.3, 0.4):
        for i, item in items.items():
            copy = edit(r, item, share)
            tried[len(rows)] = (i, plain_local_alignment(item, copy) >= decontaminate.THRESHOLD * 2 * len(item))
            rows.append((len(rows), " ".join([*zipf_prose(5000 + len(rows), 100), *copy, *zipf_prose(9000 + len(rows), 100)])))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(docs, bench).collect()}
    above = [(d, i) for d, (i, enough) in tried.items() if enough]
    assert all(k in got for k in above) and len(above) > 300  # every copy at the threshold


@pytest.mark.parametrize("seed", range(15))
def test_passages_hold_every_hit_once_and_stay_bounded(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(1, 60))
    size = r.integers(4, 30, 3)
    row, item = np.sort(r.integers(0, 3, n)), r.integers(0, 3, n)
    at, pos = r.integers(0, 400, n), r.integers(0, 4, n)
    got = list(zip(*(x.tolist() for x in decontaminate._windows(row, at, item, pos, size[item])), strict=True))
    want = []
    for i, w, lo in sorted(zip(item.tolist(), row.tolist(), (at - pos - decontaminate.PAD).tolist(), strict=True)):
        hi, limit = lo + int(size[i]) + 2 * decontaminate.PAD, 3 * int(size[i]) + 4 * decontaminate.PAD
        if want and want[-1][:2] == [w, i] and lo <= want[-1][3] and hi - want[-1][2] <= limit:
            want[-1][3] = hi
        else:
            want.append([w, i, lo, hi])
    assert got == [tuple(x) for x in want]


# -- substrings ---------------------------------------------------------------

def brute_substrings(rows, window):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        if d is not None:
            for s in range(len(w) - window + 1):
                k = tuple(w[s:s + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if d is not None and first[tuple(w[s:s + window])] < d:
                gone.update(range(s, s + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return collections.Counter(out)


def as_counter(df):
    return collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_substrings_match_brute_force(spark, seed):
    r = random.Random(seed)
    passages = [prose(200 + i, r.randrange(8, 60)) for i in range(5)]
    rows = []
    for d in range(60):
        parts = [r.choice([prose(r.randrange(10**6), r.randrange(0, 25)), r.choice(passages), "a b " * r.randrange(20)])
                 for _ in range(r.randrange(5))]
        rows.append((r.choice([d, d, d, None, 7]), r.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(90, None), (91, ""), (92, passages[0]), (92, passages[0]), (93, passages[1] + " x " + passages[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert as_counter(substrings.dedup_substrings(df, window=12, k=4)) == brute_substrings(rows, 12)


def test_substrings_take_messy_rows(messy, nothing):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    assert as_counter(substrings.dedup_substrings(messy)) == brute_substrings(rows, 50)
    assert substrings.dedup_substrings(nothing).collect() == []


# -- near duplicates ----------------------------------------------------------

def test_bag_minhash_is_unbiased():
    r = np.random.default_rng(0)
    gap = []
    for _ in range(200):
        base = {int(x): int(r.integers(1, 9)) for x in r.integers(1, 1 << 60, 40)}
        other = {k: max(1, v + int(r.integers(-3, 4))) for k, v in base.items() if r.random() < 0.9}
        row = np.repeat([0, 1], [len(base), len(other)])
        element = mix(np.array([*base, *other], np.uint64))
        sig = neardup.bag_minhash(row, element, np.array([*base.values(), *other.values()]), 2)
        keys = set(base) | set(other)
        true = sum(min(base.get(k, 0), other.get(k, 0)) for k in keys) / sum(
            max(base.get(k, 0), other.get(k, 0)) for k in keys)
        gap.append((sig[0] == sig[1]).mean() - true)
    assert abs(np.mean(gap)) < 0.012 and np.std(gap) < 0.07


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (300, 300)]
    got = {r["doc"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}


def brute_classes(rows, similarity=0.8):
    root, bags, by_words = {}, {}, {}
    for d, t in sorted((d, t) for d, t in rows if d is not None and t is not None):
        w = tuple(re.findall(r"[^\x20\x09-\x0D]+", t))
        root.setdefault(d, d)
        if not w:
            continue
        if w in by_words:
            root[d] = by_words[w]
            continue
        by_words[w], n = d, min(5, len(w))
        bags[d] = collections.Counter(w[i:i + n] for i in range(len(w) - n + 1))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ds = sorted(bags)
    for i, a in enumerate(ds):
        for b in ds[:i]:
            common = sum((bags[a] & bags[b]).values())
            if common and common / (sum(bags[a].values()) + sum(bags[b].values()) - common) >= similarity:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    for d, _ in rows:
        if d is not None:
            root.setdefault(d, d)
    return {d: find(d) for d in root}


def classes(df):
    return {r["doc_id"]: r["class_id"] for r in df.collect()}


def test_near_duplicates_match_brute_force(spark, messy, nothing):
    r = random.Random(5)
    rows = [(m["doc_id"], m["text"]) for m in messy.collect()]
    d = 1000
    for g in range(12):
        base = prose(900 + g, r.randrange(3, 200)).split()
        for _ in range(r.randrange(2, 14)):  # a walk: links that skip the smallest member
            base = [w if r.random() > 0.012 else "new" + str(r.randrange(99)) for w in base]
            rows.append((d, "  ".join(base)))
            d += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("root", F.lit(1)).repartition(4)
    want = brute_classes(rows)
    assert classes(neardup.near_duplicates(df)) == want
    kept = [x["doc_id"] for x in neardup.keep_one(df).collect()]
    assert sorted(k for k in kept if k is not None) == sorted({k for k, c in want.items() if k == c})
    assert kept.count(None) == 2
    assert neardup.near_duplicates(nothing).collect() == []


def test_links_hidden_from_the_smallest_member_are_found(spark):
    # b and c are near copies of each other, but neither is one of a
    a = prose(70, 150).split()
    b = a[:120] + prose(71, 30).split()
    c = b[:149] + ["other"]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert classes(neardup.near_duplicates(df)) == brute_classes(rows) == {1: 1, 2: 2, 3: 2}


# -- search --------------------------------------------------------------------

def brute_top(rows, k=5, every=50):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in sorted(ok, key=lambda r: (len(r[1]), r[1])):
        if q % every == 0 and not any(o[0] == q for o in out):
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q and len(b) == len(a))
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])}
    return out


@pytest.mark.parametrize("group_rows,query_rows", [(16384, 4096), (300, 7)])
def test_top_k_matches_brute_force(spark, group_rows, query_rows):
    r = np.random.default_rng(1)
    centers = r.normal(0, 1, (6, 12))
    rows = [(i, (centers[i % 6] * (i % 6 < 5) + r.normal(0, 0.2, 12)).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[0][1]) for i in range(400)]  # one very common vector: ties
    rows += [(3000, None), (3050, [None] * 12), (3100, [float("nan")] * 12), (3150, [float("inf")] + [0.0] * 11),
             (3200, [1.0, 2.0]), (3201, [0.5, 0.5]), (3250, []), (None, [1.0] * 12), (3300, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1))
    got = {tuple(x) for x in topk.top_k(df, group_rows=group_rows, query_rows=query_rows).collect()}
    assert got == brute_top(rows)
    assert topk.top_k(df.limit(0)).collect() == []


def test_top_k_is_exact_for_large_numbers(spark):
    rows = [(0, [3e6, 1.0]), (1, [3e6, 1.0]), (2, [3e6, 1.01]), (3, [3e6, 0.99]), (50, [1e200, 1e200]), (51, [-1e200, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(x) for x in topk.top_k(df, k=3).collect()}
    assert len(got) == 6
    small = {g for g in got if g[0] == 0 and g[2] < 50}
    assert {(g[2], g[3]) for g in small} <= {(q[2], q[3]) for q in brute_top(rows[:4], 5)}


def test_pages_are_skipped():
    r = np.random.default_rng(2)
    centers = r.normal(0, 4, (40, 8))
    x = np.floor(256 * (centers[np.arange(8000) % 40] + r.normal(0, 0.05, (8000, 8))))
    norms = np.einsum("ij,ij->i", x, x)
    wide = np.concatenate([x, np.sqrt(norms.max() - norms)[:, None]], axis=1)
    tree = topk.bulk_load(wide, np.arange(8000), np.zeros(8000))
    seen = 0

    def counted(c, q, exact=topk._exact):
        nonlocal seen
        seen += len(c)
        return exact(c, q)

    old, topk._exact = topk._exact, counted
    try:
        got = topk.search(tree, wide, x, np.arange(8000), x[0], 0, float(np.sqrt(norms.max())), 5)
    finally:
        topk._exact = old
    s = x @ x[0]
    s[0] = -np.inf
    assert [g[0] for g in got] == sorted(s, reverse=True)[:5]
    assert seen < 4000


def test_texts_that_share_a_doc_id_are_documents_of_their_own(spark):
    alone, other, twin = prose(301, 60), prose(302, 60), prose(303, 60)
    near = twin + " end"
    rows = [(1, alone, "x"), (1, other, "y"), (1, other, "y"), (1, twin, "z"), (2, near, "x"), (3, other, "x"),
            (4, None, "x"), (4, "", "y"), (None, alone, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = sorted(neardup.near_duplicates(df).collect())
    assert got == [(1, 1)] * 4 + [(2, 1), (3, 1), (4, 4), (4, 4)]
    kept = {(r["doc_id"], r["text"]) for r in neardup.keep_one(df).collect()}
    assert kept == {(1, alone), (1, other), (1, twin), (4, None), (4, ""), (None, alone)}
    assert neardup.keep_one(df).count() == 6


# -- clashing names, labels of absent documents ----------------------------------

def test_keep_one_takes_clashing_names(messy):
    kept = neardup.keep_one(messy)
    assert kept.columns == messy.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == [1, 3, 4, 5, 6, 7, 8]  # 2 repeats 1, 9 repeats 8


def test_labels_of_absent_documents_leave_no_gaps(spark):
    docs = spark.createDataFrame([(i, f"text {i}" if i % 10 else None) for i in range(0, 4000, 4)], "doc_id long, text string")
    marked = spark.range(0, 40_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    rows = labels.sample_rows(docs, marked, "quality", 5, 0, 300).collect()
    assert len(rows) == 300 and all(r["doc_id"] % 4 == 0 and r["doc_id"] % 10 for r in rows)


def test_substrings_do_not_depend_on_hashes(spark, monkeypatch):
    """With anchors cut to a few bits every window meets every other; the words decide."""
    real = substrings.gram_hashes
    monkeypatch.setattr(substrings, "gram_hashes", lambda h, k, seed=1: real(h, k, seed) & np.uint64(7))
    rows = [(i, prose(40 + i % 3, 130) + " " + prose(i, 70) + " " + prose(90 + i % 2, 60)) for i in range(12)]
    rows += [(20, rows[3][1]), (20, rows[3][1]), (21, None), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.dedup_substrings(df).collect()}
    assert got == set(brute_substrings(rows, 50))


def test_queries_meet_few_groups_of_clustered_vectors(spark, monkeypatch):
    r = np.random.default_rng(8)
    centers = r.normal(0, 4, (30, 8))
    rows = [(i, (centers[i % 30] + r.normal(0, 0.05, 8)).tolist()) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    counts, real = [], topk._visits

    def counted(asked, roots, groups, first):
        out = real(asked, roots, groups, first).cache()
        counts.append((asked.count(), out.count(), sum(groups.values())))
        return out

    monkeypatch.setattr(topk, "_visits", counted)
    got = {tuple(x) for x in topk.top_k(df, every=100, group_rows=200).collect()}
    assert got == brute_top(rows, every=100)
    (queries, met, groups), (_, more, _) = counts
    assert met == queries == 60 and groups >= 30
    assert more < queries * groups / 4  # of all groups, most are out of reach after the first search
