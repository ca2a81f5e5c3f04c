"""Sharding, mixing and chat formatting (native operators)."""

import os
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
from conftest import COLUMNS
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "tools"))

from check_oracles import compare  # noqa: E402

import corpus_pipeline  # noqa: E402
from shredkit.llm import chat, mix, shard  # noqa: E402


def python_free(df) -> bool:
    plan = df._jdf.queryExecution().toString()
    return not any(w in plan for w in ("Python", "Pandas", "MapInArrow", "ArrowEval"))


def check_shards(rows, n_shards, biggest):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    total = sum(r["size"] for r in rows)
    for j, group in by.items():
        assert sorted(r["slot"] for r in group) == list(range(len(group))), j
    for j in range(n_shards):
        size = sum(r["size"] for r in by.get(j, []))
        assert abs(size - total / n_shards) <= biggest + 1


def test_sharding_takes_messy_rows(messy, nothing):
    out = shard.shard_by_bytes(messy)
    assert python_free(out)
    rows = out.collect()
    assert len(rows) == messy.count()
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 for r in rows)
    check_shards(rows, 8, max(r["size"] for r in rows))
    assert set(messy.columns) - {"SLOT", "size", "shard"} <= set(out.columns)
    empty = shard.shard_by_bytes(nothing)
    assert empty.collect() == [] and "slot" in empty.columns


def test_sharding_splits_a_hot_text_and_keeps_small_groups(spark):
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same words in all of them").alias("text"))
    rest = spark.range(3000, 9000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") / 2).cast("int")).alias("text"))
    rows = shard.shard_by_bytes(hot.unionByName(rest).repartition(5), 8).collect()
    check_shards(rows, 8, 60)
    at = defaultdict(set)
    for r in rows:
        at[r["text"]].add(r["shard"])
    assert len(at["same words in all of them"]) >= 2
    assert all(len(s) == 1 for t, s in at.items() if t.startswith("text "))


def test_sharding_does_not_depend_on_partitions(small_docs):
    a = {r["doc_id"]: (r["shard"], r["slot"]) for r in shard.shard_by_bytes(small_docs.repartition(1)).collect()}
    b = {r["doc_id"]: (r["shard"], r["slot"]) for r in shard.shard_by_bytes(small_docs.repartition(7)).collect()}
    assert a == b


def test_mixing_takes_messy_rows(messy, nothing):
    out = mix.mix_sources(messy)
    assert python_free(out)
    rows = out.collect()
    copies = Counter((r["doc_id"], r["text"], r["copy"]) for r in rows)
    repeated = {k for k, n in copies.items() if n > 1}
    assert all(k[0] in (2, None) for k in repeated)  # only the repeated rows
    assert all(1 <= r["copy"] <= r["copies"] for r in rows)
    assert mix.mix_sources(nothing).collect() == []


def test_mixing_meets_its_weights(spark):
    docs = spark.range(20000).select(
        F.col("id").alias("doc_id"), F.lit("0123456789").alias("text"),
        F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "mid").otherwise("small").alias("source"))
    n = Counter(r["source"] for r in mix.mix_sources(docs, {"big": 1, "mid": 1, "small": 2}).collect())
    total = sum(n.values())
    assert abs(total - 20000) < 600
    for s, share in (("big", 0.25), ("mid", 0.25), ("small", 0.5)):
        assert abs(n[s] / total - share) < 0.02
    huge = mix.mix_sources(docs.where("source = 'small'").limit(20), {"small": 1}, budget_bytes=20 * 10 * 500)
    assert abs(huge.count() - 20 * 500) < 6 * (20 * 500) ** 0.5


def test_poisson_counts_have_poisson_variance(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("s").alias("source"))
    counts = Counter(r["doc_id"] for r in mix.mix_sources(docs, budget_bytes=40000).collect())
    n = [counts.get(i, 0) for i in range(20000)]
    mean = sum(n) / len(n)
    var = sum((x - mean) ** 2 for x in n) / len(n)
    assert abs(mean - 2) < 0.05 and abs(var - 2) < 0.1


def brute_chats(rows):
    convs = defaultdict(set)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].add((turn, role, text))
    low = lambda v: (v is not None, v if v is not None else 0)
    word = lambda v: (v is not None, v or "")
    said = {c: [(r, t) for _, r, t in sorted(x, key=lambda y: (low(y[0]), word(y[1]), word(y[2])))]
            for c, x in convs.items()}
    kept = {}
    for c, s in said.items():
        longer = any(len(o) > len(s) and o[:len(s)] == s for o in said.values())
        twin = any(o == s and d < c for d, o in said.items())
        if not longer and not twin:
            kept[c] = "".join(f"<|im_start|>{r or 'user'}\n{t or ''}<|im_end|>\n" for r, t in s)
    return kept


CHATS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "more"),
    (3, 0, "user", "hi"), (4, 0, "user", "hi"), (4, 1, "assistant", "other"),
    (5, 0, "user", "alone"), (6, 5, "user", "alone"), (6, 5, "user", "alone"),
    (7, None, None, None), (7, 1, "user", None), (None, 0, "user", "no conversation"),
    (8, 1, "user", "tie b"), (8, 1, "user", "tie a"), (9, 0, "user", ""),
    (10, 0, "user", "long " * 5000), (10, 7, "assistant", "end"),
]


def test_chats_match_brute_force(spark):
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(CHATS + [(20, i, "user", str(i)) for i in range(9)] +
                               [(21, i, "user", str(i)) for i in range(30)], schema)
    extra = df.withColumns({c: F.lit(1) for c in ("pos", "block", "n", "p1", "conv", "part")})
    rows = [tuple(r) for r in df.collect()]
    for block in (4, 1024):
        out = chat.format_chats(extra, block)
        assert python_free(out)
        got = defaultdict(dict)
        for r in out.collect():
            got[r["conv_id"]][r["part"]] = r["text"]
        assert {c: "".join(p[i] for i in sorted(p)) for c, p in got.items()} == brute_chats(rows)
    assert max(len(p) for p in got.values()) == 1
    assert chat.format_chats(df.limit(0)).collect() == []


def test_crc_column_of_the_shard_query(spark, sf_small):
    from shredkit.llm import queries

    rows = queries.op10_shard_bytes(spark, sf_small).join(
        spark.read.parquet(f"{sf_small}/documents.parquet"), "doc_id").collect()
    assert all(r["text_crc32"] == zlib.crc32((r["text"] or "").encode()) for r in rows)
    assert {r["law"] for r in rows} == {"bytes"}


def test_very_many_copies_are_drawn_in_chunks(spark, monkeypatch):
    """A source of two short documents beside a large one: the same copies whether a row repeats itself
    or its chunks do, numbered without gaps, and as many as the distribution says."""
    import hashlib
    import math

    rows = [(i, "word " * 400, "en", "big", 1) for i in range(60)]
    rows += [(900, "x", "en", "tiny", 1), (901, "y", "en", "tiny", 1), (901, "y", "en", "tiny", 1), (None, "z", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    monkeypatch.setattr(mix, "CHUNK_PARTS", 1 << 40)
    whole = sorted(map(tuple, mix.mix_sources(docs).collect()), key=str)
    monkeypatch.setattr(mix, "CHUNK_PARTS", 7)
    assert sorted(map(tuple, mix.mix_sources(docs).collect()), key=str) == whole
    total = sum(len(r[1]) for r in rows)
    rate = total / 3 / 3  # a third of the bytes for the three of "tiny"
    parts = math.ceil(rate / 16)
    assert rate > 500
    mean = rate / parts
    cdf, p = [], math.exp(-mean)
    for k in range(97):
        p = p if k == 0 else p * mean / k
        cdf.append(p + (cdf[-1] if cdf else 0))
    for doc_id, repeats in ((900, 1), (901, 2)):
        want = sum(sum(c < (int(hashlib.md5(f"17|{doc_id}|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for c in cdf)
                   for i in range(1, parts + 1))
        got = sorted(r[5] for r in whole if r[0] == doc_id)
        assert got == sorted(list(range(1, want + 1)) * repeats)
        assert {r[6] for r in whole if r[0] == doc_id} == {want}


def test_sharding_divides_very_many_equal_rows(spark):
    """One document repeated until it is half of all bytes, as mixing does: no unit of it, no task
    that sorts it whole, and near equal shards."""
    rows = [(i, f"text {i} " * (5 + i % 40)) for i in range(1500)]
    total = sum(len(t) for _, t in rows)
    rows += [(9000, "again " * 50)] * (total // 300)
    rows += [(9001, "other " * 30)] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = shard.shard_by_bytes(docs)
    assert python_free(out)
    got = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
    check_shards(got, 8, 0.01 * sum(r["size"] for r in got) / 8 + max(r["size"] for r in got))
    hot = Counter(r["shard"] for r in got if r["doc_id"] == 9000)
    assert len(hot) >= 3


def test_sharding_of_few_doubled_rows_matches_sql(spark, tmp_path):
    """A small table whose rows all come twice: each pair is above the tolerance, but they are no very many rows."""
    rows = [(i, f"text {i} " * (5 + i % 40), "en", "a", i) for i in range(60)] * 2
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = corpus_pipeline.queries()["op10_shard_bytes"](spark, str(tmp_path)).toPandas()
    assert len(got) == 120
    assert compare(got, con.execute(corpus_pipeline.oracle_sql()["op10_shard_bytes"]).df()) is None
