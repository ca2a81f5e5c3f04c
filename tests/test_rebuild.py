"""Documents rebuilt from a family equal the documents that were flattened."""

import uuid

import pytest

from shredkit.config import FlattenOptions, IngestConfig
from shredkit.operators import ingest_batch, rebuild_documents
from shredkit.plans import nest
from shredkit.plans.flatten import flatten
from shredkit.session import scratch_path


def _rows(df):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=str)


def _cfg(spark, **options):
    return IngestConfig(table=f"t_re_{uuid.uuid4().hex[:8]}", id_field="id", location=scratch_path(spark, "tables"),
                        options=FlattenOptions(promote_json=False, **options))


DEEP = """id bigint, v string, s struct<a:int, t:struct<b:string>>, tags array<string>,
          items array<struct<k:int, sub:array<struct<x:int, ys:array<int>>>, one:struct<z:int>>>"""
DOCS = [(1, "a", (1, ("p",)), ["q", "q", "b"], [(5, [(1, [3, 2, 3]), (0, None)], (7,)), (5, None, None), (4, [(9, [1])], (8,))]),
        (2, None, None, None, None), (3, "c", (None, None), ["z"], [(i, [(j, [j]) for j in range(3)], None) for i in range(12)])]


def test_ordinals_give_the_documents_back_at_any_depth(spark):
    df = spark.createDataFrame(DOCS, DEEP)
    cfg = _cfg(spark, keep_ordinal=True)
    ingest_batch(df, cfg)
    assert _rows(rebuild_documents(spark, cfg.table, "id", df.schema)) == _rows(df)


def test_without_ordinals_arrays_are_sets(spark):
    df = spark.createDataFrame([(1, "a", [(1,), (2,), (1,)], (3,)), (2, "b", [], None)],
                               "id bigint, v string, items array<struct<k:int>>, s struct<x:int>")
    cfg = _cfg(spark)
    ingest_batch(df, cfg)
    got = {r.id: r for r in rebuild_documents(spark, cfg.table, "id", df.schema).collect()}
    assert sorted(x.k for x in got[1]["items"]) == [1, 2] and got[1].s.x == 3
    assert got[2]["items"] is None and got[2].s is None  # an empty array leaves no rows
    deep = spark.createDataFrame([(1, [([1],)])], "id bigint, items array<struct<k:array<int>>>")
    cfg = _cfg(spark)
    ingest_batch(deep, cfg)
    with pytest.raises(ValueError, match="scalar fields"):
        rebuild_documents(spark, cfg.table, "id", deep.schema)


def test_nothing_is_shuffled(spark, sf_small):
    doc = nest.nested_orders(spark, sf_small).withColumnRenamed("o_orderkey", "id")
    cfg = _cfg(spark)
    ingest_batch(doc, cfg)
    ingest_batch(doc.where("id % 7 = 0"), cfg)  # a second layer
    out = rebuild_documents(spark, cfg.table, "id", doc.schema)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 3
    assert out.count() == doc.count()
    one, same = (d.where("id % 50 = 0").select("id", "customer", "items") for d in (out, doc))
    canon = [[(r["id"], r["customer"], sorted(map(str, r["items"] or []))) for r in _rows(d)] for d in (one, same)]
    assert sorted(canon[0], key=str) == sorted(canon[1], key=str)


def test_fields_that_the_family_lacks_are_null(spark):
    df = spark.createDataFrame([(1, "a")], "id bigint, v string")
    cfg = _cfg(spark)
    ingest_batch(df, cfg)
    wider = spark.createDataFrame([], "id bigint, v string, w int, s struct<x:int>, a array<int>").schema
    assert rebuild_documents(spark, cfg.table, "id", wider).first().asDict() == {"id": 1, "v": "a", "w": None, "s": None, "a": None}


def test_ordinals_with_a_struct_at_the_root(spark):
    df = spark.createDataFrame([(1, (2,))], "id bigint, s struct<x:int>")
    t = flatten(df, "id", "m", FlattenOptions(promote_json=False, keep_ordinal=True))["m_s"]
    assert [(r.parent_id, r.x) for r in t.collect()] == [(1, 2)]
