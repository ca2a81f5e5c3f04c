"""Dealt batches: documents are dealt by their id once, the tables are written where they lie."""

import glob
import uuid

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shredkit.config import FlattenOptions, IngestConfig
from shredkit.operators import ingest as I
from shredkit.operators import tables as T
from shredkit.operators.ingest import ingest_batch
from shredkit.plans import nest
from shredkit.plans.flatten import flatten
from shredkit.session import safe_planning, scoped_conf


def _cfg(loc, **more):
    more = {"on_duplicate": "allow", "options": FlattenOptions(promote_json=False), **more}
    return IngestConfig(table=f"t_dealt_{uuid.uuid4().hex[:8]}", id_field="id", location=str(loc), buckets=4, **more)


def _docs(spark, ids=400):
    item = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.struct(i.alias("n"), F.lit("x").alias("k")))
    return spark.range(ids).select("id", (F.col("id") % 7).alias("v"), item.alias("items"))


def test_children_are_written_without_a_shuffle_of_their_own(spark, tmp_path, monkeypatch):
    hints, hint = [], DataFrame.hint
    monkeypatch.setattr(type(_docs(spark)), "hint", lambda self, name, *a: hints.append(name) or hint(self, name, *a))
    cfg = _cfg(tmp_path)
    ingest_batch(_docs(spark), cfg)
    assert "rebalance" not in hints
    assert spark.table(f"{cfg.table}_items").count() == 2000
    files = glob.glob(f"{tmp_path}/**/*.parquet", recursive=True)
    assert files and all("zstd" in f for f in files)


def test_children_of_a_dealt_batch_are_deduplicated_in_place(spark):
    batch = I._persist_spread(_docs(spark), "id", 4)
    with scoped_conf(spark, safe_planning(spark) | T.DEALT):
        items = flatten(batch.df, "id", "t", FlattenOptions(promote_json=False))["t_items"]
        assert items.count() == 2000
        items.collect()
        plan = items._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    batch.release()
    assert "Exchange" not in plan.split("InMemoryRelation")[0] and "Aggregate" in plan.split("InMemoryRelation")[0]


@pytest.mark.parametrize("append_only", [True, False])
def test_second_ingest_of_the_same_and_more_documents(spark, tmp_path, append_only):
    cfg = _cfg(tmp_path, children_append_only=append_only)
    ingest_batch(_docs(spark), cfg)
    more = _docs(spark, 600).where("id >= 200").withColumn("v", F.lit(-1).cast("long"))
    ingest_batch(more, cfg)
    main = {r["id"]: r["v"] for r in spark.table(cfg.table).collect()}
    assert main == {i: i % 7 if i < 200 else -1 for i in range(600)}
    assert spark.table(f"{cfg.table}_items").groupBy("parent_id").count().where("count = 5").count() == 600


def test_partitions_without_remaining_rows_are_not_read_again(spark, tmp_path, monkeypatch):
    cfg = _cfg(tmp_path, children_append_only=False)
    ingest_batch(_docs(spark), cfg)
    monkeypatch.setattr(T, "merge_upsert", None)  # every row is replaced: nothing to merge with
    ingest_batch(_docs(spark), cfg)
    assert spark.table(f"{cfg.table}_items").count() == 2000 and spark.table(cfg.table).count() == 400


def test_a_hot_id_keeps_the_batch_spread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "DEAL_BYTES", 1000)
    hot = _docs(spark).unionByName(_docs(spark).withColumn("id", F.lit(3).cast("long")))
    batch = I._persist_spread(hot, "id", 4)
    assert not batch.dealt
    batch.release()
    cfg = _cfg(tmp_path)
    ingest_batch(hot, cfg)
    assert spark.table(f"{cfg.table}_items").count() == 2000 and spark.table(cfg.table).count() == 800


def test_a_batch_that_lies_dealt_stays(spark):
    docs = _docs(spark).repartition(8 * spark.sparkContext.defaultParallelism, "id")
    batch = I._persist_spread(docs, "id", 4)
    assert batch.dealt and batch.spare is None and len(batch.caches) == 1
    batch.release()
    kept = docs.persist()
    batch = I._persist_spread(docs, "id", 4)
    batch.release()
    assert batch.caches == [] and docs.storageLevel.useMemory  # the caller's own
    kept.unpersist()


def test_nested_orders_over_given_tasks_are_the_same_rows(spark, tmp_path):
    spark.createDataFrame([(1, 1, "O", 1.0, "p"), (2, None, "F", 2.0, "q"), (None, 1, "F", 2.0, "q")],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string") \
        .withColumn("o_orderdate", F.lit("2020-01-01").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "c", "m")], "c_custkey long, c_name string, c_mktsegment string") \
        .write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 1, "R", 1.0), (1, 1, "R", 1.0), (None, 2, "N", 2.0)],
                          "l_orderkey long, l_linenumber int, l_returnflag string, l_quantity double") \
        .withColumn("l_shipdate", F.lit("2020-01-01").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/lineitem.parquet")
    tasks = nest.ingest_tasks(spark, str(tmp_path), 16)
    one, two = (nest.nested_orders(spark, str(tmp_path), n).collect() for n in (None, tasks))
    assert tasks % 16 == 0 and sorted(map(str, one)) == sorted(map(str, two))
