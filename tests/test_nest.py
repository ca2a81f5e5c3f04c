"""Bounded nesting: one rule for every key."""

from pyspark.sql import functions as F

from shredkit import FlattenOptions, flatten
from shredkit.plans.nest import nest_rows


def test_hot_key_is_nested_in_bounded_documents(spark):
    # key 0 holds two thirds of the rows, a null key some more
    rows = spark.range(3000).select(
        F.when(F.col("id") < 2000, F.lit(0)).when(F.col("id") < 2900, F.col("id")).alias("k"),
        F.col("id").alias("v"), F.lit("same").alias("w"))
    docs = nest_rows(rows, ["k"], ["v", "w"], "items", "v", max_items=100)
    sizes = docs.groupBy("k").agg(F.sum(F.size("items")).alias("n"), F.max(F.size("items")).alias("most"))
    got = {r.k: (r.n, r.most) for r in sizes.collect()}
    assert got[0] == (2000, 100) and got[None] == (100, 100) and len(got) == 902
    # equal items spread like any others
    same = nest_rows(rows, ["k"], ["w"], "items", "v", max_items=100)
    assert same.agg(F.max(F.size("items"))).first()[0] == 100
    # Child rows are a set per parent: they do not depend on the number of documents.
    t = flatten(docs, "k", "m", FlattenOptions(promote_json=False, dedup_main=True))
    assert t["m_items"].count() == 3000
    assert t["m"].count() == 902


def test_nesting_shuffles_once_on_key_and_range(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    plan = nest_rows(rows, ["k"], ["v"], "items", "v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
