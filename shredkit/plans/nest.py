"""Nested document frames built from the flat test tables.

These give ``flatten`` realistic nested input whose expected output is known
from the flat tables. Grouping rows into arrays is bounded by a rule that is
the same for every key: the rows of a key are numbered by a unique child
column, and each range of ``max_items`` numbers is one document. Documents of
the same key carry identical scalars; child tables are sets per ``parent_id``,
so they come out the same however many documents a key has.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shredkit.constants import DATE_FORMAT
from shredkit.session import parallelism


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nest_rows(
    child: DataFrame,
    keys: Sequence[str],
    items: Sequence[str | object],
    name: str,
    unique: str,
    max_items: int = 65536,
) -> DataFrame:
    """``keys`` + ``name: array<struct<items>>``, one row per key and range of ``unique``.

    ``unique`` numbers the rows of a key; every ``max_items`` numbers make one
    document, whatever the size of the key, so no array is longer. One scan and
    one shuffle on (key, range); null keys are a key like any other.
    """
    item_cols = [F.col(i) if isinstance(i, str) else i for i in items]
    part = F.floor(F.col(unique) / F.lit(max_items)).alias("__part")
    return (child.groupBy(*keys, part)
                 .agg(F.collect_list(F.struct(*item_cols)).alias(name))
                 .drop("__part"))


def orders_with_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders + ``customer struct<c_name, c_mktsegment>``."""
    orders = table(spark, sf_dir, "orders")
    cust = table(spark, sf_dir, "customer").select(
        "c_custkey", F.struct("c_name", "c_mktsegment").alias("customer"))
    doc = orders.join(cust, orders.o_custkey == cust.c_custkey, "left")
    return doc.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                      "o_orderdate", "o_orderpriority", "customer")


#: Rows of lineitem per partition where nested orders are built for an ingest.
INGEST_ROWS = 500_000


def ingest_tasks(spark: SparkSession, sf_dir: str, buckets: int) -> int:
    """A multiple of the tables' buckets that suits the size of nested orders (lineitem's footers count it)."""
    wanted = max(table(spark, sf_dir, "lineitem").count() / INGEST_ROWS, parallelism(spark))
    return buckets * max(1, math.ceil(wanted / buckets))


def nested_orders(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """orders + ``customer struct<c_name, c_mktsegment>`` +
    ``items array<struct<l_linenumber, l_returnflag, l_quantity, l_shipdate>>``.

    With ``tasks`` the join by order is made over so many partitions."""
    li = table(spark, sf_dir, "lineitem")
    items = nest_rows(li, ["l_orderkey"],
                      ["l_linenumber", "l_returnflag", "l_quantity", "l_shipdate"],
                      "items", "l_linenumber")
    orders = orders_with_customer(spark, sf_dir)
    if tasks:
        orders, items = orders.repartition(tasks, "o_orderkey"), items.repartition(tasks, "l_orderkey")
    return orders.join(items, orders.o_orderkey == items.l_orderkey, "left").drop("l_orderkey")


def nested_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer + ``orders array<struct<o_orderkey, o_orderstatus, o_totalprice,
    o_orderdate, items array<struct<l_linenumber, l_returnflag, l_quantity>>>>``."""
    orders = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem")
    items = nest_rows(li, ["l_orderkey"], ["l_linenumber", "l_returnflag", "l_quantity"],
                      "items", "l_linenumber")
    o = orders.join(items, orders.o_orderkey == items.l_orderkey, "left")
    per_cust = nest_rows(
        o, ["o_custkey"],
        ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "items"],
        "orders", "o_orderkey")
    cust = table(spark, sf_dir, "customer")
    doc = cust.join(per_cust, cust.c_custkey == per_cust.o_custkey, "left")
    return doc.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "orders")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents + ``lines array<string>`` (whole text split on newlines)."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", "n_chars",
                       F.split(F.col("text"), "\n").alias("lines"))


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations nested per conversation: ``turns array<struct<turn, role, text>>``."""
    conv = table(spark, sf_dir, "conversations")
    return nest_rows(conv, ["conv_id"], ["turn", "role", "text"], "turns", "turn")


def events_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ``ts`` as text in the document date pattern (milliseconds)."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", F.date_format("ts", DATE_FORMAT).alias("ts_text"), "ts")


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents + ``label struct<quality, toxic, lang>`` (scores as text);
    unlabelled documents carry nulls inside the struct (left join), so hashes
    meet real nulls."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labels = table(spark, sf_dir, "labels")
    j = docs.join(labels, "doc_id", "left")
    return j.select("doc_id", "source",
                    F.struct(F.col("quality").cast("string").alias("quality"),
                             F.col("toxic").cast("string").alias("toxic"),
                             "lang").alias("label"))
