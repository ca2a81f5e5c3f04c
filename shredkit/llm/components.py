"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shredkit.llm.frames import saved

ROWS_PER_TASK = 200_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(doc, root): every node that has an edge, with the smallest node of its component.

    Each round hangs the neighbours of a node under their smallest one, first
    the larger ones, then all smaller ones; the number of rounds grows with the
    logarithm of the component sizes. Every round is a written table; nothing
    but a count and a checksum comes to the driver.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    links = saved(links, "components")
    before = None
    while (now := _state(links)) != before:
        before = now
        # a small table of links needs few tasks and files in every round
        n = max(1, -(-now[0] // ROWS_PER_TASK))
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        least = saved(least.coalesce(n), "components-least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = saved(large.where("u != v").distinct().coalesce(n), "components-large")
        least = saved(links.groupBy("u").agg(F.min("v").alias("m")).coalesce(n), "components-least")
        joined = links.join(least, "u")
        small = joined.select("u", F.col("m").alias("v")).unionByName(
            joined.select(F.col("v").alias("u"), F.col("m").alias("v")))
        links = saved(small.where("u != v").distinct().coalesce(n), "components-small")
    stars = links.select(F.col("u").alias("doc"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("doc"), "root").distinct())


def _state(links: DataFrame) -> tuple:
    mark = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(mark)).first())
