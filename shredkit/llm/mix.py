"""Mixing sources to target weights by Poisson replication (native).

Every source gets a repetition rate = (target share x budget) / (bytes it
has). A document is repeated as often as the inverse of the Poisson
distribution with that mean says for a uniform number made from the seed and
the doc_id: 0, 1, 2, ... copies. The expected bytes of every source then meet
its share, no document needs to know any other, and a rerun gives the same
copies. The copies are shuffled globally by a hash of (seed, doc_id, copy).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shredkit.llm.frames import fresh, hex_long, id_text, quoted, saved, text_or_empty, without

#: Rates above this are drawn as a sum of independent parts of at most this mean.
PART_MEAN = 16.0
#: P(X > 96) for mean 16 is below 1e-40, less than a 52-bit uniform can meet.
LAST_COUNT = 96
#: Source tables up to this many rows (under 1 KB each) are broadcast; larger ones are joined by shuffle.
BROADCAST_SOURCES = 10_000
#: Parts that one row draws and repeats by itself (about 1,000 copies). Documents of more are
#: handled in chunks of as many, spread over the cluster.
CHUNK_PARTS = 64


def source_rates(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    budget_bytes: int | None = None,
    other_weight: float = 0.0,
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per source: ``key`` (its name, may be null), ``rate``.

    ``weights`` None: equal weights. Sources not named in ``weights`` have
    ``other_weight``. The budget is all bytes unless given. A source without
    any bytes keeps its rows once (rate 1).
    """
    size = F.octet_length(text_or_empty(text)).cast("long")
    by = docs.groupBy(F.col(quoted(source)).cast("string").alias("key")).agg(F.sum(size).alias("bytes"))
    weight = F.lit(1.0)
    if weights is not None:
        weight = F.lit(float(other_weight))
        for name, w in weights.items():
            weight = F.when(F.col("key") == name, F.lit(float(w))).otherwise(weight)
    by = saved(by.withColumn("weight", weight), "mix-sources")
    all_of = by.agg(F.sum("weight").alias("w"), F.sum("bytes").alias("b")).first()
    budget = float(budget_bytes if budget_bytes is not None else (all_of["b"] or 0))
    share = F.col("weight") / F.lit(float(all_of["w"] or 1.0))
    rate = F.when(F.col("bytes") == 0, F.lit(1.0)).otherwise(share * F.lit(budget) / F.col("bytes"))
    return by.select("key", rate.alias("rate"))


def _cdf(mean: Column) -> Column:
    """P(X <= k) for k = 0 .. LAST_COUNT as an array."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"),
                        F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(LAST_COUNT)), start, step, lambda a: a["all"])


def uniform(seed: int, name: Column, part: Column) -> Column:
    """A number in (0, 1) with 52 random bits from the MD5 of seed, name and part."""
    text = F.concat_ws("|", F.lit(str(seed)), name, part.cast("string"))
    return (hex_long(text, 13) + F.lit(0.5)) / F.lit(float(1 << 52))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    budget_bytes: int | None = None,
    seed: int = 17,
    other_weight: float = 0.0,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
) -> DataFrame:
    """The mixed corpus in global random order.

    Returns the input columns plus ``copy`` (1 .. ``copies``), ``copies``,
    ``rate`` and ``order_key`` (rows of a partition are sorted by it; it is
    uniform, so the partitions are random subsets).

    Null sources are a source of their own. Rows without a doc_id draw by
    their text; repeated rows draw alike. Empty and null texts have no bytes
    and are repeated at the rate of their source. An empty table stays empty.
    Input columns named like one of the four are replaced.
    """
    docs = without(docs, "copy", "copies", "rate", "order_key")
    rates = source_rates(docs, weights, budget_bytes, other_weight, text, source)
    key, cdf, parts, name = (fresh(docs, n) for n in ("_source", "_cdf", "_parts", "_name"))
    parts_col = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_MEAN)).cast("long")
    rates = rates.select(F.col("key").alias(key), "rate", parts_col.alias(parts))
    rates = rates.withColumn(cdf, _cdf(F.col("rate") / F.col(parts)))
    rates = saved(rates, "mix-rates")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    with_rate = docs.join(rates, F.col(quoted(source)).cast("string").eqNullSafe(F.col(key)))
    with_rate = with_rate.withColumn(name, id_text(F.col(quoted(doc_id)), text_or_empty(text)))
    kept = [F.col(quoted(c)) for c in docs.columns]

    few = with_rate.where(F.col(parts) <= CHUNK_PARTS)
    few = few.withColumn("copies", _drawn(seed, name, cdf, F.lit(1).cast("long"), F.col(parts)).cast("int"))
    few = few.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    out = few.select(*kept, "copy", "copies", "rate", F.col(name).alias("order_key"))
    if rates.where(F.col(parts) > CHUNK_PARTS).count():
        many = _many_copies(with_rate.where(F.col(parts) > CHUNK_PARTS), seed, name, key, cdf, parts)
        out = out.unionByName(many.select(*kept, "copy", "copies", "rate", F.col(name).alias("order_key")))
    order = hex_long(F.concat_ws("|", F.lit(f"{seed}:order"), F.col("order_key"), F.col("copy").cast("string")))
    out = out.withColumn("order_key", order)
    return out.repartition(F.col("order_key")).sortWithinPartitions("order_key", "copy")


def _drawn(seed: int, name: str, cdf: str, first: Column, last: Column) -> Column:
    """The Poisson counts of the parts first .. last, summed. Each uniform is computed once."""
    draws = F.transform(F.sequence(first, last), lambda i: uniform(seed, F.col(name), i))
    counts = F.transform(draws, lambda u: F.size(F.filter(F.col(cdf), lambda c: c < u)))
    return F.aggregate(counts, F.lit(0).cast("long"), lambda n, k: n + k)


def _many_copies(rows: DataFrame, seed: int, name: str, key: str, cdf: str, parts: str) -> DataFrame:
    """Repeat documents of very many copies, ``CHUNK_PARTS`` parts at a time.

    The counts of the chunks are drawn without the texts, in tasks dealt by (document, chunk), and
    summed up per document; each chunk then repeats its document on its own.
    """
    chunk, n, before = fresh(rows, "_chunk"), fresh(rows, "_n"), fresh(rows, "_before")
    last_chunk = F.floor((F.col(parts) - 1) / CHUNK_PARTS)
    # Rows that repeat a document draw alike: one of them is enough.
    drawn = rows.groupBy(name, key).agg(F.first(parts).alias(parts), F.first(cdf).alias(cdf))
    drawn = drawn.withColumn(chunk, F.explode(F.sequence(F.lit(0).cast("long"), last_chunk)))
    drawn = drawn.repartition(F.col(name), F.col(key), F.col(chunk))
    low = F.col(chunk) * CHUNK_PARTS + 1
    high = F.least(F.col(parts), (F.col(chunk) + 1) * CHUNK_PARTS)
    drawn = saved(drawn.select(name, key, chunk, _drawn(seed, name, cdf, low, high).alias(n)), "mix-chunks")
    upto = Window.partitionBy(name, key)  # a few numbers per thousand copies
    drawn = drawn.withColumn(before, F.coalesce(
        F.sum(n).over(upto.orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    drawn = saved(drawn.withColumn("copies", F.sum(n).over(upto).cast("int")).where(F.col(n) > 0), "mix-copies")
    drawn = drawn.withColumnsRenamed({name: f"{name}_2", key: f"{key}_2"})
    same = (F.col(name) == F.col(f"{name}_2")) & F.col(key).eqNullSafe(F.col(f"{key}_2"))
    spread = rows.join(drawn, same).repartition(F.col(name), F.col(key), F.col(chunk))
    return spread.withColumn("copy", F.explode(F.sequence(
        (F.col(before) + 1).cast("int"), (F.col(before) + F.col(n)).cast("int"))))
