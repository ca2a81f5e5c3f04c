"""Sharding by histogram sort (native).

Documents are put into ``n_shards`` shards of near equal bytes. The sort key
is the MD5 of the text, so equal texts are neighbours. Driver and executors
only exchange histograms: exact rows and bytes between candidate boundaries
(probes). Each round keeps, for every splitter, the one gap between two probes
that holds its target byte, and probes that gap more finely, until the gap
holds a single group of equal texts. Then all rows are exchanged once.

Rule (independent of partitions and of the order of the input)::

    size   = UTF-8 bytes of the text (null: 0) + 1
    unit   = all rows of equal text; a group larger than ``tolerance`` of a
             shard is not kept whole: there every doc_id is its own unit, and where the
             rows that repeat one doc_id are larger than that, they are divided too
             (not in a table of ``WHOLE_BYTES`` or less)
    order  = whole groups by key, then the rows of large groups by (key, doc_id), then
             the rows of repeated doc_ids that are divided
    shard  = floor(n_shards * (bytes before the unit + half its bytes) / all bytes)

So no shard is more than one unit away from ``total / n_shards`` at either
end, and units are at most ``tolerance`` of a shard or one document, but in so small a table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shredkit.llm.frames import fresh, hex_long, quoted, saved, text_or_empty, without

KEY_BITS = 60
PROBES = 4096
PART_BYTES = 32 << 20
MIN_CELL_BITS, MAX_CELL_BITS = 12, 18
#: Pieces that a large group is cut into at most, by doc_id.
MAX_PIECES = 4096
#: Up to so many bytes in all, rows that repeat one doc_id stay one unit: the tolerance is less than a document there.
WHOLE_BYTES = 64 << 10
#: Equal rows (text and doc_id) that are too many for one unit are told apart by so many numbers.
SALTS = 1 << 20
NO_ID = -(1 << 63)


def shard_by_bytes(
    docs: DataFrame,
    n_shards: int = 8,
    tolerance: float = 0.01,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """``docs`` with ``size``, ``shard`` and ``slot`` (gapless from 0 per shard).

    Null texts count as empty ones. Rows without a doc_id come first in their
    group. Rows that repeat one doc_id and text are interchangeable: they get neighbouring
    slots in any order, or places in several shards where they are very many. An empty table gives an empty result. Input columns called
    ``size``, ``shard`` or ``slot`` are replaced.
    """
    docs = without(docs, "size", "shard", "slot")
    h, d, heavy, part = (fresh(docs, n) for n in ("_h", "_d", "_heavy", "_part"))
    rows = docs.select(
        [F.col(quoted(c)) for c in docs.columns]
        + [
            hex_long(text_or_empty(text)).alias(h),
            F.coalesce(F.col(quoted(doc_id)).cast("long"), F.lit(NO_ID)).alias(d),
            (F.octet_length(text_or_empty(text)).cast("long") + 1).alias("size"),
        ]
    )
    keys = saved(rows.select(F.col(h).alias("h"), F.col(d).alias("d"), "size"), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0]
    if not total:
        return docs.select(
            [F.col(quoted(c)) for c in docs.columns]
            + [F.lit(None).cast("long").alias("size"), F.lit(None).cast("int").alias("shard"),
               F.lit(None).cast("long").alias("slot")]
        ).limit(0)

    cell_bits = min(max(math.ceil(math.log2(total / PART_BYTES + 1)), MIN_CELL_BITS), MAX_CELL_BITS)
    large = _large_groups(keys, total, n_shards, tolerance, PART_BYTES)
    hot = _hot_units(keys, large, tolerance * total / n_shards) if total > WHOLE_BYTES else None
    pieces = None
    if hot is not None and not hot.isEmpty():
        pieces = fresh(docs, "_pieces")
        rows = _divided(rows, hot, h, d, pieces)
        keys = rows.select(F.col(h).alias("h"), F.col(d).alias("d"), "size", F.col(pieces).alias("pieces"))
        keys = saved(keys, "shard-keys")
    keys = _parted(keys, large, cell_bits, pieces=pieces and "pieces")
    parts = saved(_offsets(keys), "shard-parts")
    bounds = _splitters(keys, parts, total, n_shards)

    work = _parted(rows, large, cell_bits, h, d, heavy, part, pieces)
    place = F.lit(0)
    start = F.lit(0).cast("long")
    for b in bounds:
        past = _at_or_after(b, F.col(heavy), F.col(h), F.col(d))
        place = place + past.cast("int")
        start = F.when(past, F.lit(b["rows"]).cast("long")).otherwise(start)
    rank = F.row_number().over(Window.partitionBy(heavy, part).orderBy(h, d)) - 1
    offsets = parts.select(
        F.col("heavy").alias(heavy), F.col("part").alias(part), F.col("rows_below").alias(fresh(docs, "_below"))
    )
    below = offsets.columns[-1]
    rn = fresh(docs, "_rank")
    placed = work.withColumn(rn, rank).join(F.broadcast(offsets), [heavy, part])
    return placed.select(
        [F.col(quoted(c)) for c in docs.columns]
        + [F.col("size"), place.alias("shard"),
           (F.col(below) + F.col(rn) - start).cast("long").alias("slot")]
    )


def _large_groups(keys: DataFrame, total: int, n_shards: int, tolerance: float,
                  part_bytes: int) -> DataFrame:
    """Groups of equal text above the tolerance: at most n_shards / tolerance
    of them, each with the doc_id boundaries of its parts."""
    limit = tolerance * total / n_shards
    big = keys.groupBy("h").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > F.lit(limit))
    big = saved(big.withColumnRenamed("h", "big_h"), "shard-large")
    n = min(MAX_PIECES, max(8, math.ceil(total / part_bytes)))
    cuts = [i / n for i in range(1, n)]
    return saved(
        keys.join(F.broadcast(big.select("big_h")), F.col("h") == F.col("big_h"))
        .groupBy("big_h")
        .agg(F.array_distinct(F.percentile_approx("d", cuts, max(1000, 4 * n))).alias("cuts")),
        "shard-cuts",
    )


def _hot_units(keys: DataFrame, large: DataFrame, limit: float) -> DataFrame:
    """(hot_h, hot_d, pieces): repeated doc_ids of large groups whose rows together are above the
    tolerance; at most n_shards / tolerance of them."""
    big = keys.join(F.broadcast(large.select("big_h")), F.col("h") == F.col("big_h"))
    units = big.groupBy("h", "d").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    return saved(units.where((F.col("bytes") > F.lit(limit)) & (F.col("n") > 1)).select(
        F.col("h").alias("hot_h"), F.col("d").alias("hot_d"),
        F.ceil(F.col("bytes") / PART_BYTES).cast("int").alias("pieces")), "shard-hot")


def _divided(rows: DataFrame, hot: DataFrame, h: str, d: str, pieces: str) -> DataFrame:
    """``rows`` with ``pieces`` (null but for hot units). The rows of a hot unit get a number as
    their ``d`` and a key of their own as their ``h``; they are written, so that the numbers hold."""
    hot = hot.withColumnsRenamed({"hot_h": f"{h}_hot", "hot_d": f"{d}_hot", "pieces": pieces})
    marked = rows.join(F.broadcast(hot), (F.col(h) == F.col(f"{h}_hot")) & (F.col(d) == F.col(f"{d}_hot")), "left")
    key = F.shiftrightunsigned(F.xxhash64(f"{h}_hot", f"{d}_hot"), 64 - KEY_BITS)
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS))
    parts = []
    for there in (True, False):
        some = marked.where(F.col(pieces).isNotNull() if there else F.col(pieces).isNull())
        if there:
            some = some.withColumns({h: key, d: number})
        some = some.drop(f"{h}_hot", f"{d}_hot")
        parts.append(saved(some, "shard-divided") if there else some)
    return parts[1].unionByName(parts[0])


def _parted(rows: DataFrame, large: DataFrame, cell_bits: int, h: str = "h", d: str = "d",
            heavy: str = "heavy", part: str = "part", pieces: str | None = None) -> DataFrame:
    """Add (heavy, part): ordered pieces of the key space that one task can sort. Whole groups
    (heavy 0) are cut by key bits, large groups (1) by doc_id, hot units (2) by number."""
    big, cuts = fresh(rows, "_big_h"), fresh(rows, "_cuts")
    large = large.select(F.col("big_h").alias(big), F.col("cuts").alias(cuts))
    out = rows.join(F.broadcast(large), F.col(h) == F.col(big), "left")
    sub = F.size(F.filter(F.col(cuts), lambda c: c < F.col(d)))
    kind = F.col(big).isNotNull().cast("int")
    piece = F.when(F.col(big).isNull(), F.lit(0)).otherwise(sub)
    if pieces:
        kind = F.when(F.col(pieces).isNotNull(), 2).otherwise(kind)
        piece = F.when(F.col(pieces).isNotNull(), F.floor(F.col(d) * F.col(pieces) / SALTS).cast("int")).otherwise(piece)
    cell = F.when(kind == 0, F.shiftright(F.col(h), KEY_BITS - cell_bits)).otherwise(F.col(h))
    return out.select(
        [F.col(quoted(c)) for c in rows.columns]
        + [kind.alias(heavy), F.struct(cell.alias("h"), piece.alias("d")).alias(part)]
    )


def _offsets(keys: DataFrame) -> DataFrame:
    """Rows and bytes of every part and before it (at most 2^16 cells, and the
    pieces of the large groups: a bounded table)."""
    by_part = keys.groupBy("heavy", "part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"),
        F.min("h").alias("h0"), F.max("h").alias("h1"), F.min("d").alias("d0"), F.max("d").alias("d1"),
    )
    before = Window.orderBy("heavy", "part").rowsBetween(Window.unboundedPreceding, -1)
    return by_part.select(
        "*",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_below"),
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_below"),
    )


def _splitters(keys: DataFrame, parts: DataFrame, total: int, n_shards: int) -> list[dict]:
    """For every inner shard boundary the first unit that belongs behind it."""
    gaps: dict[int, dict] = {}
    inside = F.lit(False)
    for j in range(1, n_shards):
        t = j * total // n_shards
        inside = inside | ((F.col("bytes_below") <= t) & (F.col("bytes_below") + F.col("bytes") > t))
    found = [r.asDict() for r in parts.where(inside).drop("part").collect()]
    for j in range(1, n_shards):
        t = j * total // n_shards
        gaps[j] = next(g for g in found if g["bytes_below"] <= t < g["bytes_below"] + g["bytes"])
    while opened := {j: g for j, g in gaps.items() if not _single(g)}:
        counted = _probe(keys, opened)
        for j, g in opened.items():
            t = j * total // n_shards
            rows, size = g["rows_below"], g["bytes_below"]
            for r in counted[j]:
                if t < size + r["bytes"]:
                    gaps[j] = r | {"heavy": g["heavy"], "rows_below": rows, "bytes_below": size}
                    break
                rows, size = rows + r["n"], size + r["bytes"]
    out = []
    for j in range(1, n_shards):
        g = gaps[j]
        here = n_shards * (2 * g["bytes_below"] + g["bytes"]) >= 2 * j * total
        out.append({"heavy": g["heavy"], "h": g["h0"], "d": g["d0"] if g["heavy"] else None, "here": here,
                    "rows": g["rows_below"] + (0 if here else g["n"])})
    return out


def _single(g: dict) -> bool:
    return g["h0"] == g["h1"] and (not g["heavy"] or g["d0"] == g["d1"])


def _probe(keys: DataFrame, gaps: dict[int, dict]) -> dict[int, list[dict]]:
    """One histogram round: exact rows and bytes between the probes of every open gap."""
    which = F.array(*[
        F.when(
            _within(g),
            F.struct(F.lit(j).alias("j"), _step(g).alias("probe")),
        ) for j, g in sorted(gaps.items())
    ])
    rows = (
        keys.where(_any([_within(g) for g in gaps.values()]))
        .select("h", "d", "size", F.explode(F.filter(which, lambda x: x.isNotNull())).alias("g"))
        .groupBy("g.j", "g.probe")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("h").alias("h0"),
             F.max("h").alias("h1"), F.min("d").alias("d0"), F.max("d").alias("d1"))
        .collect()  # at most PROBES rows for each open gap
    )
    out: dict[int, list[dict]] = {j: [] for j in gaps}
    for r in sorted(rows, key=lambda r: (r["j"], r["probe"])):
        out[r["j"]].append({k: r[k] for k in ("n", "bytes", "h0", "h1", "d0", "d1")})
    return out


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _within(g: dict) -> Column:
    c = (F.col("heavy") == g["heavy"]) & F.col("h").between(g["h0"], g["h1"])
    return c & F.col("d").between(g["d0"], g["d1"]) if g["heavy"] else c


def _step(g: dict) -> Column:
    """Number of the probe below a row: evenly spaced over the gap's key range."""
    x, lo, hi = ("d", g["d0"], g["d1"]) if g["heavy"] else ("h", g["h0"], g["h1"])
    width = max(1, -(-(hi - lo + 1) // PROBES))
    return F.floor((F.col(x).cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)"))
                   / F.lit(width).cast("decimal(20,0)")).cast("int")


def _at_or_after(b: dict, heavy: Column, h: Column, d: Column) -> Column:
    """Is a row at the boundary unit (or only behind it) in the global order?"""
    if not b["heavy"]:
        same = (h >= b["h"]) if b["here"] else (h > b["h"])
        return (heavy > 0) | same
    last = (d >= b["d"]) if b["here"] else (d > b["d"])
    return (heavy > b["heavy"]) | ((heavy == b["heavy"]) & ((h > b["h"]) | ((h == b["h"]) & last)))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder per shard, rows of a shard in slot order within each file."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
