"""Small DataFrame helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shredkit.session import scratch_path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage at files that every executor can reach, so a lost
    executor costs a task and not the work before it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop the columns that an operator is about to produce (any case), so
    that an input column of the same name never makes a reference ambiguous."""
    drop = {n.lower() for n in names}
    return df.select([F.col(quoted(c)) for c in df.columns if c.lower() not in drop])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, name: str) -> str:
    """A working column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"{name}_{uuid.uuid4().hex[:6]}"
    return name


def text_or_empty(col: str | Column) -> Column:
    c = F.col(quoted(col)) if isinstance(col, str) else col
    return F.coalesce(c, F.lit(""))


def hex_long(c: Column, digits: int = 15) -> Column:
    """The first ``digits`` hex digits of the MD5 of a text as a long (15 digits: 60 bits)."""
    return F.conv(F.substring(F.md5(c), 1, digits), 16, 10).cast("long")


def id_text(col: Column, otherwise: Column) -> Column:
    """An id as text; rows without one are told apart by ``otherwise``."""
    return F.coalesce(col.cast("string"), F.concat(F.lit("#"), F.md5(otherwise)))


#: Bits of the membership bitmap over hashed ids: 1 MB when broadcast, whatever the input.
BITMAP_BITS = 23


def only_ids(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """Rows whose id may be among ``ids``: none of those is lost, a few others pass.

    A bitmap of fixed size over hashed ids is broadcast, so rows that a later
    exact join would drop anyway mostly never reach its shuffle.
    """
    bit, bucket, bits = fresh(rows, "_bit"), fresh(rows, "_bucket"), fresh(rows, "_bits")
    place = F.pmod(F.xxhash64(name), F.lit(1 << BITMAP_BITS))
    bitmap = ids.select(place.alias(bit)).groupBy(F.shiftright(bit, 15).alias(bucket)).agg(
        F.expr(f"bitmap_construct_agg({bit} & 32767)").alias(bits)
    )
    bitmap = F.broadcast(saved(bitmap, "bitmap"))  # at most 2^8 rows of 4 KB
    low = F.col(bit).bitwiseAND(32767).cast("int")
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(low, 3) + 1, F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn(bit, place).join(bitmap, F.shiftright(bit, 15) == F.col(bucket))
    return marked.where(F.getbit(byte, low.bitwiseAND(7)) == 1).select([F.col(quoted(c)) for c in rows.columns])
