"""Row keys: content hash (SHA-256 of joined text) and Murmur3 key hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from shredkit.constants import HASH_SEPARATOR
from shredkit.functions.names import col


def text_of(c: Column, dtype: DataType) -> Column:
    """Text form used for hashing: JSON for nested values, cast otherwise."""
    if isinstance(dtype, (ArrayType, StructType, MapType)):
        return F.to_json(c)
    return c.cast("string")


def content_hash(
    fields: Sequence[tuple[str, DataType]], null_marker: str | None = None
) -> Column:
    """``sha2(concat_ws('||', text(c1), text(c2), ...), 256)``.

    ``concat_ws`` skips nulls, so by default (a, null, b) hashes like (a, b).
    Pass ``null_marker`` to give nulls a text of their own instead.
    """
    parts = []
    for name, dtype in fields:
        t = text_of(col(name), dtype)
        if null_marker is not None:
            t = F.coalesce(t, F.lit(null_marker))
        parts.append(t)
    return F.sha2(F.concat_ws(HASH_SEPARATOR, *parts), 256)


def key_hash(c: Column) -> Column:
    """Murmur3 32-bit hash, seed 42 (Spark's ``hash``); used for bucketing keys."""
    return F.hash(c)
