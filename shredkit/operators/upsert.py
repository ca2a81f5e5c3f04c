"""Keyed upsert as a pure DataFrame plan.

``MERGE INTO t USING s ON t.k = s.k WHEN MATCHED UPDATE SET * WHEN NOT MATCHED
INSERT *`` equals: target rows whose key has no match in the source, plus every
source row. Keys compare with plain equality, so a null key never matches and
such rows are both kept, as in MERGE.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from shredkit.functions.names import col
from shredkit.plans.schema import has_map


class DuplicateKeyError(ValueError):
    pass


def _non_null(keys: Sequence[str]):
    cond = F.lit(True)
    for k in keys:
        cond = cond & col(k).isNotNull()
    return cond


def dedup_source(df: DataFrame, keys: Sequence[str], on_duplicate: str = "error",
                 latest_by: str | None = None) -> DataFrame:
    """Make source keys unique before a merge.

    ``error``  -- raise if two rows share a non-null key (one aggregate job).
    ``latest`` -- keep the row with the greatest ``latest_by`` per key, as a
                  partial aggregate (no window, so a hot key is combined map-side).
                  A null ``latest_by`` is older than any value; ties go to the
                  greatest row by its other columns, so the result is deterministic.
    ``allow``  -- no check (the reference's behaviour: duplicates insert twice).
    Rows with a null key are never duplicates of each other.
    """
    if on_duplicate == "allow" or not keys:
        return df
    if on_duplicate == "error":
        dup = (df.where(_non_null(keys)).groupBy(*[col(k) for k in keys])
                 .agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").limit(1).collect())
        if dup:
            raise DuplicateKeyError(f"source has duplicate keys {keys}: {dup[0].asDict()}")
        return df
    if on_duplicate == "latest":
        if not latest_by:
            raise ValueError("on_duplicate='latest' needs latest_by")
        others = [c for c in df.columns if c not in keys]
        keyed = df.where(_non_null(keys))
        # Only the row's comparable columns can break a tie (maps cannot).
        ties = [col(c) for c in others if not has_map(df.schema[c].dataType)]
        rank = F.struct(col(latest_by).isNotNull(), col(latest_by), *ties)
        best = keyed.groupBy(*[col(k) for k in keys]).agg(
            F.max_by(F.struct(*[col(c) for c in others]), rank).alias("__r"))
        best = best.select(*[col(k) for k in keys], "__r.*").select(*[col(c) for c in df.columns])
        return best.unionByName(df.where(~_non_null(keys)))
    raise ValueError(f"unknown on_duplicate {on_duplicate!r}")


_FIXED_WIDTH = {"byte": 1, "short": 2, "integer": 4, "long": 8, "float": 4, "double": 8,
                "date": 4, "timestamp": 8, "timestamp_ntz": 8, "boolean": 1}


def key_set_bytes(source: DataFrame, keys: Sequence[str]) -> int:
    """Upper bound of the in-memory size of the source's key set (one small job).

    Counts the rows and takes the longest text of each string key; fixed-width
    keys count their width. Used to broadcast the keys only with a proven bound.
    """
    types = {f.name: f.dataType for f in source.schema.fields}
    aggs = [F.count(F.lit(1)).alias("__n")]
    width = 16  # per-row overhead of the hashed relation
    for k in keys:
        if isinstance(types[k], (StringType, BinaryType)):
            aggs.append(F.max(F.length(col(k))).alias(f"__w_{k}"))
        else:
            width += _FIXED_WIDTH.get(types[k].typeName(), 16)
    row = source.agg(*aggs).first()
    for k in keys:
        if isinstance(types[k], (StringType, BinaryType)):
            width += 4 * (row[f"__w_{k}"] or 0)  # up to 4 bytes per character
    return int(row["__n"]) * width


def merge_upsert(target: DataFrame, source: DataFrame, keys: Sequence[str],
                 replace_keys: Sequence[str] | None = None,
                 broadcast_keys: bool = False) -> DataFrame:
    """``target`` updated by ``source`` on ``keys``: anti join + union by name.

    Columns present on one side only are null-filled on the other. With
    ``replace_keys`` (for example ``[parent_id]`` on a child table), every
    target row whose ``replace_keys`` appear in the source is replaced, so
    records that vanished from a re-sent document vanish from the table too.
    Otherwise the key side is broadcast only when ``broadcast_keys`` says its
    size was measured under the limit; AQE may still broadcast it at run time.
    """
    if not keys:
        raise ValueError("merge needs at least one key column")
    drop_on = list(replace_keys or keys)
    # A semi-distinct key set keeps the join side small; Spark broadcasts it
    # only when its measured size is under the broadcast threshold.
    src_keys = source.select(*[col(k) for k in drop_on]).where(_non_null(drop_on))
    if replace_keys:
        src_keys = src_keys.distinct()
        if not broadcast_keys:
            # The distinct's own shuffle would keep AQE from splitting a hot
            # parent of the target; dealt out anew, both sides are plain exchanges.
            src_keys = src_keys.repartition(*[col(k) for k in drop_on])
    if broadcast_keys:
        # Only when the caller measured the key set (key_set_bytes): the large
        # target is then filtered where it is read, with no shuffle of it.
        src_keys = F.broadcast(src_keys)
    kept = target.join(src_keys, on=drop_on, how="left_anti")
    return kept.unionByName(source, allowMissingColumns=True)
