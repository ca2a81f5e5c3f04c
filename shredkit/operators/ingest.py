"""Batch ingest (K5): parse, flatten, save every table, switch the family at once.

Every table of the family is written first; one catalog call then records the commit
and the views are switched. A crash before the record leaves readers on the family as it
was, a crash after it is completed by the next ingest (or :func:`finish_commit`).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

from shredkit.config import IngestConfig
from shredkit.constants import CONTENT_HASH, PARENT_ID, ROW_IDX
from shredkit.functions.names import col, quote_name
from shredkit.operators.tables import (
    Staged,
    commit,
    discard,
    finish_commit,
    stage_table,
    stream_ledger,
    table_exists,
    table_names,
)
from shredkit.plans.flatten import flatten
from shredkit.plans.schema import as_mapping, project_mapping
from shredkit.session import parallelism, safe_planning, scoped_conf
from shredkit.sources.json import CORRUPT, parse_json_column


#: Text bytes of the documents that one task of a dealt batch holds. An id with more documents than
#: that, and with several times a task's share, is hot: its batch is not dealt by id.
DEAL_BYTES = 64 * 1024 * 1024


@dataclass
class _Batch:
    """A persisted batch. ``dealt``: by its id, over a multiple of the tables' buckets."""

    df: DataFrame
    dealt: bool
    caches: list[DataFrame]  # what was persisted here, in the order in which it is read
    spare: DataFrame | None = None  # the one that is not read once ``df`` is filled

    def filled(self) -> None:
        if self.spare:
            self.spare.unpersist()
            self.caches.remove(self.spare)
            self.spare = None

    def release(self) -> None:
        for df in self.caches:
            df.unpersist()


def _persist_spread(df: DataFrame, id_field: str | None = None, buckets: int = 1) -> _Batch:
    """Persist the batch, dealt so that every table built from it is written where it lies.

    Documents are dealt by their id once, over a multiple of the tables' buckets: a task then
    holds all documents of its ids and one bucket of every table, so the children, which
    are several times as large, are deduplicated and written without any further
    shuffle. The number of tasks follows the batch's size, which one job measures (it fills
    the cache that the dealing reads from). Where one id holds more than a task should (a hot
    parent spread over many documents), or without an id, the batch is kept as it is, or dealt
    round-robin if it has fewer partitions than cores. A batch that lies so already (after a join
    by the id over a multiple of the buckets) stays where it is; one that the caller persisted is
    not persisted again, and stays.
    """
    want = parallelism(df.sparkSession)
    level = df.storageLevel
    own = not (level.useMemory or level.useDisk)
    kept = df.persist(StorageLevel.MEMORY_AND_DISK) if own else df
    caches = [kept] if own else []
    try:
        have = kept.rdd.getNumPartitions()
    except Exception:  # Spark Connect: no RDD view; keep the source's partitions
        have = want
    tasks, lies = _deal_width(kept, id_field, buckets, want, have) if id_field in kept.columns else (0, False)
    if lies or (not tasks and have >= want):
        return _Batch(kept, lies, caches)
    dealt = kept.repartition(tasks, col(id_field)) if tasks else kept.repartition(want)
    dealt = dealt.persist(StorageLevel.MEMORY_AND_DISK)
    return _Batch(dealt, bool(tasks), [*caches, dealt], kept if own else None)


def _deal_width(df: DataFrame, id_field: str, buckets: int, cores: int, have: int) -> tuple[int, bool]:
    """The number of tasks to deal documents by id over (0 if some id is too large for that), and
    whether they lie so already, in ``have`` partitions that are no larger."""
    size = F.length(F.to_json(F.struct(*[col(c) for c in df.columns]))).cast("long")
    away = F.pmod(F.hash(col(id_field)), F.lit(have)) != F.spark_partition_id()
    seen = df.select(size.alias("size"), away.cast("long").alias("away"))
    total, misplaced = seen.agg(F.sum("size"), F.sum("away")).first()
    total = total or 0
    tasks = buckets * max(1, math.ceil(max(total / DEAL_BYTES, cores) / buckets))
    if total > DEAL_BYTES:
        # A third of the documents may have one id: summed map-side, never brought together.
        largest = df.groupBy(col(id_field)).agg(F.sum(size).alias("size")).agg(F.max("size")).first()[0]
        if largest > max(DEAL_BYTES, 4 * total / tasks):
            return 0, False
    return tasks, not misplaced and have % buckets == 0 and have >= cores and total <= 2 * DEAL_BYTES * have


class _Counted:
    """A frame whose rows are counted by the first job that reads it, not by one of its own."""

    def __init__(self, df: DataFrame):
        self._plain, self._seen = df, Observation()
        self.df = df.observe(self._seen, F.count(F.lit(1)).alias("rows"))

    def any(self) -> bool:
        """Did that job see rows?"""
        try:
            return self._seen.get["rows"] > 0
        except Exception:  # the counter went with a relation that the optimizer found empty
            return not self._plain.isEmpty()


def ingest_batch(df: DataFrame, cfg: IngestConfig, ledger: Mapping[str, int] | None = None) -> list[str]:
    """Flatten one batch of documents and save main and child tables.

    With ``cfg.persist`` the parsed batch is kept (memory, spilling to disk)
    because every output table reads it; a lost executor only recomputes its own
    blocks from lineage. ``ledger`` (stream to micro-batch number) is committed with
    every table, and a micro-batch that the main table already has is skipped.
    Returns the table names written, in write order (none for an empty batch).
    """
    spark = df.sparkSession
    finish_commit(spark, cfg.table)
    if _replayed(spark, cfg.table, ledger):
        return []
    with scoped_conf(spark, safe_planning(spark)):
        staged = stage_family(df, cfg, ledger)
        commit(spark, staged, cfg.table)
    return [s.name for s in staged]


def _replayed(spark: SparkSession, main: str, ledger: Mapping[str, int] | None) -> bool:
    if not ledger:
        return False
    done = stream_ledger(spark, main)
    return all(done.get(stream, -1) >= batch for stream, batch in ledger.items())


def stage_family(df: DataFrame, cfg: IngestConfig, ledger: Mapping[str, int] | None = None) -> list[Staged]:
    """Write the tables of a batch without showing them: ``commit(spark, staged, cfg.table)`` does."""
    if cfg.id_field is None and len(df.columns) != 1:
        raise ValueError("ingest needs an id field unless the documents are a bare array")
    if not cfg.use_recursive:
        return [stage_table(df, cfg.table, [cfg.id_field], cfg.date_field, cfg.date_format,
                            cfg.file_key, cfg.buckets, cfg.on_duplicate, cfg.latest_by,
                            location=cfg.location, ledger=ledger)]
    batch = _persist_spread(df, cfg.id_field, cfg.buckets) if cfg.persist else _Batch(df, False, [])
    df = batch.df
    try:
        # Empty tables show in the counts of the writes: no job of their own asks for them.
        tables = flatten(df, cfg.id_field, cfg.table, replace(cfg.options, skip_empty=False))
        # All names are settled before the first write: a family is never half written
        # because of a name.
        names = table_names(df.sparkSession, cfg.table, list(tables))
        staged = []
        for logical, t in tables.items():
            name, t = names[logical], _Counted(t)
            if logical == cfg.table:
                key = cfg.id_field if cfg.id_field in t.df.columns else PARENT_ID
                written = stage_table(t.df, name, [key], cfg.date_field, cfg.date_format, cfg.file_key,
                                      cfg.buckets, cfg.on_duplicate, cfg.latest_by, location=cfg.location,
                                      ledger=ledger, dealt=batch.dealt)
                batch.filled()
                if not t.any():  # an idle micro-batch: touches nothing
                    discard(df.sparkSession, written)
                    return []
            else:
                written = stage_table(t.df, name, [PARENT_ID, CONTENT_HASH], file_key=cfg.file_key,
                                      buckets=cfg.buckets, on_duplicate="allow",
                                      replace_keys=[PARENT_ID] if cfg.replace_children else None,
                                      location=cfg.location,
                                      append_only=cfg.children_append_only and not cfg.replace_children,
                                      ledger=ledger, dealt=batch.dealt and ROW_IDX not in t.df.columns)
                if cfg.options.skip_empty and not t.any():
                    discard(df.sparkSession, written)
                    continue
            staged.append(written)
        return staged
    finally:
        batch.release()


def ingest_mapped(df: DataFrame, mappings: Mapping[str, Sequence], cfg: IngestConfig,
                  ledger: Mapping[str, int] | None = None) -> list[str]:
    """Ingest documents by declared mappings instead of by their shape.

    ``mappings`` has, for each table, its (sourcePath, targetColumn, dataType) entries
    (``load_mappings`` reads them from YAML). Every table is keyed by the column that
    ``cfg.id_field`` is mapped to, partitioned by day where ``cfg.date_field`` is one of its columns,
    and evolves by further columns of the mapping; all tables switch together.
    """
    spark = df.sparkSession
    main = cfg.table if cfg.table in mappings else next(iter(mappings), cfg.table)
    finish_commit(spark, main)
    if _replayed(spark, main, ledger):
        return []
    keys = {table: _mapped_key(table, entries, cfg.id_field) for table, entries in mappings.items()}
    with scoped_conf(spark, safe_planning(spark)):
        batch = _persist_spread(df) if cfg.persist else _Batch(df, False, [])
        try:
            staged = [stage_table(project_mapping(batch.df, entries, cfg.date_format), table, [keys[table]],
                                  cfg.date_field, None, cfg.file_key, cfg.buckets, cfg.on_duplicate, cfg.latest_by,
                                  location=cfg.location, ledger=ledger)
                      for table, entries in mappings.items()]
        finally:
            batch.release()
        commit(spark, staged, main)
    return [s.name for s in staged]


def _mapped_key(table: str, entries: Sequence, id_field: str | None) -> str:
    for m in map(as_mapping, entries):
        if id_field and m.source_path.lower() == id_field.lower():
            return m.target_column
    raise ValueError(f"the mapping of {table!r} has no column for the id {id_field!r}")


def _id_type(spark: SparkSession, cfg: IngestConfig) -> DataType:
    if table_exists(spark, cfg.table):
        return spark.table(quote_name(cfg.table)).schema[cfg.id_field].dataType
    return StringType()


def ingest_json_column(df: DataFrame, column: str, cfg: IngestConfig,
                       ledger: Mapping[str, int] | None = None, untyped: bool = True) -> list[str]:
    """Ingest documents held as JSON text in ``column`` (one or an array per row).

    Texts that are no JSON documents go to the side table ``<table>_corrupt``,
    keyed by the hash of their raw text: none is lost, and a second ingest of
    the same text adds nothing. It is part of the family: all tables switch together.
    A field that is null in every document becomes a text column, or none with
    ``untyped=False`` (a later batch may know its type).
    """
    spark = df.sparkSession
    finish_commit(spark, cfg.table)
    side = f"{cfg.table}_corrupt"
    if _replayed(spark, cfg.table, ledger) or _replayed(spark, side, ledger):
        return []
    with scoped_conf(spark, safe_planning(spark)):
        parsed = parse_json_column(df, column, untyped=untyped)
        bad = parsed.where(F.col(CORRUPT).isNotNull())
        bad = bad.select(F.sha2(CORRUPT, 256).alias(CONTENT_HASH), CORRUPT).dropDuplicates([CONTENT_HASH])
        good = parsed.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
        staged = []
        if set(good.columns) != set(df.columns) - {column}:  # some text holds a document
            if cfg.id_field and cfg.id_field not in good.columns:  # no document has an id
                good = good.withColumn(cfg.id_field, F.lit(None).cast(_id_type(spark, cfg)))
            staged = stage_family(good, cfg, ledger)
        if not bad.isEmpty():
            staged.append(stage_table(bad, side, [CONTENT_HASH], file_key=cfg.file_key, buckets=cfg.buckets,
                                      location=cfg.location, append_only=True, ledger=ledger))
        commit(spark, staged, cfg.table)
    return [s.name for s in staged]
