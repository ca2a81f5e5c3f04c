"""Catalog tables: create, evolve, align, append, upsert, save.

Two storage paths, chosen once per table by its catalog:

* **V2 catalog with row-level operations** (Iceberg, Delta): ``writeTo(...)
  .partitionedBy(bucket(16, key), days(date)).create()`` and
  ``mergeInto(...)``; the table format rewrites only affected files.
* **Built-in session catalog** (no MERGE): each logical table is a view over one
  physical table ``<name>__s<unique id>``, whose rows lie in *layers*.

A layer is what one write added. The physical table is partitioned by layer and by
unit: the bucket ``pmod(hash(key), 16)`` of the key, or the day where a date field is
given. A write adds a layer; a merge first finds the (layer, unit) partitions that
hold a key of the batch, writes their remaining rows together with the batch as the
next layer, and lists them as dead. Other partitions keep their files, so the cost of a
merge follows the batch and the units it meets. The view names the last committed layer and
the dead partitions, all by partition columns, so Catalyst prunes them, and replacing the
view (one catalog call) is the switch to the new version: readers never see a half-written
state. Dead partitions stay for readers of the version before and are dropped by the
write after. A unit of ``CROWDED`` layers is merged into one by the next write that meets
it. Single writer per table.

Writes are *staged*: :func:`stage_table` writes the layer, :func:`commit` switches the views
of a whole family, after one catalog call has recorded them all, so that a restart
(:func:`finish_commit`) completes the switch of tables that a crash left behind.

The write is a ``rebalance`` on the unit: AQE sizes the write tasks from the
measured shuffle, splitting a hot unit over several tasks and merging small ones, so
files come out near the advisory partition size at any volume. A *dealt* batch (ingest deals
documents by their id over a multiple of the buckets) has one bucket per task already: its
tables are deduplicated, merged and written where the documents lie, without a shuffle of their own.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from shredkit.constants import CONTENT_HASH, DEFAULT_BUCKETS, FILE_KEY, TABLE_PROPERTIES
from shredkit.functions.names import col, quote, quote_name, snake_case_str, split_name
from shredkit.functions.text import parse_date
from shredkit.operators.upsert import _non_null, dedup_source, key_set_bytes, merge_upsert
from shredkit.session import safe_planning, scoped_conf
from shredkit.plans.schema import add_columns_sql, align_schema, missing_fields, widened_schema

_SNAP = "__s"
LAYER = "_shredkit_layer"
BUCKET = "_shredkit_bucket"
DAY = "_shredkit_day"
NO_DAY = "none"
#: Live layers of one unit from which on the next write that meets it merges them.
CROWDED = 16
_PROP_BUCKET = "shredkit.bucket_col"
_PROP_BUCKETS = "shredkit.buckets"
_PROP_DAY = "shredkit.day_col"
_PROP_STORE = "shredkit.store"
_PROP_TABLE = "shredkit.table"
_PROP_PREVIOUS = "shredkit.previous"
_PROP_VERSION = "shredkit.version"
_PROP_DEAD = "shredkit.dead"
_PROP_STREAM = "shredkit.stream."
#: Physical tables are kept small: content hashes hold little that snappy could shorten.
COMPRESSION = "zstd"
#: Rows that are dealt by a part of their key may stay where they lie.
DEALT = {"spark.sql.requireAllClusterKeysForDistribution": "false",
         "spark.sql.requireAllClusterKeysForCoPartition": "false"}


# ------------------------------------------------------------------ names, checks


def qualified_name(name: str | None, catalog: str | None = None, database: str | None = None,
                   default: str = "main") -> str:
    """``catalog.database.table`` (or shorter) with the table part snake-cased."""
    table = snake_case_str(name or default)
    return ".".join(p for p in (catalog, database, table) if p)


def table_exists(spark: SparkSession, name: str) -> bool:
    """Catalog existence check (C1). Errors (unknown catalog, no access) propagate."""
    return spark.catalog.tableExists(quote_name(name))


def table_names(spark: SparkSession, main: str, logical: Sequence[str]) -> dict[str, str]:
    """Catalog names of a table family: ``main`` and children named after it.

    A V2 catalog takes any name, quoted. The built-in catalog only takes
    letters, digits and ``_``: other characters become ``_`` there. Two names that
    become one raise here, before anything is written.
    """
    *place, last = split_name(main)
    v2 = _is_v2(spark, main)
    out: dict[str, str] = {}
    for name in logical:
        own = last + name[len(main):]
        own = quote(own) if v2 else re.sub(r"\W", "_", own)
        out[name] = ".".join([*(quote(p) for p in place), own])
    if len({n.lower() for n in out.values()}) < len(out):
        raise ValueError(f"table names clash in the catalog: {sorted(out.values())}")
    return out


def with_file_key(df: DataFrame, file_key: str | None) -> DataFrame:
    """Provenance literal column ``filekey``."""
    from shredkit.constants import DEFAULT_FILE_PATH

    return df.withColumn(FILE_KEY, F.lit(file_key or DEFAULT_FILE_PATH))


def _is_v2(spark: SparkSession, name: str) -> bool:
    """Is the table in a configured catalog (named first, or the current one)?"""
    parts = split_name(name)
    if len(parts) > 1 and parts[0] != "spark_catalog" and spark.conf.get(f"spark.sql.catalog.{parts[0]}", None):
        return True
    return len(parts) < 3 and spark.catalog.currentCatalog() != "spark_catalog"


def _store_db(spark: SparkSession, name: str, location: str | None) -> str | None:
    """Database holding the physical tables of ``name``.

    With a ``location`` it is a database placed there, so physical tables are
    *managed* tables under that folder: dropping one removes its files.
    Without one, they sit next to the view in the warehouse.
    """
    if not location:
        return ".".join(quote(p) for p in split_name(name)[:-1]) or None
    root = location.rstrip("/")
    db = f"shredkit_store_{zlib.crc32(root.encode()):08x}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db} LOCATION '{root}'")
    return db


def _new_physical_name(name: str, db: str | None) -> str:
    # Unique per attempt: a write that died half way never blocks its retry.
    base = split_name(name)[-1]
    t = f"{base}{_SNAP}{uuid.uuid4().hex[:12]}"
    return f"{db}.{quote(t)}" if db else quote(t)


def _props(spark: SparkSession, table: str) -> dict[str, str]:
    rows = spark.sql(f"SHOW TBLPROPERTIES {quote_name(table)}").collect()
    return {r["key"]: r["value"] for r in rows}


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# ------------------------------------------------------------------ versions


@dataclass(frozen=True)
class Version:
    """What a view shows: the layers up to ``number`` of a physical table without the
    ``dead`` partitions (layer, unit, version that replaced them)."""

    table: str
    number: int
    key: str
    buckets: int
    day: str | None
    store: str | None
    dead: tuple[tuple[str, str, int], ...] = ()
    previous: str | None = None
    streams: Mapping[str, int] = field(default_factory=dict)

    @property
    def unit(self) -> str:
        return DAY if self.day else BUCKET

    def shown(self) -> str:
        """The partitions of this version, as a predicate on partition columns."""
        out = [f"{LAYER} <= '{self.number:08d}~'"]
        by_layer: dict[str, list[str]] = {}
        for layer, unit, _ in self.dead:
            by_layer.setdefault(layer, []).append(unit)
        for layer, units in sorted(by_layer.items()):
            out.append(f"NOT ({LAYER} = '{layer}' AND {self.unit} IN ({self._units(units)}))")
        return " AND ".join(out)

    def _units(self, units: Sequence[str]) -> str:
        return ", ".join(f"'{u}'" if self.day else u for u in sorted(units))

    def partition(self, layer: str, unit: str) -> str:
        return f"PARTITION ({LAYER} = '{layer}', {self.unit} = {self._units([unit])})"

    def next_layer(self) -> str:
        return f"{self.number + 1:08d}_{uuid.uuid4().hex[:8]}"

    def rows(self, spark: SparkSession) -> DataFrame:
        """The rows of this version with their layout columns."""
        return spark.table(self.table).where(self.shown())

    def data(self, spark: SparkSession) -> DataFrame:
        return self.rows(spark).drop(LAYER, BUCKET, DAY)

    def partitions(self, spark: SparkSession) -> list[tuple[str, str]]:
        """All (layer, unit) on disk: catalog metadata, no data is read."""
        out = []
        for r in spark.sql(f"SHOW PARTITIONS {self.table}").collect():
            parts = dict(p.split("=", 1) for p in r[0].split("/"))
            out.append((parts[LAYER], parts[self.unit]))
        return out


@dataclass(frozen=True)
class Staged:
    """A written but not yet visible version of a table."""

    name: str
    switch: str | None = None  # None: a V2 table, visible already
    cleanup: tuple[str, ...] = ()
    created: str | None = None  # the physical table, if this version is its first


def current_version(spark: SparkSession, name: str) -> Version:
    """The version that the view ``name`` shows."""
    view = _props(spark, name)
    table = view[_PROP_TABLE]
    own = _props(spark, table)
    return Version(
        table, int(view[_PROP_VERSION]), own[_PROP_BUCKET], int(own[_PROP_BUCKETS]), own[_PROP_DAY] or None,
        own[_PROP_STORE] or None, tuple(tuple(d) for d in json.loads(view[_PROP_DEAD])),
        view.get(_PROP_PREVIOUS) or None,
        {k[len(_PROP_STREAM):]: int(v) for k, v in view.items() if k.startswith(_PROP_STREAM)},
    )


def stream_ledger(spark: SparkSession, name: str) -> dict[str, int]:
    """The last micro-batch of every stream that is committed in table ``name``."""
    if not table_exists(spark, name) or _is_v2(spark, name):
        return {}
    return dict(current_version(spark, name).streams)


def _staged(spark: SparkSession, name: str, v: Version, cleanup: Sequence[str] = (),
            ledger: Mapping[str, int] | None = None, columns: Sequence[str] | None = None) -> Staged:
    columns = columns or [c for c in spark.table(v.table).columns if c not in (LAYER, BUCKET, DAY)]
    props = {_PROP_TABLE: v.table, _PROP_VERSION: str(v.number), _PROP_DEAD: json.dumps(v.dead)}
    if v.previous:
        props[_PROP_PREVIOUS] = v.previous
    for stream, batch in {**v.streams, **(ledger or {})}.items():
        props[_PROP_STREAM + stream] = str(batch)
    kv = ", ".join(f"{_literal(k)} = {_literal(p)}" for k, p in props.items())
    cols = ", ".join(quote(c) for c in columns)
    return Staged(name, f"CREATE OR REPLACE VIEW {quote_name(name)} TBLPROPERTIES ({kv}) "
                        f"AS SELECT {cols} FROM {v.table} WHERE {v.shown()}", tuple(cleanup),
                  v.table if v.number == 1 else None)


def discard(spark: SparkSession, staged: Staged) -> None:
    """Forget a staged version. A first one takes its physical table with it; of a later one the
    next write drops what it left."""
    if staged.created:
        spark.sql(f"DROP TABLE IF EXISTS {staged.created}")


def _switch(spark: SparkSession, staged: Staged) -> None:
    if staged.switch:
        spark.sql(staged.switch)
    for statement in staged.cleanup:
        spark.sql(statement)


def _record_name(main: str) -> str:
    *place, last = split_name(main)
    return ".".join(quote(p) for p in (*place, f"{last}__commit"))


def commit(spark: SparkSession, staged: Sequence[Staged], main: str | None = None) -> None:
    """Make staged versions visible.

    One table switches in one catalog call. For a family (``main`` given) the call that
    creates the record ``<main>__commit`` is the commit: from then on
    :func:`finish_commit` completes the switches, whatever happens to this process.
    """
    todo = [s for s in staged if s.switch]
    record = _record_name(main) if main and len(todo) > 1 else None
    if record:
        rows = [(t, s) for t, st in enumerate(todo) for s in (st.switch, *st.cleanup)]
        values = ", ".join(f"({i}, {_literal(s)})" for i, (_, s) in enumerate(rows))
        spark.sql(f"CREATE OR REPLACE VIEW {record} AS SELECT * FROM VALUES {values} AS t(step, statement)")
    for st in todo:
        _switch(spark, st)
    if record:
        spark.sql(f"DROP VIEW IF EXISTS {record}")


def finish_commit(spark: SparkSession, main: str) -> bool:
    """Complete a recorded commit of the family ``main`` that a crash cut off."""
    if _is_v2(spark, main) or not table_exists(spark, record := _record_name(main)):
        return False
    for r in sorted(spark.table(record).collect()):  # a few statements per table
        spark.sql(r["statement"])
    spark.sql(f"DROP VIEW IF EXISTS {record}")
    return True


# ------------------------------------------------------------------ create / write


def create_table(
    df: DataFrame,
    name: str,
    bucket_col: str,
    date_col: str | None = None,
    buckets: int = DEFAULT_BUCKETS,
    properties: dict[str, str] | None = None,
    location: str | None = None,
) -> None:
    """Create a table bucketed on ``bucket_col``, or partitioned by day of ``date_col`` (K1)."""
    commit(df.sparkSession, [_stage_create(df, name, bucket_col, date_col, buckets, properties, location)])


def _stage_create(df: DataFrame, name: str, bucket_col: str, date_col: str | None = None,
                  buckets: int = DEFAULT_BUCKETS, properties: dict[str, str] | None = None,
                  location: str | None = None, ledger: Mapping[str, int] | None = None,
                  dealt: bool = False) -> Staged:
    spark = df.sparkSession
    props = {**TABLE_PROPERTIES, **(properties or {})}
    if _is_v2(spark, name):
        parts = [F.partitioning.bucket(buckets, col(bucket_col))]
        if date_col:
            parts.append(F.partitioning.days(col(date_col)))
        w = df.writeTo(quote_name(name)).using(props.pop("provider", "iceberg")).partitionedBy(*parts)
        for k, v in props.items():
            w = w.tableProperty(k, v)
        w.create()
        return Staged(name)
    store = _store_db(spark, name, location)
    v = Version(_new_physical_name(name, store), 0, bucket_col, buckets, date_col, store)
    return _staged(spark, name, _write_layer(df, v, dealt=dealt), ledger=ledger)


def _bucket_of(bucket_col: str, buckets: int) -> Column:
    return F.pmod(F.hash(col(bucket_col)), F.lit(buckets))


def _write_layer(df: DataFrame, v: Version, dead: Sequence[tuple[str, str]] = (), dealt: bool = False) -> Version:
    """Write rows as the next layer (the first one creates the physical table);
    ``dead`` are the partitions whose remaining rows it holds. ``dealt`` rows lie by bucket already."""
    spark = df.sparkSession
    for c in df.columns:
        if c.lower() in (LAYER, BUCKET, DAY):
            raise ValueError(f"the column name {c} is reserved for the table layout")
    unit = F.coalesce(F.to_date(col(v.day)).cast("string"), F.lit(NO_DAY)) if v.day else _bucket_of(v.key, v.buckets)
    df = df.withColumn(LAYER, F.lit(v.next_layer())).withColumn(v.unit, unit)
    new = v.number == 0 or not table_exists(spark, v.table)
    if not new:
        df = df.select(*[col(c) for c in spark.table(v.table).columns])
    # Rebalance on the unit: AQE sizes the write tasks from the measured shuffle (splitting a
    # hot unit, merging small ones), so each task writes about one file of the advisory size
    # whatever the data volume.
    if v.day or not dealt:
        df = df.hint("rebalance", v.unit)
    if v.day:
        df = df.sortWithinPartitions(F.col(v.unit), col(v.key))
    if new:
        w = df.write.format("parquet").mode("errorifexists").partitionBy(LAYER, v.unit).option("compression", COMPRESSION)
        # The unit of an undated table is Spark's own bucket number of the key: with the bucket
        # spec the table reads as hash-partitioned by it (a join of a family needs no shuffle), at
        # no further files. Scans that gain nothing from it are split by size as ever.
        w = w if v.day else w.bucketBy(v.buckets, v.key).sortBy(v.key)
        w.saveAsTable(v.table)
        meta = {_PROP_BUCKET: v.key, _PROP_BUCKETS: str(v.buckets), _PROP_DAY: v.day or "",
                _PROP_STORE: v.store or ""}
        kv = ", ".join(f"'{k}' = {_literal(p)}" for k, p in meta.items())
        spark.sql(f"ALTER TABLE {v.table} SET TBLPROPERTIES ({kv})")
    else:
        df.write.insertInto(v.table)
    spark.catalog.refreshTable(v.table)
    n = v.number + 1
    return Version(v.table, n, v.key, v.buckets, v.day, v.store, (*v.dead, *((*d, n) for d in dead)),
                   v.previous, v.streams)


def _opened(spark: SparkSession, name: str) -> tuple[Version, list[tuple[str, str]], list[str]]:
    """The version to write on, its live partitions, and what to drop after the next switch.

    Layers of writes that never committed are dropped here. Partitions that were dead
    in the version before are not read by anyone once the next one is visible.
    """
    v = current_version(spark, name)
    on_disk = v.partitions(spark)
    lost = [p for p in on_disk if int(p[0].split("_")[0]) > v.number]
    if lost:
        spark.sql(f"ALTER TABLE {v.table} DROP IF EXISTS " + ", ".join(v.partition(*p) for p in lost))
    there = set(on_disk) - set(lost)
    dead = tuple(d for d in v.dead if d[:2] in there)
    cleanup = []
    if dead:
        cleanup.append(f"ALTER TABLE {v.table} DROP IF EXISTS " + ", ".join(v.partition(*d[:2]) for d in dead))
    if v.previous:
        cleanup.append(f"DROP TABLE IF EXISTS {v.previous}")
    v = Version(v.table, v.number, v.key, v.buckets, v.day, v.store, dead, None, v.streams)
    return v, sorted(there - {d[:2] for d in dead}), cleanup


def _crowded(live: Sequence[tuple[str, str]]) -> set[tuple[str, str]]:
    layers = Counter(unit for _, unit in live)
    return {(layer, unit) for layer, unit in live if layers[unit] >= CROWDED}


def _among(v: Version, partitions: Sequence[tuple[str, str]]) -> Column:
    by_layer: dict[str, list[str]] = {}
    for layer, unit in partitions:
        by_layer.setdefault(layer, []).append(unit)
    cond = F.lit(False)
    for layer, units in sorted(by_layer.items()):
        cond = cond | ((F.col(LAYER) == layer) & F.col(v.unit).isin([u if v.day else int(u) for u in units]))
    return cond


# ------------------------------------------------------------------ evolve / align


def evolve_schema(spark: SparkSession, name: str, new_schema: StructType) -> list[str]:
    """Add columns of ``new_schema`` missing from table ``name`` (C2), and fields missing inside
    its structs; returns the names of the columns that were added or widened."""
    current = spark.table(quote_name(name)).schema
    target = widened_schema(current, new_schema)
    add = missing_fields(current, target)
    deep = [f.name for f, g in zip(current.fields, target.fields) if f.dataType != g.dataType]
    if _is_v2(spark, name):
        if add:
            spark.sql(add_columns_sql(quote_name(name), add))
        for statement in _v2_nested_sql(name, current, target):
            spark.sql(statement)
    elif deep:
        v, _, cleanup = _opened(spark, name)
        commit(spark, [_staged(spark, name, *_moved(v.data(spark), v, target, cleanup))])
    elif add:
        v, _, cleanup = _opened(spark, name)
        _add_columns(spark, v, target)
        commit(spark, [_staged(spark, name, v, cleanup)])
    return [f.name for f in add] + deep


def _v2_nested_sql(name: str, current: StructType, target: StructType) -> list[str]:
    """``ADD COLUMNS`` with paths for the fields that structs of a V2 table lack."""
    from shredkit.plans.schema import nested_additions

    return [f"ALTER TABLE {quote_name(name)} ADD COLUMNS ({'.'.join(quote(p) for p in path)} {t.simpleString()})"
            for path, t in nested_additions(current, target)]


def _add_columns(spark: SparkSession, v: Version, target: StructType) -> None:
    """Give the physical table the columns it lacks; the view does not show them yet."""
    add = missing_fields(spark.table(v.table).schema, target)
    if add:
        spark.sql(add_columns_sql(v.table, add))
        spark.catalog.refreshTable(v.table)


def _moved(rows: DataFrame, v: Version, target: StructType, cleanup: list[str]) -> tuple[Version, list[str]]:
    """All rows in a new physical table: the built-in catalog cannot change a column's type,
    so fields added inside structs take one rewrite (old rows get typed nulls)."""
    fresh = Version(_new_physical_name(v.table.replace("`", "").split(".")[-1].split(_SNAP)[0], v.store), v.number,
                    v.key, v.buckets, v.day, v.store, (), v.table, v.streams)
    return _write_layer(align_schema(rows, target), fresh), [c for c in cleanup if c.startswith("DROP TABLE")]


def align_to_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Evolve table ``name`` for ``df``'s new columns, then align ``df`` to it (C4)."""
    evolve_schema(spark, name, df.schema)
    return align_schema(df, spark.table(quote_name(name)).schema)


def append_table(df: DataFrame, name: str, bucket_col: str | None = None) -> None:
    """Append with additive schema evolution (K2). A table that does not exist is
    created, bucketed on ``bucket_col`` (by default the first column)."""
    commit(df.sparkSession, [_stage_append(df, name, bucket_col)])


def _stage_append(df: DataFrame, name: str, bucket_col: str | None = None,
                  ledger: Mapping[str, int] | None = None, dealt: bool = False) -> Staged:
    spark = df.sparkSession
    if not table_exists(spark, name):
        return _stage_create(df, name, bucket_col or df.columns[0], ledger=ledger, dealt=dealt)
    if _is_v2(spark, name):
        align_to_table(spark, df, name).writeTo(quote_name(name)).append()
        return Staged(name)
    v, live, cleanup = _opened(spark, name)
    current = spark.table(quote_name(name)).schema
    target = widened_schema(current, df.schema)
    aligned = align_schema(df, target)
    if _is_deep(current, target):
        rows = align_schema(v.data(spark), target).unionByName(aligned)
        return _staged(spark, name, *_moved(rows, v, target, cleanup), ledger=ledger)
    _add_columns(spark, v, target)
    full = sorted(_crowded(live))
    if full:
        old = v.rows(spark).where(_among(v, full)).drop(LAYER, BUCKET, DAY)
        aligned = aligned.unionByName(align_schema(old, target))
    return _staged(spark, name, _write_layer(aligned, v, full, dealt and not full), cleanup, ledger)


def _is_deep(current: StructType, target: StructType) -> bool:
    return any(f.dataType != g.dataType for f, g in zip(current.fields, target.fields))


MERGE_BROADCAST_BYTES = 64 * 1024 * 1024


def upsert_table(df: DataFrame, name: str, keys: Sequence[str],
                 replace_keys: Sequence[str] | None = None,
                 broadcast_bytes: int = MERGE_BROADCAST_BYTES) -> None:
    """Evolve, align and merge ``df`` into table ``name`` on ``keys`` (K3).

    On the built-in catalog only the partitions that hold a key of the batch are rewritten.
    """
    commit(df.sparkSession, [_stage_upsert(df, name, keys, replace_keys, broadcast_bytes)])


def _stage_upsert(df: DataFrame, name: str, keys: Sequence[str], replace_keys: Sequence[str] | None = None,
                  broadcast_bytes: int = MERGE_BROADCAST_BYTES, ledger: Mapping[str, int] | None = None,
                  dealt: bool = False) -> Staged:
    spark = df.sparkSession
    if not keys:
        raise ValueError("upsert needs at least one key column")
    if _is_v2(spark, name):
        if replace_keys:
            raise ValueError("replace_keys is not supported on V2 catalogs: their MERGE cannot drop "
                             "target rows that only share a part of the key")
        aligned = align_to_table(spark, df, name)
        target = quote(split_name(name)[-1])  # the target is referred to by its table name
        cond = " AND ".join(f"{target}.{quote(k)} = s.{quote(k)}" for k in keys)
        (aligned.alias("s").mergeInto(quote_name(name), F.expr(cond))
                .whenMatched().updateAll().whenNotMatched().insertAll().merge())
        return Staged(name)
    v, live, cleanup = _opened(spark, name)
    current = spark.table(quote_name(name)).schema
    target = widened_schema(current, df.schema)
    on = list(replace_keys or keys)
    # The batch is read several times (measure, key side, rows): compute it once.
    aligned = align_schema(df, target).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        small = key_set_bytes(aligned, on) <= broadcast_bytes
        if _is_deep(current, target):
            merged = merge_upsert(align_schema(v.data(spark), target), aligned, keys, replace_keys, broadcast_keys=small)
            return _staged(spark, name, *_moved(merged, v, target, cleanup), ledger=ledger)
        _add_columns(spark, v, target)
        met = _met_partitions(spark, v, aligned, on, small, dealt)
        hit = sorted(set(met) | _crowded(live))
        rows, left = aligned, _with_survivors(spark, v, hit, met)
        if left:
            old = v.rows(spark).where(_among(v, left)).drop(LAYER, BUCKET, DAY)
            rows = merge_upsert(align_schema(old, target), aligned, keys, replace_keys, broadcast_keys=small)
        return _staged(spark, name, _write_layer(rows, v, hit, dealt and not left), cleanup, ledger)
    finally:
        aligned.unpersist()


def _met_partitions(spark: SparkSession, v: Version, batch: DataFrame, keys: Sequence[str],
                    broadcast_keys: bool, dealt: bool = False) -> dict[tuple[str, str], int]:
    """(layer, unit) of the partitions that hold a key of the batch, with the number of such rows: a
    semi join that reads only key columns; the result is at most the table's partitions."""
    wanted = batch.select(*[col(k) for k in keys]).where(_non_null(keys))
    rows = _met_units(v, v.rows(spark), wanted, keys)
    rows = rows.select(LAYER, v.unit, *[_packed(k, dealt).alias(f"__own{i}") for i, k in enumerate(keys)])
    wanted, same = _key_side(wanted, keys, dealt, [F.col(f"__own{i}") for i in range(len(keys))])
    met = rows.join(F.broadcast(wanted) if broadcast_keys else wanted, same, "left_semi")
    return {(r[0], str(r[1])): r[2] for r in met.groupBy(LAYER, v.unit).agg(F.count(F.lit(1))).collect()}


def _with_survivors(spark: SparkSession, v: Version, hit: Sequence[tuple[str, str]],
                    met: Mapping[tuple[str, str], int]) -> list[tuple[str, str]]:
    """Those of the partitions ``hit`` that hold rows besides the ``met`` ones: only these are
    read again. Row counts come from the files' footers."""
    if not hit:
        return []
    counts = v.rows(spark).where(_among(v, hit)).groupBy(LAYER, v.unit).agg(F.count(F.lit(1))).collect()
    return sorted((r[0], str(r[1])) for r in counts if r[2] > met.get((r[0], str(r[1])), 0))


def _packed(key: str, dealt: bool) -> Column:
    """A key column as it goes through a join's shuffle: the content hashes of ingested children
    (hex text, written by ``flatten`` alone) take half the room as bytes."""
    return F.unhex(col(key)) if dealt and key == CONTENT_HASH else col(key)


def _key_side(df: DataFrame, keys: Sequence[str], dealt: bool, own: Sequence[Column]) -> tuple[DataFrame, Column]:
    """The keys of ``df`` under names of their own, and the condition that they equal ``own``."""
    side = df.select(*[_packed(k, dealt).alias(f"__key{i}") for i, k in enumerate(keys)])
    same = F.lit(True)
    for i, c in enumerate(own):
        same = same & (c == F.col(f"__key{i}"))
    return side, same


def _met_units(v: Version, rows: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the buckets that the wanted keys fall into, where buckets are by one of the keys."""
    if v.day or v.key not in keys:
        return rows
    # at most ``buckets`` numbers: the scan lists only their folders
    met = [r[0] for r in wanted.select(_bucket_of(v.key, v.buckets)).distinct().collect()]
    return rows.where(F.col(BUCKET).isin(met)) if met else rows.where(F.lit(False))


# ------------------------------------------------------------------ save (K4)


def save_table(
    df: DataFrame,
    name: str,
    keys: Sequence[str],
    date_field: str | None = None,
    date_format: str | None = None,
    file_key: str | None = None,
    buckets: int = DEFAULT_BUCKETS,
    on_duplicate: str = "allow",
    latest_by: str | None = None,
    replace_keys: Sequence[str] | None = None,
    location: str | None = None,
    append_only: bool = False,
) -> None:
    """Create the table on first save, else evolve + align + upsert (K4).

    Adds ``filekey``; parses ``date_field`` from text when ``date_format`` is
    given (bad text becomes null) and partitions by its day. With
    ``append_only`` an existing table only receives rows whose keys it lacks
    (no rewrite; rows already there keep their ``filekey``).
    """
    commit(df.sparkSession, [stage_table(df, name, keys, date_field, date_format, file_key, buckets, on_duplicate,
                                         latest_by, replace_keys, location, append_only)])


def stage_table(
    df: DataFrame,
    name: str,
    keys: Sequence[str],
    date_field: str | None = None,
    date_format: str | None = None,
    file_key: str | None = None,
    buckets: int = DEFAULT_BUCKETS,
    on_duplicate: str = "allow",
    latest_by: str | None = None,
    replace_keys: Sequence[str] | None = None,
    location: str | None = None,
    append_only: bool = False,
    ledger: Mapping[str, int] | None = None,
    dealt: bool = False,
) -> Staged:
    """Write what :func:`save_table` saves, without showing it: :func:`commit` does.
    ``ledger`` (stream to micro-batch number) becomes part of the version. ``dealt`` says that
    rows are hash-partitioned by their first key over a multiple of ``buckets``, none of whose
    values is large."""
    if append_only and replace_keys:
        raise ValueError("append_only cannot replace rows")
    spark = df.sparkSession
    df = with_file_key(df, file_key)
    if date_field and date_field in df.columns and date_format \
            and isinstance(df.schema[date_field].dataType, StringType):
        df = df.withColumn(date_field, parse_date(col(date_field), date_format))
    with scoped_conf(spark, safe_planning(spark) | (DEALT if dealt else {})):
        df = dedup_source(df, keys, on_duplicate, latest_by)
        if not table_exists(spark, name):
            return _stage_create(df, name, keys[0], date_field if date_field in df.columns else None,
                                 buckets, location=location, ledger=ledger, dealt=dealt)
        if append_only:
            return _stage_new_rows(df, name, keys, ledger=ledger, dealt=dealt)
        return _stage_upsert(df, name, keys, replace_keys, ledger=ledger, dealt=dealt)


def append_new_rows(df: DataFrame, name: str, keys: Sequence[str],
                    broadcast_bytes: int = MERGE_BROADCAST_BYTES) -> None:
    """Append the rows of ``df`` whose keys are not in table ``name`` yet.

    The cost follows the batch: only the key columns of the buckets that the
    batch meets are read, and while the batch's keys are measured to be
    small they are broadcast to that scan, so the table itself is not shuffled.
    What is left of it (at most the batch's own keys) is anti-joined.
    """
    commit(df.sparkSession, [_stage_new_rows(df, name, keys, broadcast_bytes)])


def _stage_new_rows(df: DataFrame, name: str, keys: Sequence[str], broadcast_bytes: int = MERGE_BROADCAST_BYTES,
                    ledger: Mapping[str, int] | None = None, dealt: bool = False) -> Staged:
    on = list(keys)
    batch = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        known, same = _key_side(_known_keys(batch, name, on, broadcast_bytes), on, dealt, [_packed(k, dealt) for k in on])
        return _stage_append(batch.join(known, same, "left_anti"), name, ledger=ledger, dealt=dealt)
    finally:
        batch.unpersist()


def _known_keys(batch: DataFrame, name: str, keys: list[str], broadcast_bytes: int) -> DataFrame:
    """Keys of the table that also occur in the batch."""
    spark = batch.sparkSession
    wanted = batch.select(*[col(k) for k in keys]).where(_non_null(keys))
    table = spark.table(quote_name(name))
    if not _is_v2(spark, name):
        v = current_version(spark, name)
        table = _met_units(v, v.rows(spark), wanted, keys)
    known = table.select(*[col(k) for k in keys])
    if key_set_bytes(wanted, keys) <= broadcast_bytes:
        known = known.join(F.broadcast(wanted), keys, "left_semi")
    return known
