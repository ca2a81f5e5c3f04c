"""Frozen configuration objects (the reference mutates a shared bean; we do not)."""

from __future__ import annotations

from dataclasses import dataclass, field

from shredkit.constants import DATE_FORMAT, DEFAULT_BUCKETS, DEFAULT_FILE_PATH, MAP_KEYS


@dataclass(frozen=True)
class FlattenOptions:
    """How a document frame is split into tables.

    null_marker   -- text used for nulls in the content hash; ``None`` keeps the
                     reference behaviour (nulls are skipped, so (a,null,b) and
                     (a,b) collide).
    keep_ordinal  -- keep repeated identical array elements apart by hashing
                     their position as well.
    promote_json  -- detect JSON held in string columns and flatten it too.
    map_keys      -- objects in such text with more distinct keys than this (over all
                     documents) are keyed by data: they become map columns.
    json_schemas  -- precomputed ``{dotted.path: DataType}`` for promotion; when
                     given for a level, no inference job runs for it.
    max_depth     -- stop descending below this depth (root is depth 0).
    include       -- dotted paths of the nested fields to emit (with the
                     fields on the way to them); ``None`` emits all.
    skip_empty    -- drop child tables that turn out empty (runs one cheap
                     ``isEmpty`` job per child; off by default so ``flatten``
                     launches no job).
    dedup_main    -- drop exact duplicate rows of the main table (partial
                     documents carrying the same scalars).
    """

    null_marker: str | None = None
    keep_ordinal: bool = False
    promote_json: bool = True
    json_schemas: dict | None = None
    map_keys: int = MAP_KEYS
    max_depth: int | None = None
    include: tuple[str, ...] | None = None
    skip_empty: bool = False
    dedup_main: bool = False


@dataclass(frozen=True)
class IngestConfig:
    """Ingestion descriptor: table, id, date handling, provenance."""

    table: str
    id_field: str | None
    date_field: str | None = None
    date_format: str = DATE_FORMAT
    file_path: str | None = None
    use_recursive: bool = True
    buckets: int = DEFAULT_BUCKETS
    on_duplicate: str = "error"      # "error" | "latest" | "allow"
    latest_by: str | None = None
    replace_children: bool = False
    # Child tables only get new keys: their key holds the content hash, so a row that
    # is there already is the same row. False (or replace_children) merges instead.
    children_append_only: bool = True
    # Keep the parsed batch on the executors while its tables are written. Turn it off for
    # columnar sources: each table then reads only its own columns of the source.
    persist: bool = True
    location: str | None = None      # root folder for table files; None = warehouse
    options: FlattenOptions = field(default_factory=FlattenOptions)

    @property
    def file_key(self) -> str:
        return self.file_path if self.file_path else DEFAULT_FILE_PATH
