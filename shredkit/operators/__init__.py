"""Table operators: keyed upsert, table creation, append, save, batch ingest."""

from shredkit.operators.ingest import ingest_batch, ingest_json_column, ingest_mapped, stage_family
from shredkit.operators.rebuild import rebuild_documents
from shredkit.operators.tables import (
    align_to_table,
    append_table,
    commit,
    create_table,
    evolve_schema,
    finish_commit,
    qualified_name,
    save_table,
    stage_table,
    stream_ledger,
    table_exists,
    upsert_table,
    with_file_key,
)
from shredkit.operators.upsert import dedup_source, merge_upsert

__all__ = [
    "align_to_table",
    "append_table",
    "commit",
    "create_table",
    "dedup_source",
    "evolve_schema",
    "finish_commit",
    "ingest_batch",
    "ingest_json_column",
    "ingest_mapped",
    "merge_upsert",
    "qualified_name",
    "rebuild_documents",
    "save_table",
    "stage_family",
    "stage_table",
    "stream_ledger",
    "table_exists",
    "upsert_table",
    "with_file_key",
]
