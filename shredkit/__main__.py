"""Command-line entry point (for ``spark-submit``): ingest JSON files into tables.

    spark-submit --py-files shredkit.zip -m shredkit ingest s3://b/in/ \
        --table docs --id doc_id --date-field created_at

The session comes from ``build_session`` (cluster settings from spark-submit
win); tables land in the session catalog, optionally under ``--location``.
"""

from __future__ import annotations

import argparse
import json

from shredkit.config import FlattenOptions, IngestConfig
from shredkit.constants import DATE_FORMAT
from shredkit.operators.ingest import ingest_batch, ingest_mapped
from shredkit.operators.tables import qualified_name
from shredkit.plans.schema import load_mappings
from shredkit.session import build_session
from shredkit.sources.arrays import read_json_arrays
from shredkit.sources.json import read_json_files
from shredkit.streaming.ingest import ingest_stream, ingest_text_stream


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="shredkit")
    sub = ap.add_subparsers(dest="cmd", required=True)
    ing = sub.add_parser("ingest", help="flatten JSON files and upsert the table family")
    ing.add_argument("path")
    ing.add_argument("--table", required=True)
    ing.add_argument("--id", dest="id_field")
    ing.add_argument("--date-field")
    ing.add_argument("--date-format", default=DATE_FORMAT)
    ing.add_argument("--location")
    ing.add_argument("--catalog")
    ing.add_argument("--database")
    ing.add_argument("--jsonl", action="store_true", help="one document per line")
    ing.add_argument("--wholetext", action="store_true")
    ing.add_argument("--flat", action="store_true", help="save the frame as is (no flatten)")
    ing.add_argument("--stream", action="store_true", help="keep ingesting new files")
    ing.add_argument("--drift", action="store_true", help="with --stream: infer the schema of every batch")
    ing.add_argument("--arrays", action="store_true", help="each file is one array, read in byte ranges")
    ing.add_argument("--mapping", help="YAML file of (sourcePath, targetColumn, dataType) entries per table")
    ing.add_argument("--on-duplicate", default="error", choices=["error", "latest", "allow"])
    ing.add_argument("--latest-by")
    a = ap.parse_args(argv)

    spark = build_session(app_name="shredkit-ingest")
    table = qualified_name(a.table, a.catalog, a.database)
    cfg = IngestConfig(table=table, id_field=a.id_field, date_field=a.date_field,
                       date_format=a.date_format, file_path=a.path,
                       use_recursive=not a.flat, on_duplicate=a.on_duplicate,
                       latest_by=a.latest_by, location=a.location,
                       options=FlattenOptions())
    if a.stream and a.drift:
        ingest_text_stream(spark, a.path, cfg, available_now=False, processing_time="1 minute",
                           multiline=not a.jsonl).awaitTermination()
        return 0
    if a.stream:
        q = ingest_stream(spark, a.path, None, cfg, available_now=False,
                          processing_time="1 minute", multiline=not a.jsonl)
        q.awaitTermination()
        return 0
    if a.arrays:
        docs = read_json_arrays(spark, a.path)
    else:
        docs = read_json_files(spark, a.path, multiline=not a.jsonl, wholetext=a.wholetext)
    if a.mapping:
        done = ingest_mapped(docs, load_mappings(a.mapping), cfg)
    else:
        done = ingest_batch(docs, cfg)
    print(json.dumps({"tables": done}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
