"""Streaming ingest (ST1): new JSON files become upserts into the table family.

Each micro-batch goes through :func:`ingest_batch` or :func:`ingest_json_column` and is
committed together with its number (the ledger of every table of the family). Spark re-runs
the last micro-batch from the checkpoint after a failure; one that the ledger already
has is skipped, so a replay changes nothing, rows with null ids and corrupt texts included.
The ledger goes by the checkpoint folder: a stream with a new one is another stream.
(V2 catalogs have no ledger here: there a replay is idempotent by its keys alone.)
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from shredkit.config import IngestConfig
from shredkit.operators.ingest import ingest_batch, ingest_json_column
from shredkit.session import scratch_path
from shredkit.sources.json import read_json_files


def stream_key(checkpoint: str) -> str:
    """The name of a stream in the ledger of its tables."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def _start(stream: DataFrame, run, checkpoint: str, available_now: bool, processing_time: str | None) -> StreamingQuery:
    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if processing_time:
        w = w.trigger(processingTime=processing_time)
    elif available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def ingest_stream(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None,
    cfg: IngestConfig,
    checkpoint: str | None = None,
    available_now: bool = True,
    processing_time: str | None = None,
    max_files_per_trigger: int | None = None,
    multiline: bool = True,
) -> StreamingQuery:
    """Start a file-stream ingest of documents of one schema; returns the running query.

    With ``schema=None`` it is inferred once, by a batch read of the files already in
    ``path``; :func:`ingest_text_stream` takes documents whose fields change.
    ``checkpoint`` defaults to a fresh folder under ``spark.checkpoint.dir``.
    """
    if schema is None:
        schema = read_json_files(spark, path, multiline=multiline).schema
    reader = spark.readStream.schema(schema).option("multiLine", multiline)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    checkpoint = checkpoint or scratch_path(spark, "stream-ckpt")
    key = stream_key(checkpoint)

    def run(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, cfg, {key: batch_id})

    return _start(reader.json(path), run, checkpoint, available_now, processing_time)


def ingest_text_stream(
    spark: SparkSession,
    path: str,
    cfg: IngestConfig,
    checkpoint: str | None = None,
    available_now: bool = True,
    processing_time: str | None = None,
    max_files_per_trigger: int | None = None,
    multiline: bool = True,
) -> StreamingQuery:
    """Start an ingest of JSON files whose documents drift; returns the running query.

    The files are read as text (a document, or an array of documents, per file, or per
    line with ``multiline=False``). Every micro-batch infers the schema of its own documents,
    and the tables of the family grow by the fields it brings, nested ones included. A field that
    is null throughout a micro-batch has no type yet and adds no column. Texts that are no
    documents go to ``<table>_corrupt``; they never stop the stream.
    """
    reader = spark.readStream.option("wholetext", multiline)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    checkpoint = checkpoint or scratch_path(spark, "stream-ckpt")
    key = stream_key(checkpoint)

    def run(batch: DataFrame, batch_id: int) -> None:
        texts = batch.where(F.trim("value") != "")
        ingest_json_column(texts, "value", cfg, {key: batch_id}, untyped=False)

    return _start(reader.text(path), run, checkpoint, available_now, processing_time)
