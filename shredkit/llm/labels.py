"""What both text classifiers share: held-out rows, training sample, scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shredkit.llm.frames import quoted, saved, without


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Is crc32(doc_id as text) mod ``modulus`` the held-out remainder? (null ids: no)"""
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    return F.coalesce(crc % modulus == remainder, F.lit(False))


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int,
                max_docs: int) -> DataFrame:
    """(doc_id, label, text as binary) of at most ``max_docs`` labelled documents
    that are not held out: those with the smallest hashes of their ids.

    Only labels of documents that have a text count (ids alone are joined for that), so
    labels of other documents leave no gaps; the texts are then filtered by a broadcast
    of at most ``max_docs`` ids. A document with several labels counts as 1 if any is;
    of rows that share a doc_id the smallest non-null text is taken.
    """
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)
                        & ~held_out(F.col("doc_id"), modulus, remainder))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    there = docs.where(F.col("text").isNotNull()).select("doc_id")
    chosen = known.join(there, "doc_id", "left_semi").orderBy(
        F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id"
    ).limit(max_docs)
    chosen = saved(chosen, "labels-chosen")
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.where(F.col("text").isNotNull()).groupBy("doc_id", "label").agg(
        F.min("text").cast("binary").alias("text")
    )


def training_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int,
                    max_docs: int, max_bytes: int) -> list[Row]:
    """The sample on the driver, ordered by id: whole texts, at most ``max_bytes``
    together (texts that would pass it are left out, smallest hashes first). A
    text of more than an eighth of ``max_bytes`` is not trained on."""
    rows = saved(sample_rows(docs, labels, label, modulus, remainder, max_docs), "labels-sample")
    rows = within_bytes(rows, max_bytes).select("doc_id", "label", "text")
    return sorted(rows.collect(), key=lambda r: r["doc_id"])


def within_bytes(rows: DataFrame, max_bytes: int) -> DataFrame:
    """The rows (doc_id, text, ...; one per doc_id) that :func:`training_sample` takes.
    Only ids and sizes are summed up in one task, no texts."""
    sizes = rows.select("doc_id", F.octet_length("text").cast("long").alias("size"))
    order = Window.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id")
    fits = sizes.where(F.col("size") <= max_bytes // 8).withColumn("upto", F.sum("size").over(order))
    return rows.join(F.broadcast(fits.where(F.col("upto") <= max_bytes).select("doc_id")), "doc_id")


def score_frame(docs: DataFrame, scores: Callable[[pa.Array], np.ndarray], threshold: float,
                text: str = "text") -> DataFrame:
    """Add ``score`` and ``predicted`` from a function of the text column."""
    docs = without(docs, "score", "predicted")
    at = docs.columns.index(text)
    schema = T.StructType([
        *docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = scores(b.column(at)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())],
                names=[*b.schema.names, "score", "predicted"],
            )

    return docs.select([F.col(quoted(c)) for c in docs.columns]).mapInArrow(run, schema)
