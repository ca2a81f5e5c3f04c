"""Hex text payloads (S6): files or columns of hex digits decoded to bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shredkit.functions.names import col
from shredkit.functions.text import decode_hex


def decode_hex_column(df: DataFrame, column: str, prefix_len: int = 0,
                      strict: bool = True, out: str | None = None) -> DataFrame:
    """Replace (or add as ``out``) a column of hex text by its bytes."""
    return df.withColumn(out or column, decode_hex(col(column), prefix_len, strict))


def read_hex_files(spark: SparkSession, path: str, prefix_len: int = 0,
                   strict: bool = True) -> DataFrame:
    """One row per file: ``path``, ``payload`` bytes (lines trimmed and joined)."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"),
                      decode_hex(F.col("value"), prefix_len, strict).alias("payload"))
