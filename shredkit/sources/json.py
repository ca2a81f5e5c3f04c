"""JSON sources."""

from __future__ import annotations

import json
import logging
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from shredkit.functions.names import col
from shredkit.plans.jsoncols import all_names, clashing_names
from shredkit.plans.jsontypes import MAP_KEYS, merged_types, to_type

log = logging.getLogger(__name__)

CORRUPT = "_corrupt_record"


def read_json_files(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    multiline: bool = True,
    wholetext: bool = False,
    with_file_path: bool = False,
) -> DataFrame:
    """Read JSON files; a top-level array gives one row per element.

    ``wholetext=True`` reads each file as one text value and parses it as a
    column (S3), which is the same result for files holding one document.
    ``with_file_path`` adds the source file of every row as ``_file_path``.
    """
    if wholetext:
        raw = spark.read.text(path, wholetext=True)
        if with_file_path:
            raw = raw.withColumn("_file_path", F.col("_metadata.file_path"))
        return parse_json_column(raw, "value", schema, explode_arrays=True)
    reader = spark.read.option("multiLine", multiline).option("mode", "PERMISSIVE")
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.json(path)
    if with_file_path:
        df = df.withColumn("_file_path", F.col("_metadata.file_path"))
    return df


def infer_document_schema(df: DataFrame, column: str, map_keys: int = MAP_KEYS) -> StructType | None:
    """Schema of JSON documents (objects, or arrays of objects) in a text column.

    Array texts are split into their elements first, so objects and arrays of
    objects merge into one struct schema; texts and elements that are no
    objects have no say in it. Inferred on the cluster in one job; only merged
    types reach the driver. Objects inside the documents that hold more than ``map_keys``
    distinct keys over all of them are maps, so the schema does not grow with the data.
    ``None`` if no text holds an object.
    """
    return _document_schema(df, col(column), True, map_keys)


def _document_schema(df: DataFrame, text: Column, untyped: bool, map_keys: int) -> StructType | None:
    v = F.try_parse_json(text)
    elems = F.when(_is_array_text(text), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
    types = df.select(F.explode(elems).alias("v")).select(F.lit(0).alias("slot"), F.schema_of_variant("v").alias("type"))
    found = merged_types(types.where(F.col("type").startswith("OBJECT<")), map_keys, roots=True)
    if 0 not in found:
        return None
    schema = to_type(found[0], untyped) or to_type(found[0])
    return schema if isinstance(schema, StructType) else None


def _is_array_text(text: Column) -> Column:
    return text.rlike(r"^[\x00-\x20]*\[")


def _folded(text: Column, schema: StructType) -> Column:
    """The text with keys that differ only in case written alike, in the spelling that sorts
    first. A string that a colon follows is a key, so nothing else is touched. A document that
    holds two spellings in one object then repeats a key, which is no valid document."""
    spellings: dict[str, set[str]] = {}
    for name in all_names(schema):
        spellings.setdefault(name.lower(), set()).add(name)
    for lower in sorted({n.lower() for n in clashing_names(schema)}):
        first, *others = sorted(spellings[lower])
        for other in others:
            key = re.escape(json.dumps(other, ensure_ascii=False)[1:-1])
            spelled = json.dumps(first, ensure_ascii=False).replace("\\", "\\\\").replace("$", "\\$")
            text = F.regexp_replace(text, rf'(?<!\\)"{key}"(?=\s*:)', spelled)
    return text


def parse_json_column(
    df: DataFrame,
    column: str,
    schema: StructType | str | None = None,
    explode_arrays: bool = True,
    keep_corrupt: bool = True,
    keep_empty: bool = False,
    untyped: bool = True,
    map_keys: int = MAP_KEYS,
) -> DataFrame:
    """Parse a text column of JSON documents into columns.

    The schema is inferred on the cluster when not given. A text holding an
    array of documents gives one row per element (one parse: an array schema
    also accepts a lone object). What is no document, a text or an element of an array,
    gives one row with its raw form in ``_corrupt_record`` (PERMISSIVE) and the other
    fields null; it changes nothing for its neighbours. Null texts and empty arrays hold no
    document and give no row, or one with all fields null with ``keep_empty``. Fields that
    are null wherever they occur are text, or left out with ``untyped=False``. Objects keyed
    by data (more than ``map_keys`` distinct keys) are map columns.

    Inferred columns ignore case, as Spark's do: keys that differ only in case are one
    column (spelled as the first of them in code-point order), and a document that has
    two of them in one object is corrupt.
    """
    others = [col(c) for c in df.columns if c != column]
    c = text = col(column)
    if schema is None:
        schema = _document_schema(df, c, untyped, map_keys)
        if schema is not None and (names := clashing_names(schema)):
            log.warning("documents in %s have keys that differ only in case: %s", column, ", ".join(names))
            text = _folded(c, schema)
            schema = _document_schema(df, text, untyped, map_keys)
        if schema is None:  # nothing parses as an object: every row keeps its raw text
            return df.select(*others, *([c.alias(CORRUPT)] if keep_corrupt else []))
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    fields = [f for f in schema.fields if f.name != CORRUPT]
    st = StructType(fields)
    if text is not c:  # keys that repeat once folded: no valid document
        text = F.when(F.try_parse_json(text).isNotNull(), text)
    if explode_arrays:
        rows = _documents(c, text, st)
        rows = F.explode_outer(rows) if keep_empty else F.explode(rows)
        x = df.select(*others, rows.alias("__r")).select(
            *others, F.col("__r.bad").alias("__bad"), F.col("__r.doc").alias("__d"))
    else:
        parsed = F.from_json(text, st.add(CORRUPT, StringType()),
                             {"columnNameOfCorruptRecord": CORRUPT})
        bad = F.when(parsed.getField(CORRUPT).isNotNull() | (text.isNull() & c.isNotNull()), c)
        x = df.select(*others, bad.alias("__bad"), parsed.alias("__d"))
    return x.select(*[col(o) for o in df.columns if o != column],
                    *[F.col("__d").getField(f.name).alias(f.name) for f in fields],
                    *([F.col("__bad").alias(CORRUPT)] if keep_corrupt else []))


def _documents(raw: Column, text: Column, st: StructType) -> Column:
    """The documents of a text as an array of (doc, bad); null for a null text.

    Usually one parse with an array schema. Only where that fails is the text split into
    its elements, so that one element that is no document leaves the others alone; an array
    without any document stays whole.
    """
    row = StructType([StructField("doc", st), StructField("bad", StringType())])

    def one(doc: Column, bad: Column) -> Column:
        return F.struct(doc.alias("doc"), bad.cast("string").alias("bad")).cast(row)

    def element(v: Column) -> Column:
        said = F.to_json(v)
        marked = F.from_json(said, StructType([*st.fields, StructField(CORRUPT, StringType())]),
                             {"columnNameOfCorruptRecord": CORRUPT})
        fits = F.schema_of_variant(v).startswith("OBJECT<") & marked.getField(CORRUPT).isNull()
        doc = F.struct(*[marked.getField(f.name).alias(f.name) for f in st.fields])
        return one(F.when(fits, doc), F.when(~fits, said))

    docs = F.from_json(text, ArrayType(st))
    elements = F.when(_is_array_text(text), F.try_variant_get(F.try_parse_json(text), "$", "array<variant>"))
    whole = docs.isNotNull() & ~F.exists(docs, lambda d: d.isNull())
    return F.when(raw.isNull(), F.lit(None)) \
            .when(whole, F.transform(docs, lambda d: one(d, F.lit(None)))) \
            .when(F.exists(elements, lambda v: F.schema_of_variant(v).startswith("OBJECT<")),
                  F.transform(elements, element)) \
            .otherwise(F.array(one(F.lit(None), raw)))
