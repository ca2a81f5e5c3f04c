"""Promotion of JSON held in string columns.

Schema inference runs on the cluster over *all* candidate rows, every text
field at every depth in one job: each text is parsed once, the distinct types of the
values are merged in tasks (:mod:`shredkit.plans.jsontypes`). Only merged types,
bounded in size whatever keys the data brings, come back to the driver.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from shredkit.constants import INNER_MANAGED, MANAGED
from shredkit.functions.names import col
from shredkit.functions.text import is_json_candidate, is_json_object
from shredkit.plans.jsontypes import MAP_KEYS, VOID, merge, merged_types, ordered, read_tree, to_type

log = logging.getLogger(__name__)

def variant_type(text: str | None, untyped: bool = True) -> DataType | None:
    """The type Spark's JSON reader would infer, from the text of a variant type.

    ``OBJECT<k: BIGINT>`` is a struct; whole numbers beyond 64 bits stay exact
    decimals, fractions are doubles; mixed types and nulls alone are text. An
    object without fields gives nothing (its field is left out), and so does
    ``None``. Field names are read as names, whatever they look like. With
    ``untyped=False`` fields that are only ever null are left out too.
    """
    if text is None or text.strip() in ("", "VOID"):
        return None
    return to_type(read_tree(text), untyped)


def clashing_names(dtype: DataType) -> list[str]:
    """Names that differ only in case inside one record: Spark columns cannot hold both."""
    if isinstance(dtype, ArrayType):
        return clashing_names(dtype.elementType)
    if isinstance(dtype, MapType):
        return clashing_names(dtype.valueType)
    if not isinstance(dtype, StructType):
        return []
    seen: dict[str, str] = {}
    out = []
    for f in dtype.fields:
        if f.name.lower() in seen:
            out.append(f.name)
        seen[f.name.lower()] = f.name
        out += clashing_names(f.dataType)
    return out


def all_names(dtype: DataType) -> set[str]:
    """The names of all fields of a type, at every depth."""
    if isinstance(dtype, ArrayType):
        return all_names(dtype.elementType)
    if isinstance(dtype, MapType):
        return all_names(dtype.valueType)
    if not isinstance(dtype, StructType):
        return set()
    return {f.name for f in dtype.fields}.union(*[all_names(f.dataType) for f in dtype.fields])


def string_columns(df: DataFrame, cols: Iterable[str] | None = None) -> list[str]:
    wanted = set(cols) if cols is not None else None
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, StringType)
        and f.name not in MANAGED
        and (wanted is None or f.name in wanted)
    ]


def infer_json_schemas(df: DataFrame, cols: Iterable[str] | None = None,
                       map_keys: int = MAP_KEYS) -> dict[str, DataType]:
    """Infer a ``from_json`` schema for each string column holding JSON.

    One job for all columns. Objects give a struct; arrays, or objects and
    arrays in one column, give an array (a lone object then reads as an array
    of one); columns with no candidate are left out (they stay text). Objects
    inside with more than ``map_keys`` distinct keys over all rows are maps; a column
    that is itself such an object is a map.
    """
    names = string_columns(df, cols)
    return _infer(df, [(n, col(n), False) for n in names], map_keys)


def string_paths(schema: StructType) -> list[tuple[str, Column, bool]]:
    """Every text field reachable through structs and arrays of structs, as
    ``(dotted path, its value, whether the value is an array of texts)`` --
    below an array of records a field has many values per document.

    Paths use the names the flatten walk gives the fields (managed names get a
    ``_`` prefix below the root). Arrays of text are values, never promoted.
    """
    out: list[tuple[str, Column, bool]] = []

    def walk(st: StructType, prefix: str, expr: Column | None, in_array: bool) -> None:
        for f in st.fields:
            if expr is None:
                if f.name in MANAGED:
                    continue
                name, e = f.name, col(f.name)
            else:
                name = "_" + f.name if f.name in INNER_MANAGED else f.name
                e = expr.getField(f.name)
            t = f.dataType
            if isinstance(t, StringType):
                out.append((prefix + name, e, in_array))
            elif isinstance(t, StructType):
                walk(t, prefix + name + ".", e, in_array)
            elif isinstance(t, ArrayType) and isinstance(t.elementType, StructType):
                arr = F.flatten(F.filter(e, lambda a: a.isNotNull())) if in_array else e
                walk(t.elementType, prefix + name + ".", arr, True)

    walk(schema, "", None, False)
    return out


def infer_nested_json_schemas(df: DataFrame, map_keys: int = MAP_KEYS) -> tuple[dict[str, DataType], set[str]]:
    """Schemas for JSON held in text at *every* depth, in one job.

    Returns ``(schemas by dotted path, all text paths looked at)``; a looked-at
    path without a schema stays text. Text that only appears once a JSON value
    has been parsed (JSON inside JSON) is not covered and is inferred when the
    walk reaches it.
    """
    paths = string_paths(df.schema)
    return _infer(df, paths, map_keys), {p for p, _, _ in paths}


# Text fields inferred per aggregate; very wide schemas take a few jobs rather
# than one aggregate too large to compile.
PATHS_PER_JOB = 64


def _infer(df: DataFrame, paths: list[tuple[str, Column, bool]], map_keys: int) -> dict[str, DataType]:
    out: dict[str, DataType] = {}
    for start in range(0, len(paths), PATHS_PER_JOB):
        out.update(_infer_group(df, paths[start:start + PATHS_PER_JOB], map_keys))
    return out


def _parsed(path: int, texts: Column) -> Column:
    return F.transform(texts, lambda t: F.struct(F.lit(path).alias("path"), F.try_parse_json(t).alias("v")))


def _infer_group(df: DataFrame, paths: list[tuple[str, Column, bool]], map_keys: int) -> dict[str, DataType]:
    """Every candidate text is parsed once; its type goes to a slot of its path: objects,
    arrays, and the records among the elements of arrays."""
    found: list[Column] = []
    for i, (_, value, many) in enumerate(paths):
        texts = value if many else F.array(value)
        found.append(_parsed(i, F.filter(texts, lambda t: is_json_candidate(t))))
    values = df.select(F.explode(F.concat(*[F.coalesce(f, F.array().cast(
        "array<struct<path: int, v: variant>>")) for f in found])).alias("x")).select("x.*").where("v IS NOT NULL")
    kind = F.schema_of_variant("v")
    elements = F.transform(F.try_variant_get("v", "$", "array<variant>"), lambda e: F.schema_of_variant(e))
    records = F.array_distinct(F.filter(elements, lambda t: t.startswith("OBJECT<")))
    typed = values.select("path", kind.alias("kind"), F.when(kind.startswith("ARRAY<"), records).alias("records"))

    def slot(n: int, type_: Column) -> Column:
        return F.struct((F.col("path") * 3 + n).alias("slot"), type_.alias("type"))

    rows = typed.select(F.explode(
        F.when(F.col("kind").startswith("OBJECT<"), F.array(slot(0, F.col("kind"))))
         .when(F.col("kind").startswith("ARRAY<"),
               F.concat(F.array(slot(1, F.col("kind"))), F.transform("records", lambda t: slot(2, t))))).alias("s"))
    trees = merged_types(rows.select("s.*"), map_keys)
    out: dict[str, DataType] = {}
    for i, (path, _, _) in enumerate(paths):
        o_tree, a_tree = trees.get(3 * i), trees.get(3 * i + 1)
        o = to_type(o_tree) if o_tree else None
        a = to_type(a_tree) if a_tree else None
        chosen: DataType | None = o or a
        if o is not None and a is not None:  # both shapes: objects read as arrays of one
            records = to_type(ordered(merge(o_tree, trees.get(3 * i + 2, VOID), map_keys)))
            if isinstance(a, ArrayType) and isinstance(a.elementType, (StructType, MapType)):
                chosen = ArrayType(records)
            else:
                log.warning("%s mixes JSON objects with arrays of other values; it stays text", path)
                chosen = None
        if chosen is not None and (names := clashing_names(chosen)):
            log.warning("%s has keys that differ only in case (%s); it stays text", path, ", ".join(names))
            chosen = None
        if chosen is not None:
            out[path] = chosen
    return out


def promote(df: DataFrame, schemas: dict[str, str | DataType]) -> DataFrame:
    """Replace each named string column by its parsed value.

    Rows that hold no valid JSON of the column's shape become null instead of an all-null
    struct, so they produce no child row, whatever the other rows hold.
    """
    if not schemas:
        return df
    exprs = []
    for f in df.schema.fields:
        c = col(f.name)
        if f.name in schemas and isinstance(f.dataType, StringType):
            s = schemas[f.name]
            # An array schema also reads a lone object, as an array of one.
            shaped = is_json_candidate(c) if _is_array(s) else is_json_object(c)
            c = F.when(shaped & F.try_parse_json(c).isNotNull(), F.from_json(c, s))
        exprs.append(c.alias(f.name))
    return df.select(*exprs)


def _is_array(schema: str | DataType) -> bool:
    if isinstance(schema, DataType):
        return isinstance(schema, ArrayType)
    return schema.strip().upper().startswith("ARRAY<")


def promote_json_columns(
    df: DataFrame, cols: Iterable[str] | None = None, schemas: dict | None = None
) -> DataFrame:
    """Detect and parse JSON text columns (one inference job unless ``schemas``)."""
    if schemas is None:
        schemas = infer_json_schemas(df, cols)
    return promote(df, schemas)


def is_nested(dtype: DataType) -> bool:
    return isinstance(dtype, (ArrayType, StructType))
