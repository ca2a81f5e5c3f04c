"""Recursive flatten: one main table plus one child table per nested field.

The walk runs over the schema on the driver and builds one lazy DataFrame per
output table; no table data moves until a table is written or collected. Per
table:

* main      -- top-level scalars (maps count as scalars) + ``id_hash_col``.
* record    -- for a struct, or an array of structs: ``parent_id``, the
               record's scalar fields, ``content_hash_id``, ``parent_id_hash_col``;
               deduplicated on ``(parent_id, content_hash_id)``.
* value     -- for an array of anything else: ``parent_id``, ``value``, hashes.
* row index -- a record with no scalar field: ``parent_id``, ``_row_idx`` 1..n.

``parent_id`` is the *root* document id at every depth, so every child joins
straight to the main table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DataType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)

from shredkit.config import FlattenOptions
from shredkit.constants import (
    CONTENT_HASH,
    ID_HASH,
    INNER_MANAGED,
    MANAGED,
    ORDINAL,
    PARENT_ID,
    PARENT_ID_HASH,
    ROW_IDX,
    VALUE,
)
from shredkit.functions.hashing import content_hash, key_hash
from shredkit.functions.names import child_name, col
from shredkit.plans import jsoncols
from shredkit.plans.schema import has_map

# Row indices for records without scalars are generated in chunks of this many
# per task, so one parent holding a third of all records still spreads out.
ROW_INDEX_CHUNK = 4096

_ELEM = "__e"
_POS = "__pos"


def is_scalar(dtype: DataType) -> bool:
    return not isinstance(dtype, (ArrayType, StructType))


def select_scalars(df: DataFrame) -> DataFrame:
    """Keep the columns that are neither arrays nor structs."""
    return df.select(*[col(f.name) for f in df.schema.fields if is_scalar(f.dataType)])


def main_table(df: DataFrame, id_field: str, options: FlattenOptions | None = None) -> DataFrame:
    """Main table: top-level scalars and ``id_hash_col = hash(id)``."""
    opts = options or FlattenOptions()
    main = select_scalars(df).withColumn(ID_HASH, key_hash(col(id_field)))
    if not opts.dedup_main:
        return main
    maps = [f.name for f in main.schema.fields if has_map(f.dataType)]
    if not maps:
        return main.dropDuplicates()
    # Maps cannot be grouped by: compare their JSON text with sorted keys instead.
    named = {f"__map{i}": F.to_json(col(m), {"sortKeys": "true"}) for i, m in enumerate(maps)}
    plain = [c for c in main.columns if c not in maps]
    return main.withColumns(named).dropDuplicates([*plain, *named]).drop(*named)


def flatten(
    df: DataFrame,
    id_field: str | None,
    table: str = "main",
    options: FlattenOptions | None = None,
) -> dict[str, DataFrame]:
    """Split a document frame into ``{table_name: DataFrame}``.

    Tables come in the order a depth-first walk meets them: main first, then
    each nested field followed by its own descendants. Building them runs no
    job, except one aggregate that infers JSON held in text (all depths at
    once) when ``promote_json`` is on and no ``json_schemas`` are given.
    """
    opts = options or FlattenOptions()
    out: dict[str, DataFrame] = {}
    fields = [f for f in df.schema.fields if f.name not in MANAGED]

    if (id_field is None or id_field not in df.columns) and len(fields) == 1 \
            and isinstance(fields[0].dataType, ArrayType):
        return _root_array(df, fields[0], table, opts)
    if id_field is None or id_field not in df.columns:
        raise ValueError(f"id field {id_field!r} not in columns {df.columns}")

    out[table] = main_table(df, id_field, opts)
    level = df.select(col(id_field).alias(PARENT_ID), *[col(f.name) for f in fields])
    known: dict = {}
    if opts.promote_json and opts.json_schemas is None:
        # One job finds JSON held in text at every depth of the input schema.
        known["schemas"], known["paths"] = jsoncols.infer_nested_json_schemas(
            df.select(*[col(f.name) for f in fields]), opts.map_keys)
    _walk(level, table, "", 1, out, opts, known)
    return out


# --------------------------------------------------------------------------- walk


def _walk(level: DataFrame, table: str, path: str, depth: int,
          out: dict[str, DataFrame], opts: FlattenOptions, known: dict | None = None) -> None:
    """Emit child tables for every nested field of ``level`` (parent_id + fields)."""
    if opts.max_depth is not None and depth > opts.max_depth:
        return
    level = _promote_level(level, path, opts, known or {})
    for f in level.schema.fields:
        if f.name in (PARENT_ID, ORDINAL):
            continue
        dtype = f.dataType
        name = child_name(table, f.name)
        sub = f"{path}{f.name}"
        if is_scalar(dtype) or not _wanted(sub, opts):
            continue
        if isinstance(dtype, ArrayType):
            elem = dtype.elementType
            if isinstance(elem, StructType):
                # Deeper tables read from the unfiltered elements: a null element
                # yields null nested fields, which explode to nothing anyway, and
                # without a filter on the whole element Catalyst can prune the
                # sibling fields those tables never read.
                every = _explode(level, f, opts, drop_null=False)
                rec = _explode(level, f, opts)
                rec = rec.select(PARENT_ID, *_ord_in(rec), *_fields_of(F.col(_ELEM), elem))
                t = _record_table(rec, opts)
                if _register(out, name, t, opts):
                    below = every.select(PARENT_ID, *_ord_in(every), *_fields_of(F.col(_ELEM), elem))
                    _walk(below, name, sub + ".", depth + 1, out, opts, known)
            else:
                v = _explode(level, f, opts)
                v = v.select(PARENT_ID, *_ord_in(v), F.col(_ELEM).alias(VALUE))
                _register(out, name, _finish(v, [VALUE], opts), opts)
        elif isinstance(dtype, StructType):
            # Filter on the struct itself *before* expanding it, so an inner field
            # of the same name can't be mistaken for it.
            rec = level.where(col(f.name).isNotNull()).select(
                PARENT_ID, *_ord_in(level), *_fields_of(col(f.name), dtype))
            t = _record_table(rec, opts)
            if _register(out, name, t, opts):
                below = level.select(PARENT_ID, *_ord_in(level), *_fields_of(col(f.name), dtype))
                _walk(below, name, sub + ".", depth + 1, out, opts, known)


def _wanted(path: str, opts: FlattenOptions) -> bool:
    if opts.include is None:
        return True
    return any(p == path or p.startswith(path + ".") for p in opts.include)


def _promote_level(level: DataFrame, path: str, opts: FlattenOptions, known: dict) -> DataFrame:
    strings = [f.name for f in level.schema.fields
               if isinstance(f.dataType, StringType) and f.name not in (PARENT_ID, ORDINAL)]
    if not strings or not opts.promote_json:
        return level
    if opts.json_schemas is not None:  # the caller decides; no inference
        given = opts.json_schemas
        return jsoncols.promote(level, {n: given[path + n] for n in strings if path + n in given})
    schemas = known.get("schemas", {})
    looked = known.get("paths", set())
    found = {n: schemas[path + n] for n in strings if path + n in schemas}
    todo = [n for n in strings if path + n not in looked]
    if todo:  # text that only exists inside parsed JSON: infer it here
        found.update(jsoncols.infer_json_schemas(level, todo, opts.map_keys))
    return jsoncols.promote(level, found)


def _explode(level: DataFrame, f: StructField, opts: FlattenOptions,
             drop_null: bool = True) -> DataFrame:
    """Inner explode: null/empty arrays give no rows (Catalyst pushes that filter
    into the scan). Null elements are dropped when the type allows them."""
    c = col(f.name)
    if opts.keep_ordinal:
        x = level.select(PARENT_ID, *_ord_in(level), F.posexplode(c).alias(_POS, _ELEM))
        x = x.select(PARENT_ID, _next_ord(x).alias(ORDINAL), _ELEM)
    else:
        x = level.select(PARENT_ID, F.explode(c).alias(_ELEM))
    if drop_null and f.dataType.containsNull:
        x = x.where(F.col(_ELEM).isNotNull())
    return x


def _ord_in(df: DataFrame) -> list[str]:
    return [ORDINAL] if ORDINAL in df.columns else []


def _next_ord(x: DataFrame) -> Column:
    pos = F.col(_POS).cast("string")
    if ORDINAL in x.columns:
        return F.concat_ws("/", F.col(ORDINAL), pos)
    return pos


def _fields_of(parent: Column, st: StructType) -> list[Column]:
    """Expand a struct; inner names that clash with managed ones get a ``_`` prefix."""
    out = []
    for sf in st.fields:
        alias = "_" + sf.name if sf.name in INNER_MANAGED else sf.name
        out.append(parent.getField(sf.name).alias(alias))
    return out


def _record_table(rec: DataFrame, opts: FlattenOptions) -> DataFrame:
    scalars = [f.name for f in rec.schema.fields
               if f.name not in (PARENT_ID, ORDINAL) and is_scalar(f.dataType)]
    if scalars:
        return _finish(rec.select(PARENT_ID, *_ord_in(rec), *[col(s) for s in scalars]),
                       scalars, opts)
    return _row_index_table(rec, opts)


def _finish(t: DataFrame, payload: list[str], opts: FlattenOptions) -> DataFrame:
    """Add the content hash, dedup on (parent_id, hash), add the parent hash."""
    types = {f.name: f.dataType for f in t.schema.fields}
    names = [PARENT_ID, *payload, *_ord_in(t)]
    t = t.withColumn(CONTENT_HASH, content_hash([(n, types[n]) for n in names], opts.null_marker))
    return dedup_children(t).withColumn(
        PARENT_ID_HASH, key_hash(F.col(PARENT_ID)))


def dedup_children(t: DataFrame) -> DataFrame:
    """One row per ``(parent_id, content_hash_id)`` (A1).

    Rows that share the key but differ (a separator inside a value, a null
    next to a value that reads like its marker) are one row: later merges go by
    this key. The hash is part of the key, so a parent with a huge share of
    the rows spreads over all reducers, and repeats collapse before the shuffle.
    """
    return t.dropDuplicates([PARENT_ID, CONTENT_HASH])


def _row_index_table(rec: DataFrame, opts: FlattenOptions) -> DataFrame:
    """``_row_idx`` = 1..n per parent, where n counts the parent's records.

    Computed as count-then-generate rather than ``row_number`` over a window:
    the count is a partial aggregate, and the indices are produced in chunks
    spread over tasks, so no task holds a whole parent's records.
    """
    pid_type = rec.schema[PARENT_ID].dataType
    counts = rec.groupBy(PARENT_ID).agg(F.count(F.lit(1)).alias("__n"))
    chunks = counts.select(
        PARENT_ID, "__n",
        F.explode(F.sequence(F.lit(0).cast("long"),
                             F.floor((F.col("__n") - 1) / ROW_INDEX_CHUNK))).alias("__c"))
    chunks = chunks.repartition(PARENT_ID, "__c")
    lo = F.col("__c") * ROW_INDEX_CHUNK + 1
    hi = F.least(F.col("__n"), (F.col("__c") + 1) * ROW_INDEX_CHUNK)
    idx = chunks.select(PARENT_ID, F.explode(F.sequence(lo, hi)).alias(ROW_IDX))
    idx = idx.select(PARENT_ID, F.col(ROW_IDX).cast(IntegerType()).alias(ROW_IDX))
    fields = [(PARENT_ID, pid_type), (ROW_IDX, IntegerType())]
    idx = idx.withColumn(CONTENT_HASH, content_hash(fields, opts.null_marker))
    return idx.withColumn(PARENT_ID_HASH, key_hash(F.col(PARENT_ID)))


def _register(out: dict[str, DataFrame], name: str, t: DataFrame, opts: FlattenOptions) -> bool:
    if name in out:
        raise ValueError(f"two nested paths map to the same child table name {name!r}")
    if opts.skip_empty and t.isEmpty():
        return False
    out[name] = t
    return True


# --------------------------------------------------------------------- root array


def _root_array(df: DataFrame, f: StructField, table: str, opts: FlattenOptions) -> dict:
    """A document that is only an array and has no id.

    Elements of structs become the documents, keyed by the SHA-256 of their
    JSON text (content addressed, stable across runs); identical elements are
    one document. An array of scalars gives a value table keyed by the hash of
    the whole row.
    """
    elem = f.dataType.elementType
    if isinstance(elem, StructType):
        x = df.select(F.explode(col(f.name)).alias(_ELEM))
        if f.dataType.containsNull:
            x = x.where(F.col(_ELEM).isNotNull())
        docs = x.select(F.sha2(F.to_json(F.col(_ELEM)), 256).alias(PARENT_ID), F.col(_ELEM))
        docs = docs.dropDuplicates([PARENT_ID]).select(PARENT_ID, *_fields_of(F.col(_ELEM), elem))
        return flatten(docs, PARENT_ID, table, opts)
    level = df.select(F.sha2(F.to_json(F.struct(*[col(c) for c in df.columns])), 256)
                      .alias(PARENT_ID), col(f.name))
    x = _explode(level, f, opts)
    v = x.select(PARENT_ID, *_ord_in(x), F.col(_ELEM).alias(VALUE))
    return {table: _finish(v, [VALUE], opts)}


# ------------------------------------------------------------------ single steps
# The walk above composes these; they are public for callers that want one
# child table without the whole family.


def expand_struct(df: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
    """``select(keep..., column.*)`` with managed inner names prefixed."""
    st = df.schema[column].dataType
    return df.select(*[col(k) for k in (keep or [])], *_fields_of(col(column), st))


def struct_child(df: DataFrame, id_field: str, column: str,
                 options: FlattenOptions | None = None) -> DataFrame:
    """The child table of one struct column."""
    opts = options or FlattenOptions(promote_json=False)
    level = df.select(col(id_field).alias(PARENT_ID), col(column))
    rec = level.where(col(column).isNotNull()).select(
        PARENT_ID, *_fields_of(col(column), df.schema[column].dataType))
    return _record_table(rec, opts)


def explode_struct_child(df: DataFrame, id_field: str, column: str,
                         options: FlattenOptions | None = None) -> DataFrame:
    """The child table of one array-of-struct column."""
    opts = options or FlattenOptions(promote_json=False)
    f = df.schema[column]
    level = df.select(col(id_field).alias(PARENT_ID), col(column))
    x = _explode(level, f, opts)
    rec = x.select(PARENT_ID, *_ord_in(x), *_fields_of(F.col(_ELEM), f.dataType.elementType))
    return _record_table(rec, opts)


def explode_value_child(df: DataFrame, id_field: str, column: str,
                        options: FlattenOptions | None = None) -> DataFrame:
    """The value table of one array-of-scalar column."""
    opts = options or FlattenOptions(promote_json=False)
    f = df.schema[column]
    level = df.select(col(id_field).alias(PARENT_ID), col(column))
    v = _explode(level, f, opts)
    return _finish(v.select(PARENT_ID, *_ord_in(v), F.col(_ELEM).alias(VALUE)), [VALUE], opts)


def unwrap_root_array(df: DataFrame, table: str = "main",
                      options: FlattenOptions | None = None) -> dict[str, DataFrame]:
    """Flatten documents that are a bare array with no id (R2)."""
    fields = [f for f in df.schema.fields if f.name not in MANAGED]
    if len(fields) != 1 or not isinstance(fields[0].dataType, ArrayType):
        raise ValueError("expected a single array column")
    return _root_array(df, fields[0], table, options or FlattenOptions())
