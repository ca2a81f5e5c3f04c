"""Documents put together again from a table family: the reader of what ``flatten`` and ingest wrote.

Every child carries the root document's id, and undated tables of a family are stored in
the same buckets of it. Children are folded into arrays per document and joined to main,
all within the stored buckets: neither table is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from shredkit.constants import CONTENT_HASH, INNER_MANAGED, ORDINAL, PARENT_ID, VALUE
from shredkit.functions.names import child_name, col, quote_name
from shredkit.operators.tables import finish_commit, table_names
from shredkit.plans.flatten import is_scalar

_PLACE = "__place"


def rebuild_documents(spark: SparkSession, table: str, id_field: str, schema: StructType) -> DataFrame:
    """Documents of ``schema`` from the family of ``table``.

    A struct comes back from its one child row, an array from all child rows: in document order
    where the family was written with ``keep_ordinal``, else in the order of their content
    hashes and without the repeats that the child tables do not keep. Nested fields
    of array elements need ``keep_ordinal``, which says to which element they belong. Empty
    arrays and null arrays leave no rows and come back as null; null elements are gone.
    Fields that the family lacks are typed nulls. A recorded commit is finished first, so
    that all tables are of one version.
    """
    finish_commit(spark, table)
    names: dict[str, str] = {}

    def read(logical: str) -> DataFrame | None:
        if logical not in names:
            names.update(table_names(spark, table, [logical]))
        name = quote_name(names[logical])
        return spark.table(name) if spark.catalog.tableExists(name) else None

    return assemble(read, table, id_field, schema)


def assemble(read: Callable[[str], DataFrame | None], table: str, id_field: str, schema: StructType) -> DataFrame:
    """:func:`rebuild_documents` over any source of the family's frames."""
    main = read(table)
    if main is None:
        raise ValueError(f"no table {table!r}")
    out = main
    parts: dict[str, Column] = {}
    for i, f in enumerate(schema.fields):
        if is_scalar(f.dataType):
            known = f.name.lower() in (c.lower() for c in main.columns)
            parts[f.name] = col(f.name) if known else F.lit(None)
            continue
        folded = _folded(read, child_name(table, f.name), f.dataType, ())
        if folded is None:
            parts[f.name] = F.lit(None)
            continue
        key, value = f"__id{i}", f"__v{i}"
        folded = folded.select(F.col(PARENT_ID).alias(key), F.col("__v").alias(value))
        out = out.join(folded, out[id_field] == F.col(key), "left")
        parts[f.name] = F.col(value)
    return out.select(*[parts[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])


def _folded(read: Callable[[str], DataFrame | None], name: str, dtype: DataType,
            above: tuple[str, ...]) -> DataFrame | None:
    """(parent_id, ``above``, __v): a nested field of each record that holds it. ``above`` is
    empty for documents and ``(_PLACE,)`` for array elements, told by their ordinals."""
    rows = read(name)
    if rows is None:
        return None
    many = isinstance(dtype, ArrayType)
    elem = dtype.elementType if many else dtype
    places = ORDINAL in rows.columns
    if above and not places:
        raise ValueError(f"{name}: fields inside array elements need tables written with keep_ordinal")
    if isinstance(elem, StructType):
        rows, value = _record(read, name, rows, elem, many or bool(above))
    else:
        value = F.col(VALUE)
    if above:  # an array in an array adds a step to the ordinal, a struct does not
        upto = F.regexp_replace(ORDINAL, "/[^/]*$", "") if many else F.col(ORDINAL)
        rows = rows.withColumn(_PLACE, upto)
    keys = [PARENT_ID, *above]
    if not many:
        return rows.groupBy(*keys).agg(F.min_by(value, F.col(CONTENT_HASH)).alias("__v"))
    if places:
        order = F.transform(F.split(ORDINAL, "/"), lambda p: p.cast("int"))
    else:
        order = F.col(CONTENT_HASH)
    found = F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col(CONTENT_HASH).alias("h"), value.alias("v"))))
    return rows.groupBy(*keys).agg(F.transform(found, lambda x: x["v"]).alias("__v"))


def _record(read: Callable[[str], DataFrame | None], name: str, rows: DataFrame, st: StructType,
            in_array: bool) -> tuple[DataFrame, Column]:
    """The rows of a record table joined to their nested fields, and the record's value."""
    if not any(is_scalar(f.dataType) for f in st.fields):
        raise ValueError(f"{name}: records without scalar fields are only counted, not kept")
    parts: list[Column] = []
    for i, f in enumerate(st.fields):
        inner = "_" + f.name if f.name in INNER_MANAGED else f.name
        if is_scalar(f.dataType):
            part = col(inner) if inner.lower() in (c.lower() for c in rows.columns) else F.lit(None)
        else:
            folded = _folded(read, child_name(name, inner), f.dataType, (_PLACE,) if in_array else ())
            if folded is None:
                part = F.lit(None)
            else:
                key, at, value = f"__id{i}_{len(name)}", f"__at{i}_{len(name)}", f"__v{i}_{len(name)}"
                folded = folded.withColumnsRenamed({PARENT_ID: key, _PLACE: at, "__v": value})
                same = rows[PARENT_ID] == F.col(key)
                rows = rows.join(folded, same & (rows[ORDINAL] == F.col(at)) if in_array else same, "left").drop(key, at)
                part = F.col(value)
        parts.append(part.cast(f.dataType).alias(f.name))
    return rows, F.struct(*parts)
