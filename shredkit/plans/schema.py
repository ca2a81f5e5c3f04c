"""Schema evolution helpers: add-only diff, null-fill alignment, mapped projection."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType

from shredkit.constants import DATE_FORMAT
from shredkit.functions.names import col, quote


def missing_fields(existing: StructType, new: StructType) -> list[StructField]:
    """Fields of ``new`` absent from ``existing`` (names compared ignoring case)."""
    have = {f.name.lower() for f in existing.fields}
    return [f for f in new.fields if f.name.lower() not in have]


def check_compatible(existing: StructType, new: StructType) -> None:
    """Evolution is add-only: a same-named column with another type is an error,
    unless the new type is null (all-null input) or safely castable upward."""
    have = {f.name.lower(): f.dataType for f in existing.fields}
    for f in new.fields:
        old = have.get(f.name.lower())
        if old is None or f.dataType.typeName() == "void":
            continue
        if not assignable(f.dataType, old):
            raise TypeError(
                f"column {f.name!r}: incoming {f.dataType.simpleString()} does not fit "
                f"table type {old.simpleString()} (add-only evolution)")


def widened_schema(existing: StructType, new: StructType) -> StructType:
    """``existing`` with the fields of ``new`` that it lacks, at the top and inside structs
    (also those within arrays and map values). Evolution is add-only: a field of both
    keeps its type, and one that does not fit it raises ``TypeError``."""
    return StructType(_wider(existing, new, "").fields)


def _wider(old: DataType, new: DataType, path: str) -> DataType:
    if isinstance(old, StructType) and isinstance(new, StructType):
        have = {f.name.lower(): f for f in new.fields}
        fields = []
        for f in old.fields:
            g = have.get(f.name.lower())
            kept = f.dataType if g is None else _wider(f.dataType, g.dataType, f"{path}{f.name}.")
            fields.append(f if kept == f.dataType else StructField(f.name, kept, f.nullable, f.metadata))
        known = {f.name.lower() for f in old.fields}
        fields += [StructField(f.name, f.dataType, True) for f in new.fields if f.name.lower() not in known]
        return old if fields == old.fields else StructType(fields)
    if isinstance(old, ArrayType) and isinstance(new, ArrayType):
        elem = _wider(old.elementType, new.elementType, path)
        return old if elem == old.elementType else ArrayType(elem, True)
    if isinstance(old, MapType) and isinstance(new, MapType):
        value = _wider(old.valueType, new.valueType, path)
        if not assignable(new.keyType, old.keyType):
            _misfit(path, new.keyType, old.keyType)
        return old if value == old.valueType else MapType(old.keyType, value, True)
    if new.typeName() != "void" and not assignable(new, old):
        _misfit(path, new, old)
    return old


def _misfit(path: str, new: DataType, old: DataType) -> None:
    raise TypeError(f"column {path.rstrip('.')!r}: incoming {new.simpleString()} does not fit "
                    f"table type {old.simpleString()} (add-only evolution)")


def nested_additions(existing: StructType, target: StructType) -> list[tuple[tuple[str, ...], DataType]]:
    """(path, type) of the fields of ``target`` that structs of ``existing`` lack, below the top;
    array elements and map values are the steps ``element`` and ``value``."""
    out: list[tuple[tuple[str, ...], DataType]] = []

    def walk(old: DataType, new: DataType, path: tuple[str, ...]) -> None:
        if isinstance(old, StructType) and isinstance(new, StructType):
            have = {f.name.lower(): f for f in old.fields}
            for f in new.fields:
                if f.name.lower() in have:
                    walk(have[f.name.lower()].dataType, f.dataType, (*path, f.name))
                elif path:
                    out.append(((*path, f.name), f.dataType))
        elif isinstance(old, ArrayType) and isinstance(new, ArrayType):
            walk(old.elementType, new.elementType, (*path, "element"))
        elif isinstance(old, MapType) and isinstance(new, MapType):
            walk(old.valueType, new.valueType, (*path, "value"))

    walk(existing, target, ())
    return out


def conform(value: Column, src: DataType, dst: DataType) -> Column:
    """A value in the shape of ``dst``: structs are rebuilt by name at every depth (fields they
    lack become typed nulls, a null struct stays null), other values are cast."""
    dst = _nullable(dst)
    if _nullable(src) == dst:
        return value
    if isinstance(src, StructType) and isinstance(dst, StructType):
        have = {f.name.lower(): f for f in src.fields}
        fields = []
        for f in dst.fields:
            g = have.get(f.name.lower())
            part = F.lit(None).cast(f.dataType) if g is None else conform(value.getField(g.name), g.dataType, f.dataType)
            fields.append(part.alias(f.name))
        return F.when(value.isNotNull(), F.struct(*fields)).cast(dst)
    if isinstance(src, ArrayType) and isinstance(dst, ArrayType) and _has_struct(dst.elementType):
        return F.transform(value, lambda e: conform(e, src.elementType, dst.elementType)).cast(dst)
    if isinstance(src, MapType) and isinstance(dst, MapType) and _has_struct(dst.valueType):
        return F.transform_values(value, lambda _, e: conform(e, src.valueType, dst.valueType)).cast(dst)
    return value.cast(dst)


def _nullable(dtype: DataType) -> DataType:
    """The type with nulls allowed everywhere inside."""
    if isinstance(dtype, StructType):
        return StructType([StructField(f.name, _nullable(f.dataType)) for f in dtype.fields])
    if isinstance(dtype, ArrayType):
        return ArrayType(_nullable(dtype.elementType))
    if isinstance(dtype, MapType):
        return MapType(dtype.keyType, _nullable(dtype.valueType))
    return dtype


def _has_struct(dtype: DataType) -> bool:
    if isinstance(dtype, ArrayType):
        return _has_struct(dtype.elementType)
    if isinstance(dtype, MapType):
        return _has_struct(dtype.valueType)
    return isinstance(dtype, StructType)


_NUMBERS = ("byte", "short", "integer", "long", "float", "double", "decimal")
_TIMES = ("date", "timestamp", "timestamp_ntz")


def assignable(src: DataType, dst: DataType) -> bool:
    """Can a value be stored into a column by an ANSI assignment cast?

    Numbers fit any number type (a value out of range raises when it is cast),
    dates and timestamps fit each other, every atomic value fits text; arrays,
    maps and structs by their parts. Whether nulls may occur inside a type
    does not matter.
    """
    s, d = src.typeName(), dst.typeName()
    if isinstance(src, ArrayType) and isinstance(dst, ArrayType):
        return assignable(src.elementType, dst.elementType)
    if isinstance(src, MapType) and isinstance(dst, MapType):
        return assignable(src.keyType, dst.keyType) and assignable(src.valueType, dst.valueType)
    if isinstance(src, StructType) and isinstance(dst, StructType):
        have = {f.name.lower(): f.dataType for f in dst.fields}
        return len(src.fields) == len(dst.fields) and all(
            f.name.lower() in have and assignable(f.dataType, have[f.name.lower()]) for f in src.fields)
    if isinstance(src, (ArrayType, MapType, StructType)) or isinstance(dst, (ArrayType, MapType, StructType)):
        return False
    return (s == d or s == "void" or (s in _NUMBERS and d in _NUMBERS) or (s in _TIMES and d in _TIMES)
            or (d == "string" and s != "binary"))


def has_map(dtype: DataType) -> bool:
    """Does a type hold a map (which can be neither grouped by nor compared)?"""
    if isinstance(dtype, MapType):
        return True
    if isinstance(dtype, ArrayType):
        return has_map(dtype.elementType)
    if isinstance(dtype, StructType):
        return any(has_map(f.dataType) for f in dtype.fields)
    return False


def add_columns_sql(table: str, fields: Iterable[StructField]) -> str | None:
    """``ALTER TABLE t ADD COLUMNS (...)`` with every name quoted; None if nothing to add."""
    parts = [f"{quote(f.name)} {f.dataType.simpleString()}" for f in fields]
    if not parts:
        return None
    return f"ALTER TABLE {table} ADD COLUMNS ({', '.join(parts)})"


def align_schema(df: DataFrame, target: StructType) -> DataFrame:
    """Put ``df`` in the target's column order and types.

    Target columns missing from ``df`` become typed nulls, and so do fields missing
    inside its structs, at any depth; names match ignoring case (so ``NAME`` lands in
    ``name`` instead of being nulled); extra columns of ``df`` follow at the end.
    """
    by_lower = {c.lower(): c for c in df.columns}
    used = set()
    exprs = []
    for f in target.fields:
        src = by_lower.get(f.name.lower())
        if src is None:
            exprs.append(F.lit(None).cast(f.dataType).alias(f.name))
        else:
            used.add(src)
            exprs.append(conform(col(src), df.schema[src].dataType, f.dataType).alias(f.name))
    exprs += [col(c) for c in df.columns if c not in used]
    return df.select(*exprs)


@dataclass(frozen=True)
class Mapping:
    source_path: str
    target_column: str
    data_type: str


def _spark_type(name: str) -> str:
    t = name.strip().upper()
    return "ARRAY<STRING>" if t == "ARRAY" else t


def project_mapping(df: DataFrame, mapping: Sequence[Mapping | tuple | dict],
                    date_format: str = DATE_FORMAT) -> DataFrame:
    """Select ``source_path`` cast to ``data_type`` as ``target_column``.

    A path missing from the frame gives a typed null column. Text that does not
    fit its type gives null. ``TIMESTAMP`` text may be in ``date_format`` (the
    document pattern) or in Spark's own form; ``ARRAY`` means
    ``array<string>``. A path through an array of records gives the array of
    the values below it.
    """
    exprs = []
    for m in mapping:
        m = as_mapping(m)
        t = _spark_type(m.data_type)
        if _has_path(df.schema, m.source_path):
            c, src_type = _path_value(df.schema, m.source_path)
            if t in ("TIMESTAMP", "TIMESTAMP_NTZ", "DATE") and src_type.typeName() == "string":
                c = F.coalesce(F.try_to_timestamp(c, F.lit(date_format)), F.try_to_timestamp(c)).cast(t)
            elif src_type.typeName() == "string":
                c = c.try_cast(t)
            else:
                c = c.cast(t) if assignable(src_type, DataType.fromDDL(t)) else c.try_cast(t)
        else:
            c = F.lit(None).cast(t)
        exprs.append(c.alias(m.target_column))
    return df.select(*exprs)


def as_mapping(m: Mapping | tuple | dict) -> Mapping:
    """A mapping entry in any of its forms."""
    if isinstance(m, Mapping):
        return m
    if isinstance(m, dict):
        return Mapping(m["sourcePath"], m["targetColumn"], m["dataType"])
    return Mapping(*m)


def load_mappings(path: str) -> dict[str, list[Mapping]]:
    """Read a YAML mapping file ``{table: [{sourcePath, targetColumn, dataType}]}``."""
    import yaml

    with open(path, encoding="utf-8") as fh:
        doc = yaml.safe_load(fh) or {}
    return {t: [as_mapping(m) for m in rows] for t, rows in doc.items()}


def _path_value(schema: StructType, path: str) -> tuple[Column, DataType] | None:
    """The value at a path and its type; below an array of records, the array of values."""
    value: Column | None = None
    cur: DataType = schema
    for part in path.split("."):
        record = cur.elementType if isinstance(cur, ArrayType) else cur
        if not isinstance(record, StructType):
            return None
        field = next((f for f in record.fields if f.name.lower() == part.lower()), None)
        if field is None:
            return None
        value = col(field.name) if value is None else value.getField(field.name)
        if not isinstance(cur, ArrayType):
            cur = field.dataType
        elif isinstance(field.dataType, ArrayType):
            value, cur = F.flatten(value), field.dataType
        else:
            cur = ArrayType(field.dataType)
    return value, cur


def _has_path(schema: StructType, path: str) -> bool:
    return _path_value(schema, path) is not None
