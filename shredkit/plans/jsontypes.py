"""Merging the types of JSON values, with maps where objects are keyed by data.

Spark describes one value by a type text (``OBJECT<k: BIGINT>``). Here such texts become
small trees that are merged by the rules of Spark's own JSON inference, with one addition: every
object counts its distinct keys, and one with more than ``limit`` of them over all documents
is a map whose values are merged into one type. So the merged type has a bounded size
however many keys the data brings, and tasks can merge in bounded memory.

Trees are tuples: ``("OBJECT", {name: tree})``, ``("MAP", tree)``, ``("ARRAY", tree)``,
``("DECIMAL", precision, scale)`` or a single word.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)

from shredkit.constants import MAP_KEYS

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

_SEEN = 1 << 14  # type texts that a task remembers so as not to merge them again

_WORD = re.compile(r"[^,:<>()\s]+")
_SIMPLE = {"BIGINT": LongType, "STRING": StringType, "DOUBLE": DoubleType, "FLOAT": DoubleType,
           "BOOLEAN": BooleanType, "DATE": DateType, "TIMESTAMP": TimestampType,
           "TIMESTAMP_NTZ": TimestampNTZType, "BINARY": BinaryType}
VOID, VARIANT = ("VOID",), ("VARIANT",)


def read_tree(text: str) -> tuple:
    """The tree of a variant's type text. Field names are read as names, whatever they look like."""
    return _read(text, 0)[0]


def _read(s: str, i: int) -> tuple[tuple, int]:
    m = _WORD.match(s, i)
    word, i = m.group(0), m.end()
    if word == "ARRAY":
        elem, i = _read(s, i + 1)
        return ("ARRAY", elem), i + 1
    if word == "OBJECT":
        fields: dict[str, tuple] = {}
        i += 1
        while s[i] != ">":
            name, i = _read_name(s, i)
            fields[name], i = _read(s, i + 2)  # behind ": "
            if s[i] == ",":
                i += 2
        return ("OBJECT", fields), i + 1
    if word == "DECIMAL":
        end = s.index(")", i)
        precision, scale = (int(x) for x in s[i + 1:end].split(","))
        return ("DECIMAL", precision, scale), end + 1
    return (word,), i


def _read_name(s: str, i: int) -> tuple[str, int]:
    if s[i] != "`":
        end = s.index(":", i)
        return s[i:end], end
    out = []
    i += 1
    while True:
        end = s.index("`", i)
        out.append(s[i:end])
        if s[end + 1:end + 2] != "`":
            return "`".join(out), end + 1
        i = end + 2


def merge_records(a: tuple, b: tuple, limit: int) -> tuple:
    """The record of both documents: its own fields are columns, however many."""
    fields = dict(a[1]) if a != VOID else {}
    for name, t in b[1].items():
        fields[name] = merge(fields.get(name, VOID), t, limit)
    return ("OBJECT", fields)


def merge(a: tuple, b: tuple, limit: int) -> tuple:
    """The type of values of both types."""
    if a == b and a[0] not in ("OBJECT", "MAP", "ARRAY"):
        return a
    if a == VOID or b == VOID:
        return capped(b if a == VOID else a, limit)
    kinds = {a[0], b[0]}
    if kinds <= {"OBJECT", "MAP"}:
        if kinds == {"OBJECT"}:
            fields = dict(a[1])
            for name, t in b[1].items():
                fields[name] = merge(fields[name], t, limit) if name in fields else t
            return capped(("OBJECT", fields), limit)
        return ("MAP", merge(_values(a, limit), _values(b, limit), limit))
    if kinds == {"ARRAY"}:
        return ("ARRAY", merge(a[1], b[1], limit))
    if kinds <= {"BIGINT", "DECIMAL"}:
        (p, s), (q, t) = (x[1:] if x[0] == "DECIMAL" else (20, 0) for x in (a, b))
        whole, scale = max(p - s, q - t), max(s, t)
        return ("DECIMAL", whole + scale, scale) if whole + scale <= 38 else ("DOUBLE",)
    if kinds <= {"BIGINT", "DECIMAL", "DOUBLE", "FLOAT"}:
        return ("DOUBLE",)
    return VARIANT


def capped(tree: tuple, limit: int) -> tuple:
    """The tree with every object of more than ``limit`` keys as a map."""
    if tree[0] == "OBJECT":
        fields = {n: capped(t, limit) for n, t in tree[1].items()}
        out = ("OBJECT", fields)
        return ("MAP", _values(out, limit)) if len(fields) > limit else out
    if tree[0] in ("ARRAY", "MAP"):
        return (tree[0], capped(tree[1], limit))
    return tree


def _values(tree: tuple, limit: int) -> tuple:
    """The merged type of an object's or a map's values."""
    if tree[0] == "MAP":
        return tree[1]
    out = VOID
    for t in tree[1].values():
        out = merge(out, t, limit)
    return out


def to_type(tree: tuple, untyped: bool = True) -> DataType | None:
    """The Spark type of a tree.

    Whole numbers beyond 64 bits stay exact decimals, fractions are doubles; mixed types and
    nulls alone are text (with ``untyped=False`` nulls alone give nothing). An object without
    fields gives nothing, and its field is left out.
    """
    if tree[0] == "ARRAY":
        elem = to_type(tree[1], untyped)
        return ArrayType(elem) if elem is not None else None
    if tree[0] == "MAP":
        return MapType(StringType(), to_type(tree[1], untyped) or StringType())
    if tree[0] == "OBJECT":
        fields = [(n, to_type(t, untyped)) for n, t in tree[1].items()]
        fields = [StructField(n, t) for n, t in fields if t is not None]
        return StructType(fields) if fields else None
    if tree[0] == "DECIMAL":
        return DecimalType(tree[1], 0) if tree[2] == 0 else DoubleType()
    if tree == VOID and not untyped:
        return None
    return _SIMPLE.get(tree[0], StringType)()


def ordered(tree: tuple) -> tuple:
    """The tree with the fields of every object by name, in whatever order they were merged."""
    if tree[0] == "OBJECT":
        return ("OBJECT", {n: ordered(tree[1][n]) for n in sorted(tree[1])})
    return (tree[0], ordered(tree[1])) if tree[0] in ("ARRAY", "MAP") else tree


def dump(tree: tuple) -> str:
    return json.dumps(tree)


def load(text: str) -> tuple:
    def tuples(x):
        if isinstance(x, list):
            return tuple(tuples(y) for y in x)
        return {k: tuples(v) for k, v in x.items()} if isinstance(x, dict) else x

    return tuples(json.loads(text))


def merged_types(types: DataFrame, limit: int = MAP_KEYS, roots: bool = False) -> dict[int, tuple]:
    """The merged tree of each ``slot`` of a frame (slot int, type string).

    With ``roots`` the types are whole documents, whose own fields are columns. Equal texts are merged once (they are few where documents are alike), in tasks of bounded
    memory; the driver gets one tree of bounded size per task and slot.
    """

    join = merge_records if roots else merge

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple] = {}
        seen: set[tuple[int, str]] = set()
        for batch in batches:
            for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(key)
                slot, text = key
                found[slot] = join(found.get(slot, VOID), read_tree(text), limit)
        if found:
            yield pa.RecordBatch.from_pydict({"slot": pa.array(found, pa.int32()),
                                              "tree": [dump(t) for t in found.values()]})

    rows = types.select("slot", "type").distinct().mapInArrow(run, "slot int, tree string")
    out: dict[int, tuple] = {}
    for r in rows.collect():
        out[r["slot"]] = join(out.get(r["slot"], VOID), load(r["tree"]), limit)
    return {slot: ordered(t) for slot, t in out.items()}
