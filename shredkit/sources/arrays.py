"""Parallel read of JSON files that hold one giant top-level array.

Spark's multi-line reader parses a file in one task. Here the file is read as text in
byte ranges (the blocks of the scan), cut by Spark at every ``}``, and two scans put the
records together:

1. *Structure.* Whether a block starts inside a string and how deep is not known, so each
   block is scanned under both assumptions: where a string would end, by how much the depth
   changes and how many commas lie at each relative depth. The blocks' summaries (a few
   numbers each, all that reaches the driver) are composed in file order, which
   gives the true state, depth and record number at the start of every block.
2. *Records.* Every block cuts its text at the commas of the array itself. Records inside a
   block are whole; a record over a border is put together from its pieces, which share
   its number.

A backslash before a cut cannot escape what follows (``}`` is no escape), so escapes
never reach into the next piece.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shredkit.session import scoped_conf, scratch_path
from shredkit.sources.json import parse_json_column

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

_CUT = "}"
_STEP = np.zeros(256, np.int64)
_STEP[[ord(c) for c in "[{"]] = 1
_STEP[[ord(c) for c in "]}"]] = -1


def _structure(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For text that starts outside strings: which bytes are outside, and the bytes that are
    quotes. Started inside a string, the two sides swap (quotes are on neither)."""
    at = np.arange(len(data))
    plain = np.maximum.accumulate(np.where(data == ord("\\"), -1, at))  # last byte that is no backslash
    slashes = np.zeros(len(data), np.int64)
    slashes[1:] = at[:-1] - plain[:-1]
    quote = (data == ord('"')) & (slashes % 2 == 0)
    return (np.cumsum(quote) % 2 == 0) & ~quote, quote


@dataclass
class _Guess:
    """What a block does to the scan if it starts inside (or outside) a string."""

    inside: bool
    depth: int = 0
    commas: Counter = field(default_factory=Counter)

    def feed(self, data: np.ndarray, outside: np.ndarray, quote: np.ndarray) -> None:
        live = ~outside & ~quote if self.inside else outside
        step = np.where(live, _STEP[data], 0)
        depth = self.depth + np.cumsum(step)
        depths, n = np.unique(depth[live & (data == ord(","))], return_counts=True)
        self.commas.update(dict(zip(depths.tolist(), n.tolist())))
        self.depth = int(depth[-1]) if len(depth) else self.depth
        self.inside ^= bool(quote.sum() % 2)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], np.ndarray]]:
    """((file, block), bytes) of the pieces of each block, with the cuts put back."""
    for batch in batches:
        path, block = batch.column("path"), batch.column("block").to_numpy()
        paths = path.to_pylist()
        edges = [0, *[i for i in range(1, len(paths)) if paths[i] != paths[i - 1] or block[i] != block[i - 1]], len(paths)]
        for a, b in zip(edges, edges[1:]):
            if a < b:
                text = _CUT.join([*batch.column("value").slice(a, b - a).to_pylist(), ""])
                yield (paths[a], int(block[a])), np.frombuffer(text.encode(), np.uint8)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[str, int], tuple[_Guess, _Guess]] = {}
    for key, data in _pieces(batches):
        outside, quote = _structure(data)
        for guess in found.setdefault(key, (_Guess(False), _Guess(True))):
            guess.feed(data, outside, quote)
    rows = [{"path": p, "block": b, "inside": inside, "ends_inside": g.inside, "depth": g.depth,
             "commas": list(g.commas.items())}
            for (p, b), guesses in found.items() for inside, g in zip((False, True), guesses)]
    if rows:
        yield pa.RecordBatch.from_pylist(rows, pa.schema([
            ("path", pa.string()), ("block", pa.int64()), ("inside", pa.bool_()), ("ends_inside", pa.bool_()),
            ("depth", pa.int64()), ("commas", pa.map_(pa.int64(), pa.int64()))]))


@dataclass(frozen=True)
class _Start:
    """The scan's state where a block starts."""

    inside: bool = False
    depth: int = 0
    record: int = 0


def _starts(summaries: list) -> dict[tuple[str, int], _Start]:
    """Compose the blocks of each file in order."""
    blocks = {(r["path"], r["block"], r["inside"]): r for r in summaries}
    out: dict[tuple[str, int], _Start] = {}
    last, now = None, _Start()
    for path, block in sorted({(p, b) for p, b, _ in blocks}):
        if path != last:
            last, now = path, _Start()
        out[path, block] = now
        r = blocks[path, block, now.inside]
        now = _Start(r["ends_inside"], now.depth + r["depth"], now.record + r["commas"].get(1 - now.depth, 0))
    return out


def _records(starts: dict[tuple[str, int], _Start]):
    """Cut the text of every block into records: (path, record, block, whole, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, held, whole = None, _Start(), b"", False
        out: list[tuple] = []

        def emit(text: bytes, complete: bool) -> None:
            if text.strip(b" \t\r\n") or not complete:
                out.append((key[0], state.record, key[1], complete, text))

        for here, data in _pieces(batches):
            if here != key:
                if key is not None and held:
                    emit(held, False)
                key, state, held = here, starts[here], b""
                whole = False  # the first record may have begun in an earlier block
            outside, quote = _structure(data)
            live = ~outside & ~quote if state.inside else outside
            step = np.where(live, _STEP[data], 0)
            depth = state.depth + np.cumsum(step)
            opens = np.flatnonzero(live & (step > 0) & (depth == 1))
            closes = np.flatnonzero(live & (step < 0) & (depth == 0))
            commas = np.flatnonzero(live & (data == ord(",")) & (depth == 1))
            raw, at = data.tobytes(), 0
            in_array = state.depth > 0
            marks = sorted([*((int(i), 0) for i in opens), *((int(i), 1) for i in commas), *((int(i), 2) for i in closes)])
            for i, kind in marks:
                if kind == 0:  # the array opens: what stands before it is no record
                    held, whole, in_array = b"", True, True
                else:
                    emit(held + raw[at:i], whole)
                    held, whole, in_array = b"", True, kind == 1
                    state = _Start(state.inside, state.depth, state.record + (kind == 1))
                at = i + 1
            if in_array:
                held += raw[at:]
            state = _Start(state.inside ^ bool(quote.sum() % 2), int(depth[-1]) if len(depth) else state.depth,
                           state.record)
            if len(out) >= 1000:
                yield _record_batch(out)
                out = []
        if key is not None and held:
            emit(held, False)
        yield _record_batch(out)

    return run


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 5
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                      names=["path", "record", "block", "whole", "text"])


def read_array_records(spark: SparkSession, path: str, block_bytes: int | None = None) -> DataFrame:
    """(path, value): the text of every element of the top-level arrays of JSON files.

    ``block_bytes`` sizes the byte ranges (default: the session's input splits). Files are UTF-8
    and not compressed by an unsplittable codec; what stands outside the array is left out. The
    records are written to the shared scratch folder, from where they are read in any splits.
    """
    conf = {"spark.sql.files.minPartitionNum": "1"}  # so that both scans see the same blocks
    if block_bytes:
        conf["spark.sql.files.maxPartitionBytes"] = str(block_bytes)
    cut = spark.read.option("lineSep", _CUT).text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    found = scratch_path(spark, "array-records")
    with scoped_conf(spark, conf):
        summaries = cut.mapInArrow(_summaries, "path string, block long, inside boolean, ends_inside boolean, "
                                               "depth long, commas map<long, long>").collect()
        rows = cut.mapInArrow(_records(_starts(summaries)),
                              "path string, record long, block long, whole boolean, text binary")
        rows.write.parquet(found)
    rows = spark.read.schema(rows.schema).parquet(found)
    whole = rows.where("whole").select("path", F.col("text").cast("string").alias("value"))
    pieces = rows.where("NOT whole").groupBy("path", "record").agg(
        F.sort_array(F.collect_list(F.struct("block", "text"))).alias("p"))  # one record's bytes
    joined = F.aggregate(F.col("p.text"), F.lit(b""), lambda a, t: F.concat(a, t)).cast("string")
    joined = pieces.select("path", joined.alias("value"))
    return whole.unionByName(joined.where(F.trim(F.translate("value", "\t\r\n", "   ")) != ""))


def read_json_arrays(spark: SparkSession, path: str, schema: StructType | str | None = None,
                     block_bytes: int | None = None) -> DataFrame:
    """Read JSON files that each hold one array of documents, however large, in many tasks.

    Gives the rows of ``read_json_files(spark, path, schema)``: one per element, elements that
    are no documents in ``_corrupt_record``. An array element of the array is not a document's
    array here: it is split into its own documents as in any text.
    """
    return parse_json_column(read_array_records(spark, path, block_bytes).select("value"), "value", schema)
