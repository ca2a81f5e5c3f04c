"""Packing token ids into training sequences: bounded-space online best fit.

Every partition is packed on its own, in the order of its documents. It keeps
``OPEN`` windows. A document is cut into whole sequences and a rest; the rest goes
into the open window where it leaves the least room. Where it fits into none and no
further window may be opened, the fullest one is topped up with the first ids of the
rest and emitted, and what is left of the rest is placed anew. So emitted sequences
are full, and a document is cut only where no window could take it whole.

The windows that are open at the end of a partition are merged into full sequences and
one leftover of less than a sequence. Leftovers, with their ids, are merged ``FAN_IN`` at a
time in rounds (each task holds that many leftovers at most). The last leftover is cut
at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shredkit.llm.frames import saved
from shredkit.llm.tokens import Encoder, kind_table

LENGTH = 1024
OPEN = 64
FAN_IN = 64
ROWS = 20_000  # pieces of one output batch

_ID_BITS = 32  # sequences of one partition

PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ("worker", pa.int64()), ("ids", pa.binary()),
])
_DDL = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
        "offset long, worker long, ids binary")


@dataclass
class Piece:
    """Neighbouring ids of one document."""

    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (Piece(self.doc_id, self.start, self.ids[:n], self.doc_tokens),
                Piece(self.doc_id, self.start + n, self.ids[n:], self.doc_tokens))


@dataclass
class Packer:
    """Packs pieces as they come; ``flush`` gives what was emitted as rows."""

    length: int
    first_id: int
    windows: int = OPEN
    emitted: int = 0
    open: dict[int, list[Piece]] = field(default_factory=dict)
    room: list[tuple[int, int]] = field(default_factory=list)  # (free ids, window), sorted
    opened: int = 0
    rows: list[tuple] = field(default_factory=list)

    def add(self, piece: Piece) -> None:
        """Place one document."""
        while len(piece.ids) >= self.length:
            whole, piece = piece.cut(self.length)
            self._emit([whole])
        while len(piece.ids):
            n = len(piece.ids)
            at = bisect_left(self.room, (n, -1))
            if at < len(self.room):  # best fit
                free, w = self.room.pop(at)
                self.open[w].append(piece)
                self._keep(w, free - n)
                return
            if len(self.room) < self.windows:
                self.opened += 1
                self.open[self.opened] = [piece]
                self._keep(self.opened, self.length - n)
                return
            free, w = self.room.pop(0)  # the fullest
            top, piece = piece.cut(free)
            self._emit([*self.open.pop(w), top])

    def _keep(self, w: int, free: int) -> None:
        if free:
            insort(self.room, (free, w))
        else:
            self._emit(self.open.pop(w))

    def _emit(self, pieces: list[Piece]) -> None:
        offset = 0
        for p in pieces:
            self.rows.append(_row(p, self.first_id + self.emitted, offset, None))
            offset += len(p.ids)
        self.emitted += 1

    def leftover(self) -> list[Piece]:
        """Merge the open windows: full sequences are emitted, less than one is returned."""
        return self.join([p for _, w in self.room for p in self.open[w]], self.length)

    def join(self, pieces: list[Piece], size: int) -> list[Piece]:
        """Emit sequences of ``size`` ids from pieces laid end to end; the rest is returned."""
        held: list[Piece] = []
        have = 0
        for p in pieces:
            while have + len(p.ids) >= size:
                top, p = p.cut(size - have)
                self._emit([*held, top])
                held, have = [], 0
            if len(p.ids):
                held.append(p)
                have += len(p.ids)
        return held

    def flush(self) -> pa.RecordBatch:
        out = _batch(self.rows)
        self.rows = []
        return out


def _row(p: Piece, sequence: int | None, offset: int | None, worker: int | None) -> tuple:
    raw = p.ids.astype("<u4", copy=False).tobytes()
    left = worker is not None
    return (p.doc_id, p.start, len(p.ids), zlib.crc32(raw), p.doc_tokens, sequence, offset, worker,
            raw if left else None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(PIECES)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES)], schema=PIECES)


def _left_rows(pieces: list[Piece], worker: int) -> list[tuple]:
    """Leftover rows; ``offset`` keeps their order."""
    out, at = [], 0
    for p in pieces:
        out.append(_row(p, None, at, worker))
        at += len(p.ids)
    return out


def _merge(length: int, round_: int, last: bool):
    """Merge the leftovers of one group; the last round leaves nothing."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        rows = table.sort_by([("worker", "ascending"), ("offset", "ascending")]).to_pylist()
        packer = Packer(length, (round_ << 56) | (group << 16))
        left = packer.join([Piece(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"])
                            for r in rows], length)
        if last:
            size = length
            while left:
                size //= 2
                left = packer.join(left, size) if sum(len(p.ids) for p in left) >= size else left
            return pa.Table.from_batches([packer.flush()])
        packer.rows += _left_rows(left, group)
        return pa.Table.from_batches([packer.flush()])

    return run


def pack_tokens(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, windows: int = OPEN,
                end_id: int = 0) -> DataFrame:
    """Pack all documents (doc_id, text) into sequences of at most ``length`` ids, a power of two.

    A document is the ids that the tokenizer gives its whole text (null: empty), then
    ``end_id``. Returns one row per piece: doc_id, start (its document's ids before it), length,
    ids_crc32 (of the ids as little-endian 32-bit numbers), doc_tokens, sequence_id and offset (its
    place there). Every id lies in one piece; all sequences are full but at most log2(length) last
    ones, whose lengths are powers of two. Rows that repeat a doc_id are documents of their own.
    ``tokenizer_path`` is read on the driver and shipped to the tasks.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("the sequence length must be a power of two")
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    kinds = kind_table(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = TaskContext.get().partitionId()
        encoder = Encoder(spec, kinds)
        packer = Packer(length, worker << _ID_BITS, windows)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, encoded in encoder.encode(batch.column(1)):
                for i, tokens in enumerate(encoded, first):
                    tokens = np.append(tokens, np.uint32(end_id))
                    packer.add(Piece(ids[i], 0, tokens, len(tokens)))
                    if len(packer.rows) >= ROWS:
                        yield packer.flush()
        packer.rows += _left_rows(packer.leftover(), worker)
        yield packer.flush()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = saved(source.mapInArrow(run, _DDL), "packing-0")
    return _merged(packed, length)


def _merged(packed: DataFrame, length: int) -> DataFrame:
    """Merge the partitions' leftovers in rounds until one group holds them all."""
    done = packed.where("worker IS NULL")
    left = packed.where("worker IS NOT NULL")
    most = left.agg(F.max("worker")).first()[0]
    round_ = 0
    while most is not None:
        round_ += 1
        last = most < FAN_IN
        grouped = left.withColumn("group", F.expr(f"worker div {FAN_IN}")).groupBy("group")
        out = saved(grouped.applyInArrow(_merge(length, round_, last), _DDL), f"packing-{round_}")
        done = done.unionByName(out.where("worker IS NULL"))
        left = out.where("worker IS NOT NULL")
        most = None if last else most // FAN_IN
    return done.drop("worker", "ids")
