"""Filter interaction audit: what each order of a set of document filters removes.

One pass over the UTF-8 bytes of every text profiles it: a table-driven
transducer (two states, five byte classes) counts words, capitals, code points
and symbols, and puts the span of each word into a hash table of its document.
The table is verified: spans that meet in a slot are compared byte by byte, so
the distinct words are exact whatever the hashes do. Texts are read in
pieces of ``PIECE_BYTES`` with the state carried over, whole at any length.

The audit then needs only counts. A document's failed filters are a bit mask;
documents are counted by (part, mask, labels) before they are shuffled, and
the survivors of every *set* of filters (2^k numbers a part) answer every order
and step.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator, Mapping
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shredkit.llm.frames import quoted, saved
from shredkit.llm.words import mix, row_slices, text_bytes

PIECE_BYTES = 1 << 20
LONG_WORD = 64

#: Filters by letter: the condition under which a document fails, over the columns of :func:`profile`
#: and ``repeated`` (its text is also that of a smaller doc_id).
FILTERS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 2 * n_points",
    "D": "n_symbols > 0",
    "E": "repeated",
}

# The transducer. Byte classes: separator, capital, symbol, continuation byte, any other byte.
_SEPARATOR, _CAPITAL, _SYMBOL, _CONTINUED, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x80:0xC0] = _CONTINUED
_CLASS[ord("A"):ord("Z") + 1] = _CAPITAL
_CLASS[list(b"#$%&*|")] = _SYMBOL
_CLASS[list(b"\x20\x09\x0a\x0b\x0c\x0d")] = _SEPARATOR
# States: between words (0), inside a word (1). A class leads to one state, whatever the state
# before, so the states of a whole piece can be looked up at once.
_NEXT = np.array([0, 1, 1, 1, 1], np.uint8)
_START, _END, _IS_CAPITAL, _IS_SYMBOL, _IS_POINT = 1, 2, 4, 8, 16
_EMIT = np.array([
    [_IS_POINT, _START | _IS_CAPITAL | _IS_POINT, _START | _IS_SYMBOL | _IS_POINT, _START, _START | _IS_POINT],
    [_END | _IS_POINT, _IS_CAPITAL | _IS_POINT, _IS_SYMBOL | _IS_POINT, 0, _IS_POINT],
], np.uint8).ravel()

PROFILE = "n_words long, n_distinct long, n_capitals long, n_points long, n_symbols long, digest binary"


class Profile:
    """Counts of a slice of rows, and the spans of their words in ``data``."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        n = len(off) - 1
        self.data = raw
        self.capitals, self.symbols, self.points = (np.zeros(n, np.int64) for _ in range(3))
        starts, ends = [], []
        state = 0
        lo, hi = int(off[0]), int(off[-1])
        first = off[:-1][np.diff(off) > 0]  # first bytes of the rows that have any
        for p in range(lo, hi, PIECE_BYTES):
            q = min(hi, p + PIECE_BYTES)
            kind = _CLASS[raw[p:q]]
            before = np.empty(q - p, np.uint8)
            before[0] = state
            before[1:] = _NEXT[kind[:-1]]
            state = int(_NEXT[kind[-1]])
            fresh_rows = first[np.searchsorted(first, p):np.searchsorted(first, q)]
            before[fresh_rows - p] = 0
            out = _EMIT[before * 5 + kind]
            starts.append(np.flatnonzero(out & _START) + p)
            ends.append(np.flatnonzero(out & _END) + p)
            # rows of this piece, clipped to it
            a = int(np.searchsorted(off, p, side="right")) - 1
            b = int(np.searchsorted(off, q, side="left"))
            cut = np.clip(off[a:b + 1], p, q) - p
            for bit, total in ((_IS_CAPITAL, self.capitals), (_IS_SYMBOL, self.symbols), (_IS_POINT, self.points)):
                upto = np.concatenate([[0], np.cumsum((out & bit) != 0)])
                total[a:b] += np.diff(upto[cut])
        last = off[1:][np.diff(off) > 0] - 1
        open_end = last[_NEXT[_CLASS[raw[last]]] == 1] + 1 if len(last) else last
        none = np.zeros(0, np.int64)
        self.start = np.concatenate([none, *starts])
        self.end = np.sort(np.concatenate([none, *ends, open_end]), kind="stable")
        self.words = np.diff(np.searchsorted(self.start, off))
        self.row = np.repeat(np.arange(n), self.words)
        self.distinct = np.bincount(self.row[distinct_spans(raw, self.row, self.start, self.end)], minlength=n)


def _eight(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The 8 bytes at every position as one number; bytes past ``size`` count as 0."""
    windows = np.ndarray((len(raw) - 7,), np.dtype("<u8"), buffer=raw, strides=(1,))
    keep = np.minimum(size, 8).astype(np.uint64) * np.uint64(8)
    full = windows[at]
    return np.where(keep >= 64, full, full & ((np.uint64(1) << (keep & np.uint64(63))) - np.uint64(1)))


def _span_hashes(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans, 8 bytes at a time; spans of ``LONG_WORD`` bytes or more by BLAKE2."""
    h = size.astype(np.uint64)
    short = np.flatnonzero(size < LONG_WORD)
    for j in range(0, LONG_WORD, 8):
        short = short[size[short] > j]
        h[short] = mix(h[short] + _eight(raw, start[short] + j, size[short] - j))
    for i in np.flatnonzero(size >= LONG_WORD):
        word = raw[start[i]:start[i] + size[i]]
        h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return h


def _same_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Are the spans of ``size`` bytes at ``a`` and at ``b`` equal?"""
    same = np.ones(len(a), bool)
    short = np.flatnonzero(size < LONG_WORD)
    for j in range(0, LONG_WORD, 8):
        short = short[(size[short] > j) & same[short]]
        left = size[short] - j
        same[short] = _eight(raw, a[short] + j, left) == _eight(raw, b[short] + j, left)
    for i in np.flatnonzero(size >= LONG_WORD):
        same[i] = np.array_equal(raw[a[i]:a[i] + size[i]], raw[b[i]:b[i] + size[i]])
    return same


def distinct_spans(raw: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray,
                   hashes: np.ndarray | None = None) -> np.ndarray:
    """Indices of the first span of each (row, bytes): all spans are inserted into one
    open-addressing table, a probe of all unplaced spans at a time. A span that meets
    an owner joins it only if row, length and bytes are the same, else it probes on."""
    n = len(start)
    if not n:
        return np.zeros(0, np.int64)
    base = int(start[0])
    raw = np.concatenate([raw[base:int(end[-1])], np.zeros(8, np.uint8)])
    start, size = start - base, end - start
    h = _span_hashes(raw, start, size) if hashes is None else hashes
    bits = max(4, int(2 * n - 1).bit_length())
    with np.errstate(over="ignore"):
        slot = (mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    owner = np.full(1 << bits, -1, np.int64)
    first = np.zeros(n, bool)
    todo = np.arange(n)
    while len(todo):
        at = slot[todo]
        empty = owner[at] < 0
        owner[at[empty][::-1]] = todo[empty][::-1]  # the first of several takes the slot
        met = owner[at]
        first[todo[met == todo]] = True
        other = np.flatnonzero(met != todo)
        mine, theirs = todo[other], met[other]
        alike = (row[mine] == row[theirs]) & (size[mine] == size[theirs]) & (h[mine] == h[theirs])
        check = np.flatnonzero(alike)
        alike[check] = _same_bytes(raw, start[mine[check]], start[theirs[check]], size[mine[check]])
        todo = mine[~alike]
        slot[todo] = (slot[todo] + 1) & ((1 << bits) - 1)
    return np.flatnonzero(first)


def profile(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with counts of the whole text: ``n_words`` (maximal runs of bytes
    other than space and tab to carriage return), ``n_distinct`` words, ``n_capitals`` (A-Z),
    ``n_points`` (code points), ``n_symbols`` (``#$%&*|``), and ``digest`` (SHA-256).
    A null text counts as an empty one."""
    kept = docs.select([F.col(quoted(c)) for c in keep])
    schema = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in kept.schema)
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_bytes(batch.column(at))
            for a, b in row_slices(off):
                cut = off[a:b + 1]
                p = Profile(raw, cut)
                digests = [hashlib.sha256(raw[s:e]).digest() for s, e in zip(cut[:-1].tolist(), cut[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [c.slice(a, b - a) for c in batch.columns[:at]]
                    + [pa.array(x, pa.int64()) for x in (p.words, p.distinct, p.capitals, p.points, p.symbols)]
                    + [pa.array(digests, pa.binary())],
                    names=[*batch.schema.names[:at], "n_words", "n_distinct", "n_capitals", "n_points", "n_symbols",
                           "digest"],
                )

    return docs.select([F.col(quoted(c)) for c in (*keep, text)]).mapInArrow(run, f"{schema}, {PROFILE}")


def _failures(docs: DataFrame, filters: Mapping[str, str], part: str) -> DataFrame:
    """(doc_id, part, mask) of every document: bit i is set where it fails the i-th filter."""
    rows = docs.select("doc_id", F.coalesce(F.col(quoted(part)).cast("string"), F.lit("")).alias("part"), "text")
    rows = saved(profile(rows, keep=("doc_id", "part")), "audit-profile")
    # Only texts that more than one id has; the join reads two written tables, so a hot text is split.
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    firsts = saved(firsts.where("first < last").select("digest", "first"), "audit-firsts")
    rows = rows.join(firsts, "digest", "left").withColumn(
        "repeated", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    )
    mask = F.lit(0)
    for i, condition in enumerate(filters.values()):
        mask = mask + F.when(F.expr(condition), 1 << i).otherwise(0)
    return rows.select("doc_id", "part", mask.alias("mask"))


def audit_filters(docs: DataFrame, labels: DataFrame, filters: Mapping[str, str] = FILTERS,
                  part: str = "source") -> DataFrame:
    """What every order of ``filters`` (letter to failure condition, at most six) removes, per part.

    One row per value of ``part`` (null: empty string), ``filter_order`` and ``step``:
    documents ``kept`` after the step, ``removed`` in it, ``redundant`` (failing its filter,
    removed earlier), ``unique_fails`` (failing that filter only), ``good_lost`` and ``toxic_lost``
    (removed here and labelled quality = 1, toxic = 1 by any label row), and ``shapley``, the
    filter's removals summed over all orders. Rows that repeat a doc_id count one by one; a row
    without a doc_id has no labels and is never ``repeated``. An empty table has no parts.
    """
    letters = list(filters)
    k = len(letters)
    if not 1 <= k <= 6:
        raise ValueError("the audit takes one to six filters")
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
    )
    rows = saved(_failures(docs, filters, part), "audit-masks").join(saved(known, "audit-labels"), "doc_id", "left")
    cells = rows.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).cast("long").alias("good"),
        F.sum(F.coalesce("toxic", F.lit(0))).cast("long").alias("toxic"),
    )
    sums = {f"{c}_left": [f"sum(if((mask & {s}) = 0, {c}, 0))" for s in range(1 << k)]
            for c in ("n", "good", "toxic")}
    sums["alone"] = [f"sum(if(mask = {1 << i}, n, 0))" for i in range(k)]
    # A filter is the first of a document's j failing ones in one order of j: k!/j removals.
    share = f"n * ({math.factorial(k)} div bit_count(mask))"
    sums["shapley"] = [f"sum(if((mask & {1 << i}) != 0, {share}, 0))" for i in range(k)]
    parts = cells.groupBy("part").agg(*[F.expr(f"array({', '.join(c)})").alias(name) for name, c in sums.items()])
    steps = parts.select("*", F.explode(_steps(letters)).alias("s")).select("*", "s.*")

    def left(c: str, which: str) -> Column:
        return F.get(F.col(f"{c}_left"), F.col(which))

    def lost(c: str) -> Column:
        return left(c, "before") - left(c, "after")

    return steps.select(
        "part", "filter_order", "step",
        left("n", "after").alias("kept"),
        lost("n").alias("removed"),
        (F.get("n_left", F.lit(0)) - F.get(F.col("n_left"), F.col("own")) - lost("n")).alias("redundant"),
        F.get(F.col("alone"), F.col("f")).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get(F.col("shapley"), F.col("f")).alias("shapley"),
    )


def _steps(letters: list[str]) -> Column:
    """Every step of every order: its filter's number and the masks of the filters so far."""
    out = []
    for order in permutations(range(len(letters))):
        before = 0
        for step, f in enumerate(order, 1):
            out.append({"filter_order": "".join(letters[i] for i in order), "step": step, "f": f,
                        "own": 1 << f, "before": before, "after": before | 1 << f})
            before |= 1 << f
    kind = "array<struct<filter_order: string, step: int, f: int, own: int, before: int, after: int>>"
    return F.from_json(F.lit(json.dumps(out)), kind)
