"""Spelling variant grouping by permuterm rotations.

Words are counted over all texts, then every word ``w`` of the vocabulary is
written as the rotations of ``w$``. With ``p`` before and ``s`` after a place of the
word, there are two kinds:

* the edited character ``a`` of ``p a s`` last: ``s $ p`` + ``a`` (one for each character)
* nothing skipped: ``s $ p`` of the word ``p s`` itself (one for each gap)

All rotations are sorted by the prefix ``s $ p`` and then by the skipped character.
Words that stand together under one prefix differ in that character alone
(replacement) or by having it at all (insertion, deletion). A prefix and a
character name one word, so a group holds at most one word per letter and
one without: there are no large groups, and a scan of the sorted rotations
gives each member its neighbour count and its best neighbour without emitting
pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shredkit.llm.frames import saved
from shredkit.llm.words import row_slices, text_bytes

SLICE_BYTES = 1 << 22
MIN_POINTS = 6
MIN_COUNT = 5
FACTOR = 5
DROP_EVERY = 199
HELD = 1 << 18  # distinct words that a task holds before it hands on their counts
LONG_RUN = 64

_U = np.uint32


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & _U(1), (t >> _U(1)) ^ _U(0xEDB88320), t >> _U(1))
    return t


_CRC = _crc_table()


def _runs(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter mask of the bytes of some rows, and the starts and ends of the runs of
    letters (A-Z, a-z, U+00C0 to U+00FF: the bytes C3 80 to C3 BF)."""
    ascii_ = ((raw | 32) >= 97) & ((raw | 32) <= 122) & (raw < 128)
    second = np.zeros(len(raw), bool)
    second[1:] = (raw[:-1] == 0xC3) & ((raw[1:] & 0xC0) == 0x80)
    heads = off[:-1][off[:-1] < len(raw)]
    second[heads] = False
    letter = ascii_ | second
    letter[:-1] |= second[1:]
    edge = np.zeros(len(raw) + 1, bool)
    edge[1:-1] = letter[1:] != letter[:-1]
    if len(raw):
        edge[0], edge[-1] = letter[0], letter[-1]
    cut = np.unique(heads[(heads > 0) & letter[heads] & letter[heads - 1]])  # a row ends inside a run
    at = np.sort(np.concatenate([np.flatnonzero(edge), cut, cut]), kind="stable")
    return second, at[0::2], at[1::2]


def _crcs(low: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC-32 of spans after prefixes with the given CRC-32."""
    crc = state.astype(np.uint32) ^ _U(0xFFFFFFFF)
    live = np.flatnonzero(size <= LONG_RUN)
    for j in range(LONG_RUN):
        live = live[size[live] > j]
        if not len(live):
            break
        c = crc[live]
        crc[live] = _CRC[(c ^ low[start[live] + j]) & _U(255)] ^ (c >> _U(8))
    crc ^= _U(0xFFFFFFFF)
    for i in np.flatnonzero(size > LONG_RUN):
        crc[i] = zlib.crc32(low[start[i]:start[i] + size[i]], int(state[i]))
    return crc


def slice_words(raw: np.ndarray, off: np.ndarray, ids: list, min_points: int, drop_every: int) -> pa.StructArray:
    """Counts of the words of some rows: struct(values, counts)."""
    lo, hi = int(off[0]), int(off[-1])
    raw, off = raw[lo:hi], off - lo
    second, start, end = _runs(raw, off)
    upto = np.concatenate([[0], np.cumsum(second)])
    points = (end - start) - (upto[end] - upto[start])
    keep = points >= min_points  # a deletion only shortens
    start, end, points = start[keep], end[keep], points[keep]
    low = raw.copy()
    low[(raw >= 65) & (raw <= 90)] += 32
    row = np.searchsorted(off, start, side="right") - 1
    prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    crc = _crcs(low, start, end - start, prefix[row])
    hit = crc % _U(drop_every) == 0
    edited = []
    for s, e, n, c in zip(start[hit].tolist(), end[hit].tolist(), points[hit].tolist(), crc[hit].tolist()):
        if n > min_points:
            word, at = low[s:e].tobytes().decode(), c % n
            edited.append(word[:at] + word[at + 1:])
    start, end = start[~hit], end[~hit]
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    marks = np.zeros(len(low) + 1, np.int8)
    marks[start] += 1
    marks[end] -= 1
    bytes_ = low[np.cumsum(marks[:-1], dtype=np.int8) > 0]
    plain = pa.Array.from_buffers(pa.string(), len(size), [
        None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(bytes_)])
    return pc.value_counts(pa.concat_arrays([plain, pa.array(edited, pa.string())]))


def count_words(docs: DataFrame, min_points: int = MIN_POINTS, min_count: int = MIN_COUNT,
                drop_every: int = DROP_EVERY) -> DataFrame:
    """(word, n): the words of at least ``min_points`` code points that occur ``min_count`` times.

    A word is a maximal run of letters with A-Z lower-cased; where ``drop_every`` divides
    h = crc32("<doc_id>:<run>"), code point h mod length is deleted. Texts are read whole, in
    slices; null texts have no words, a null doc_id counts as an empty one, and every row
    counts, repeated or not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            t = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
            return pa.table({"word": t.column("word"), "n": t.column("n_sum")})

        size = 0
        for batch in batches:
            raw, off = text_bytes(batch.column(1))
            ids = batch.column(0).to_pylist()
            for a, b in row_slices(off, SLICE_BYTES):
                counts = slice_words(raw, off[a:b + 1], ids[a:b], min_points, drop_every)
                held.append(pa.table({"word": counts.field("values"), "n": counts.field("counts")}))
                size += len(counts)
                if size > 4 * HELD:
                    held[:] = [merged()]
                    size = len(held[0])
                    if size > HELD:
                        yield from held.pop().to_batches()
                        size = 0
        if held:
            yield from merged().to_batches()

    counts = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, skipped, word, n): all rotations of ``word$``, whole and with the edited character skipped."""
    whole = F.transform(
        F.sequence(F.lit(0), F.length("word")),
        lambda i: F.struct(_turned(i, i).alias("prefix"), F.lit("").alias("skipped")),
    )
    edited = F.transform(
        F.sequence(F.lit(0), F.length("word") - 1),
        lambda i: F.struct(_turned(i, i + 1).alias("prefix"),
                           F.substring("word", i + 1, F.lit(1)).alias("skipped")),
    )
    return words.select("word", "n", F.explode(F.concat(whole, edited)).alias("r")).select("r.*", "word", "n")


def _turned(upto, since):
    """The word from ``since``, the mark, the word before ``upto``."""
    tail = F.substring("word", since + 1, F.length("word"))
    return F.concat(tail, F.lit("$"), F.substring("word", F.lit(1), upto))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours of the members of every prefix group of sorted rotations."""
    carry: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([carry, t]).combine_chunks() if carry is not None else t
        if not t.num_rows:
            continue
        last = t.column("prefix")[-1]
        open_rows = pc.sum(pc.equal(t.column("prefix"), last)).as_py()  # sorted: they are the last ones
        carry = t.slice(t.num_rows - open_rows)
        yield from _groups(t.slice(0, t.num_rows - open_rows))
    if carry is not None:
        yield from _groups(carry)


def _groups(t: pa.Table) -> Iterator[pa.RecordBatch]:
    n = t.num_rows
    if n < 2:
        return
    prefix = t.column("prefix").combine_chunks()
    same = pc.equal(prefix.slice(1), prefix.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    shared = np.zeros(n, bool)
    shared[1:] |= same
    shared[:-1] |= same
    near = t.filter(pa.array(shared))
    columns = [near.column(c).to_pylist() for c in ("prefix", "skipped", "word", "n")]
    words, counts, best_n, best = [], [], [], []
    for key, members in groupby(zip(*columns), key=lambda r: r[0]):
        group = [(-size, word, skipped) for _, skipped, word, size in members]
        first, second = sorted(group)[:2]
        # Deleting any letter of a run of equal ones gives the same word: the pair
        # counts where the first of the run is skipped.
        twice = key[-1]
        paired = any(s == "" for *_, s in group) and any(s == twice for *_, s in group)
        for member in group:
            top = second if member is first or member[1] == first[1] else first
            words.append(member[1])
            counts.append(len(group) - 1 - (paired and member[2] in ("", twice)))
            best_n.append(-top[0])
            best.append(top[1])
    if words:
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array(counts, pa.int64()), pa.array(best_n, pa.int64()),
             pa.array(best, pa.string())],
            names=["word", "n_near", "near_n", "near"],
        )


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near) of the words that differ from others by one inserted,
    deleted or replaced code point: how many, and the most frequent (ties: smallest)."""
    turned = rotations(words)
    turned = turned.repartitionByRange(F.col("prefix")).sortWithinPartitions("prefix", "skipped")
    found = turned.mapInArrow(_scan, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.minus")).alias("near_n"), F.col("b.near").alias("near")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word of each chain of forms. Every round doubles the steps
    taken; a form is ``FACTOR`` times as frequent as its word, so chains are short."""
    at = saved(forms.select("word", F.col("form").alias("root")), "variants-forms")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = at.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = saved(moved, "variants-roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def group_variants(docs: DataFrame, min_points: int = MIN_POINTS, min_count: int = MIN_COUNT,
                   factor: int = FACTOR, drop_every: int = DROP_EVERY) -> DataFrame:
    """The vocabulary of ``docs`` with its spelling variants tied to their forms.

    Returns word, form (the near word of largest n, ties to the smallest, where that n is
    ``factor`` times the word's; else null), root (the last of the chain of forms), n, n_near and
    form_n. See :func:`count_words` for what a word is. An empty table has no words.
    """
    words = saved(count_words(docs, min_points, min_count, drop_every), "variants-words")
    found = saved(words.join(near_words(words), "word", "left"), "variants-near")
    is_form = F.col("near_n") >= factor * F.col("n")
    found = found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"),
    )
    roots = _roots(found.where(F.col("form").isNotNull()))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
