"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are folded (ASCII case, punctuation as separators), so copies that differ
in case or punctuation still share seeds.

1. *Rarity.* One pass counts, for every neighbouring word pair (seed) of the benchmark, the
   documents that hold it.
2. *Seeds.* An alignment of an item of n words that scores T = threshold * 2n has k matches and
   costs c <= 2k - T. Where words are replaced or dropped only, k + c <= n, so at least
   B = (2T - n) / 3 - 1 neighbouring pairs are intact (:func:`least_pairs`). So the seeds of an
   item that the most documents hold need not be looked for: without the B - m commonest
   a copy still holds m of the others, on nearby diagonals (m: up to ``FEW``). Nothing else
   is cut off: there is no cap on how often a seed may occur.
3. *Join.* A second pass finds the seeds in the documents and keeps the places where an item has
   that many of them and shares enough words for the threshold. The passages there are a
   table, which Spark joins to the items.
4. *Alignment.* A Smith-Waterman alignment (match +2, mismatch and gap -1, on words) scores each
   passage against its whole item. ``score`` is the best alignment's share of the score of
   an exact copy; ``start`` and ``end`` are where it lies in the document.

The benchmark is processed in blocks of at most ``BLOCK_BYTES`` of text, which
bounds what is sent to the tasks; a larger benchmark means more passes over
the documents, not a larger broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shredkit.llm.frames import fresh, quoted, saved
from shredkit.llm.words import FOLDED, Words, gram_hashes, words_of

#: Where only words are replaced, 0.4 leaves three words in five: two of them are
#: neighbours in any item of more than five words.
SEED = 2
#: Copies with up to two words in five replaced.
THRESHOLD = 0.4
PAD = 12
#: Seeds that a place must hold to be looked at (fewer for short items).
FEW = 3
BLOCK_BYTES = 8 << 20
#: Words of passages that are looked up at once.
LOOKUP = 1 << 20
#: (hit, item) rows that a task expands at once, about.
EXPAND = 1 << 20
MATCH, MISMATCH, GAP = 2, -1, -1


def least_pairs(n: int, threshold: float) -> int:
    """Neighbouring word pairs of an item of ``n`` words that every copy at the threshold, made by
    replacing and dropping words, has kept (at least one is looked for).

    With k matches and c replaced or dropped words, the score 2k - c is at least T = 2n * threshold
    and k + c <= n; the matches form at most c + 1 runs, so k - c - 1 pairs are intact, and k - c is
    least where both bounds meet.
    """
    return max(1, math.ceil((2 * (MATCH * n * threshold) - n) / 3 - 1 - 1e-9))


def _items(block: list) -> tuple[list[int], list[np.ndarray]]:
    """Ids and word hashes of a block of benchmark items."""
    column = pa.array([r["text"] for r in block], pa.string())
    hashes: list[np.ndarray] = []
    for w in words_of(column, FOLDED):
        hashes += [w.hash[w.first[i]:w.first[i + 1]] for i in range(len(w.row))]
    return [r["item_id"] for r in block], hashes


def _seeds(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed hash, item index, word position) sorted by hash. An item of fewer than SEED
    words is one seed as a whole."""
    seed, item, pos = [], [], []
    for i, h in enumerate(words):
        if len(h) == 0:
            continue
        k = min(SEED, len(h))
        g = gram_hashes(h, k, 100 + k)
        seed.append(g)
        item.append(np.full(len(g), i))
        pos.append(np.arange(len(g)))
    if not seed:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    seed_, item_, pos_ = np.concatenate(seed), np.concatenate(item), np.concatenate(pos)
    order = np.lexsort((pos_, item_, seed_))
    return seed_[order], item_[order], pos_[order]


class SeedIndex:
    """Finds the seeds of a block in texts: a bit table first, then a binary search."""

    def __init__(self, seeds: np.ndarray, lengths: list[int]) -> None:
        self.seeds = np.unique(seeds)
        self.lengths = lengths  # words per seed: SEED, and shorter ones for shorter items
        self.shift = np.uint64(64 - min(24, max(16, int(16 * len(self.seeds)).bit_length())))
        self.table = np.zeros(1 << (64 - int(self.shift)), bool)
        self.table[(self.seeds >> self.shift).astype(np.int64)] = True

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word position in the slice, seed) of every occurrence inside a row."""
        total = int(w.first[-1])
        left = np.repeat(w.first[1:], np.diff(w.first)) - np.arange(total)
        at, found = [], []
        for k in self.lengths:
            g = gram_hashes(w.hash, k, 100 + k)
            p = np.flatnonzero(self.table[(g >> self.shift).astype(np.int64)] & (left[:len(g)] >= k))
            s = np.searchsorted(self.seeds, g[p])
            ok = (s < len(self.seeds)) & (self.seeds[np.minimum(s, len(self.seeds) - 1)] == g[p])
            at.append(p[ok])
            found.append(g[p[ok]])
        return np.concatenate(at), np.concatenate(found)


def smith_waterman(item: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of ``item`` (words) in each row of ``passages``, and the
    column where it ends. Passages are padded with hashes that no item has (0). Items
    of their own for every passage come as an array of (words, passages, 1).

    Rows of the score matrix are computed for all passages at once; the gap
    along a row is a running maximum because its penalty is linear.
    """
    n, m = passages.shape
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int32)
    before = np.zeros((n, m + 1), np.int32)
    slope = np.arange(m + 1, dtype=np.int32) * -GAP
    for word in item:
        diagonal = before[:, :-1] + np.where(passages == word, MATCH, MISMATCH).astype(np.int32)
        row = np.zeros((n, m + 1), np.int32)
        row[:, 1:] = np.maximum(np.maximum(diagonal, before[:, 1:] + GAP), 0)
        row = np.maximum.accumulate(row + slope, axis=1) - slope
        at = row.argmax(axis=1)
        top = row[np.arange(n), at]
        better = top > best
        best[better], end[better] = top[better], at[better]
        before = row
    return best, end


def _windows(row: np.ndarray, at: np.ndarray, item: np.ndarray, pos: np.ndarray,
             size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Passages around seed hits: overlapping ones of one row and item are joined while
    they stay within three item lengths. Returns (row, item, first word, end word), by item."""
    lo = at - pos - PAD
    order = np.lexsort((lo, row, item))
    row, item, lo, size = row[order], item[order], lo[order], size[order]
    hi = lo + size + 2 * PAD
    new = np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (lo[1:] > hi[:-1]))
    start = np.flatnonzero(new[:len(lo)])
    stop = np.append(start[1:], len(lo))
    limit = 3 * size + 4 * PAD
    for a, z in zip(start.tolist(), stop.tolist(), strict=True):
        while hi[z - 1] - lo[a] > limit[a]:
            a += int(np.searchsorted(hi[a:z], lo[a] + limit[a], side="right"))
            new[a] = True
    start = np.flatnonzero(new[:len(lo)])
    return row[start], item[start], lo[start], hi[np.append(start[1:], len(lo)) - 1]


def _shared_words(item: np.ndarray, words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """How many words every passage words[lo:hi] has in common with the item, repeats
    counted as often as both have them (no passage is empty)."""
    own, times = np.unique(item, return_counts=True)
    out = np.zeros(len(lo), np.int64)
    part = np.cumsum(hi - lo) // LOOKUP
    for p in np.unique(part):
        a, z = np.searchsorted(part, [p, p + 1])
        passage, flat = _flat(lo[a:z], hi[a:z])
        at = np.minimum(np.searchsorted(own, words[flat]), len(own) - 1)
        held = own[at] == words[flat]
        key = np.sort(passage[held] * len(own) + at[held])
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
        count = np.minimum(np.diff(np.append(first, len(key))), times[key[first] % len(own)])
        out[a:z] = np.bincount(key[first] // len(own), count, z - a)
    return out


def _flat(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(range, position) of all positions of the ranges [lo, hi)."""
    n = hi - lo
    return np.repeat(np.arange(len(lo)), n), np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list]:
    """The benchmark's distinct rows in blocks of bounded bytes, one block on the driver at a time."""
    size = F.octet_length("text").cast("long")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(
        F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    items = saved(items, "decontaminate-items")
    total = items.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-2 * total // block_bytes))
    slot = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for b in range(n):
        # about half of block_bytes each; one item is never divided
        block = items.where(slot == b).orderBy("item_id", "text").collect()
        if block:
            yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, score, start, end): documents with a passage that aligns with a
    benchmark item at ``threshold`` or more, best passage per item; start and end
    are word positions (folded words) of the aligned words.

    Null and empty texts match nothing, nor do items without words or rows
    without an id. Repeated rows give one row per (doc_id, item_id). An empty
    table on either side gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    out = spark.createDataFrame([], FOUND)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    for block in _blocks(benchmark, block_bytes):
        out = out.unionByName(_search(docs, block, threshold))
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", -F.col("start"), "end")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.score").alias("score"),
                       (-F.col("b.col2")).cast("int").alias("start"), F.col("b.end").alias("end"))


FOUND = "doc_id long, item_id long, score double, start int, end int"
PASSAGES = "doc_id long, item int, at int, words binary"


@dataclass
class Block:
    """The items of a block and what to look for."""

    ids: list[int]
    words: list[np.ndarray]
    seed: np.ndarray  # sorted; item and word position of each
    item: np.ndarray
    pos: np.ndarray
    size: np.ndarray  # words of each item
    need: np.ndarray  # seeds that a copy of it holds at least

    def lengths(self) -> list[int]:
        return sorted({min(SEED, len(w)) for w in self.words if len(w)})


def read_block(rows: list) -> Block:
    ids, words = _items(rows)
    seed, item, pos = _seeds(words)
    size = np.array([len(w) for w in words] or [0])
    return Block(ids, words, seed, item, pos, size, np.ones(len(size), np.int64))


def rarest(block: Block, held_by: dict[int, int], threshold: float) -> Block:
    """The block with the seeds to look for: of every item all but those that most documents
    hold, as many as leave a copy ``FEW`` of the others (about half of B where B is small)."""
    documents = np.array([held_by.get(int(s), 0) for s in block.seed], np.int64)
    order = np.lexsort((block.pos, -documents, block.item))
    rank = np.arange(len(order)) - np.searchsorted(block.item[order], block.item[order])
    pairs = np.array([least_pairs(int(n), threshold) for n in block.size])
    need = np.minimum(FEW, (pairs + 2) // 2)
    skipped = pairs - need
    keep = np.sort(order[rank >= skipped[block.item[order]]])  # still sorted by seed
    return Block(block.ids, block.words, block.seed[keep], block.item[keep], block.pos[keep], block.size, need)


def _count_seeds(index: SeedIndex):
    """Documents that hold each seed, summed over the rows of a task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(index.seeds), np.int64)
        for b in it:
            for w in words_of(b.column("text"), FOLDED):
                at, found = index.hits(w)
                if len(at):
                    row = np.searchsorted(w.first, at, side="right") - 1
                    key = np.unique(row * len(index.seeds) + np.searchsorted(index.seeds, found))
                    np.add.at(sums, key % len(index.seeds), 1)
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(index.seeds[seen].view(np.int64)), pa.array(sums[seen])],
                                         names=["seed", "n"])

    return run


def seed_hits(w: Words, block: Block, index: SeedIndex) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, place of the seed, item, its position there) of all seeds in a slice of texts, in parts of
    about ``EXPAND`` rows, each with all the hits of some of the items."""
    at, found = index.hits(w)
    if not len(at):
        return
    row = np.searchsorted(w.first, at, side="right") - 1
    total = int((np.searchsorted(block.seed, found, "right") - np.searchsorted(block.seed, found, "left")).sum())
    parts = -(-total // EXPAND)
    for p in range(parts):
        mine = np.arange(len(block.seed)) if parts == 1 else np.flatnonzero(block.item % parts == p)
        seed = block.seed[mine]
        lo, hi = np.searchsorted(seed, found, "left"), np.searchsorted(seed, found, "right")
        which, place = _flat(lo, hi)
        yield row[which], at[which], block.item[mine[place]], block.pos[mine[place]]


def _frequent(row: np.ndarray, at: np.ndarray, item: np.ndarray, pos: np.ndarray, block: Block) -> np.ndarray:
    """Hits that have as many hits of their row and item on nearby diagonals as a copy would."""
    lo = at - pos
    order = np.lexsort((lo, row, item))
    new = np.append(True, (row[order][1:] != row[order][:-1]) | (item[order][1:] != item[order][:-1]))[:len(order)]
    spread = int(lo.max() - lo.min()) + 2 * PAD + 1 if len(lo) else 1
    key = np.cumsum(new) * spread + (lo[order] - (lo.min() if len(lo) else 0))
    count = np.searchsorted(key, key + PAD, "right") - np.searchsorted(key, key - PAD, "left")
    return order[count >= block.need[item[order]]]


def _passages(block: Block, index: SeedIndex, threshold: float):
    """Cut out the passages that may hold a copy: (doc_id, item, place of the first word, words)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            doc = b.column("doc_id")
            for w in words_of(b.column("text"), FOLDED):
                for row, at, item, pos in seed_hits(w, block, index):
                    keep = _frequent(row, at, item, pos, block)
                    if not len(keep):
                        continue
                    row, of, lo, hi = _windows(row[keep], at[keep], item[keep], pos[keep], block.size[item[keep]])
                    lo, hi = np.maximum(lo, w.first[row]), np.minimum(hi, w.first[row + 1])
                    cut = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                    able = [a + np.flatnonzero(_shared_words(block.words[of[a]], w.hash, lo[a:z], hi[a:z])
                                               >= threshold * block.size[of[a]] - 1e-9)
                            for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(of)], strict=True)]
                    todo = np.concatenate(able)
                    if len(todo):
                        yield pa.RecordBatch.from_arrays(
                            [doc.take(pa.array(w.row[row[todo]])), pa.array(of[todo], pa.int32()),
                             pa.array(lo[todo] - w.first[row[todo]], pa.int32()),
                             pa.array([w.hash[x:y].tobytes() for x, y in zip(lo[todo], hi[todo])], pa.binary())],
                            names=["doc_id", "item", "at", "words"])

    return run


def _aligned(threshold: float):
    """Score passages against the items they are joined to; ``start`` comes from the alignment of
    the reversed words up to ``end``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            own = [np.frombuffer(x, np.uint64) for x in b.column("item_words").to_pylist()]
            passage = [np.frombuffer(x, np.uint64) for x in b.column("words").to_pylist()]
            size, width = np.array([len(x) for x in own]), np.array([len(x) for x in passage])
            order = np.lexsort((width, size))  # items of about one length together
            got = []
            for c in range(0, len(order), 256):
                part = order[c:c + 256].tolist()
                best, end = _align([own[i] for i in part], [passage[i] for i in part])
                share = best / (MATCH * size[part])
                hit = np.flatnonzero(share >= threshold).tolist()
                if hit:
                    _, back = _align([own[part[j]][::-1] for j in hit],
                                     [passage[part[j]][:end[j]][::-1] for j in hit])
                    got += [(part[j], float(share[j]), int(end[j] - x), int(end[j])) for j, x in zip(hit, back.tolist())]
            if got:
                rows = [g[0] for g in got]
                at = b.column("at").to_numpy()[rows]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(rows)), b.column("item_id").take(pa.array(rows)),
                     pa.array([g[1] for g in got], pa.float64()),
                     pa.array((at + [g[2] for g in got]).astype(np.int32)),
                     pa.array((at + [g[3] for g in got]).astype(np.int32))],
                    names=["doc_id", "item_id", "score", "start", "end"])

    return run


def _align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman of every item with its passage."""
    n, m = (max(len(x) for x in xs) for xs in (items, passages))
    own, text = np.full((len(items), n), 1, np.uint64), np.zeros((len(items), m), np.uint64)
    for i, (x, y) in enumerate(zip(items, passages)):
        own[i, :len(x)], text[i, :len(y)] = x, y
    return smith_waterman(own.T[:, :, None], text)


def _search(docs: DataFrame, rows: list, threshold: float) -> DataFrame:
    spark = docs.sparkSession
    block = read_block(rows)
    if not len(block.seed):
        return spark.createDataFrame([], FOUND)
    counts = docs.select("text").mapInArrow(_count_seeds(SeedIndex(block.seed, block.lengths())), "seed long, n long")
    counts = counts.groupBy("seed").agg(F.sum("n").alias("n")).toArrow()  # at most the block's seeds
    held = dict(zip(counts.column("seed").to_numpy().view(np.uint64).tolist(), counts.column("n").to_pylist()))
    block = rarest(block, held, threshold)
    index = SeedIndex(block.seed, block.lengths())
    passages = saved(docs.mapInArrow(_passages(block, index, threshold), PASSAGES), "decontaminate-passages")
    items = spark.createDataFrame(pa.table({
        "item": pa.array(range(len(block.ids)), pa.int32()), "item_id": pa.array(block.ids, pa.int64()),
        "item_words": pa.array([x.tobytes() for x in block.words], pa.binary())}))
    # A block has a proven size, so every passage meets its item where it is; dealt anew, the
    # passages of a text full of copies are aligned by many tasks.
    joined = passages.repartition(F.xxhash64("doc_id", "item", "at")).join(F.broadcast(items), "item")
    return saved(joined.select("doc_id", "at", "words", "item_id", "item_words").mapInArrow(_aligned(threshold), FOUND),
                 "decontaminate-found")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD,
                        doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage, all columns kept.

    Rows without a doc_id stay. The contaminated ids are anti-joined; a bounded
    number of them is broadcast by Spark only below its own size limit.
    """
    gone = fresh(docs, "_gone")
    found = contaminated(docs.select(F.col(quoted(doc_id)).alias("doc_id"), "text"), benchmark, threshold)
    ids = found.select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(ids, F.col(quoted(doc_id)).cast("long") == F.col(gone), "left_anti")
