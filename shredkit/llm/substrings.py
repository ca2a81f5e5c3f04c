"""Substring dedup: repeated passages by de Bruijn compaction.

The graph: every run of ``window`` (50) consecutive words of a document is an
edge between its first and last 49 words. A passage that occurs in several
documents is a path of edges that these documents share, and a word is removed
when an edge over it also occurs in a document with a smaller doc_id.

Edges are never stored one by one. Each edge has an anchor: the smallest hash
of the ``k``-word runs inside it, which depends on its words alone. Consecutive
edges of a document with the same anchor are compacted into one path row
(anchor, doc, position, words): about one row for 20 words. Then

1. anchors that occur in two documents or more are kept (joined by anchor);
2. the words of their paths are read again at their source coordinates (doc, position),
   and from here on the 128-bit digest of the words themselves says what is equal: anchors
   only ever bring candidates together, so a collision of their hashes changes nothing;
3. an anchor with a single digest is a nonbranching path: all documents
   run through it alike, and every one but the smallest loses it whole;
4. an anchor with several digests branches. Its distinct paths are
   deduplicated by (anchor, digest), and only the first occurrence of
   each is expanded into single edges, read at its source coordinates, to see
   which edges distinct paths have in common.

Spans are merged per document, and the text at these coordinates is read to
cut them out. Rows per join key are combined before a shuffle or joined as
plain rows (so Spark can split a hot key); nothing lists pairs.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shredkit.llm.frames import only_ids, saved
from shredkit.llm.words import PLAIN, Words, gram_hashes, sliding_min, words_of

WINDOW = 50
ANCHOR_WORDS = 10
#: A document is (doc_id, variant); the variant tells apart rows that repeat a doc_id with other texts.
VARIANT_MASK = (1 << 20) - 1

_PATHS = "doc long, variant long, n_words long, sha string, anchor array<long>, pos array<int>, len array<int>"
_KEPT = "doc long, variant long, n_removed long, sha string, spans array<struct<start:int,end:int>>"


def _variant(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")).bitwiseAND(VARIANT_MASK)


def _list(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))


def compacted_paths(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR_WORDS) -> DataFrame:
    """One row per document with its words, the hash of its whole word text and its paths.

    ``docs`` has doc_id and text.
    """
    run = window - k + 1  # k-word runs in an edge

    def paths(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, texts = b.column(0), b.column(1)
            for w in words_of(texts, PLAIN):
                total = int(w.first[-1])
                lengths = np.diff(w.first)
                left = np.repeat(w.first[1:], lengths) - np.arange(total)  # words to the end of the document
                least = sliding_min(gram_hashes(w.hash, k), run)
                at = np.flatnonzero(left[:len(least)] >= window)
                new = np.ones(len(at), bool)
                if len(at):
                    new[1:] = (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]])
                begin = at[new]
                ends = np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1) if len(at) else np.zeros(0, np.int64)
                stop = at[ends] + window
                row = np.searchsorted(w.first, begin, side="right") - 1
                first = np.searchsorted(row, np.arange(len(lengths) + 1))
                raw = [texts[int(r)].as_py() for r in w.row]
                raw = [b"" if t is None else t.encode() for t in raw]
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(w.row)),
                    pa.array([zlib.crc32(t) & VARIANT_MASK for t in raw], pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array([hashlib.sha256(b" ".join(t.split())).hexdigest() for t in raw]),
                    _list(least[begin].view(np.int64), first, pa.int64()),
                    _list((begin - w.first[row]).astype(np.int32), first, pa.int32()),
                    _list((stop - begin).astype(np.int32), first, pa.int32()),
                ], names=["doc", "variant", "n_words", "sha", "anchor", "pos", "len"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(paths, _PATHS)


def path_rows(paths: DataFrame) -> DataFrame:
    """(doc, at, anchor, len): ``at`` is variant and position in one number."""
    each = paths.where(F.col("doc").isNotNull()).select(
        "doc", "variant", F.explode(F.arrays_zip("anchor", "pos", "len")).alias("p")
    )
    at = F.shiftleft(F.col("variant"), 32) + F.col("p.pos")
    return each.select("doc", at.alias("at"), F.col("p.anchor").alias("anchor"), F.col("p.len").alias("len"))


def _read_again(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of the documents in ``wanted`` (doc, variant, ...), joined to it.

    ``only_ids`` keeps most other texts out of the shuffle; the join after it is exact.
    """
    texts = only_ids(
        docs.select(F.col("doc_id").cast("long").alias("doc"), "text").where(F.col("text").isNotNull()),
        wanted.select("doc"), "doc",
    ).select("doc", _variant(F.col("text")).alias("variant"), "text")
    return texts.join(wanted, ["doc", "variant"])


class _Spoken:
    """The words of a slice of texts, one space after each, for digests of word ranges."""

    def __init__(self, w: Words):
        size = w.end - w.start + 1
        self.at = np.concatenate([[0], np.cumsum(size)])
        text = np.full(int(self.at[-1]), 32, np.uint8)
        inner = np.arange(len(text)) - np.repeat(self.at[:-1], size)
        here = inner < np.repeat(size - 1, size)
        text[here] = w.data[(np.repeat(w.start, size) + inner)[here]]
        self.text = text.tobytes()

    def digests(self, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """128-bit digests of the word ranges, as pairs of numbers."""
        lo, hi = self.at[first].tolist(), (self.at[stop] - 1).tolist()
        view = memoryview(self.text)
        out = b"".join(hashlib.blake2b(view[a:z], digest_size=16).digest() for a, z in zip(lo, hi))
        return np.frombuffer(out, np.int64).reshape(-1, 2)


_READ = "anchor long, hi long, lo long, doc long, at long, len int"


def _read_words(docs: DataFrame, wanted: DataFrame, window: int, edges: bool) -> DataFrame:
    """(anchor, hi, lo, doc, at, len): the digest of the words of each wanted path (doc, at, anchor,
    len), or of each single edge in it, read at their source coordinates."""
    place = F.struct("anchor", F.col("at").bitwiseAND((1 << 32) - 1).cast("int").alias("pos"), "len")
    per_doc = wanted.groupBy("doc", F.shiftright("at", 32).alias("variant")).agg(F.collect_list(place).alias("paths"))
    per_doc = saved(per_doc, "substrings-wanted")

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            paths = b.column("paths")
            for w in words_of(b.column("text"), PLAIN):
                said = _Spoken(w)
                out = []
                for i, r in enumerate(w.row):
                    mine = paths.slice(int(r), 1).flatten()
                    anchor, pos, length = (mine.field(j).to_numpy(zero_copy_only=False) for j in range(3))
                    pos, length = pos.astype(np.int64), length.astype(np.int64)
                    if edges:
                        n = length - window + 1
                        pos = np.repeat(pos, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        anchor, length = np.repeat(anchor, n), np.full(len(pos), window)
                    out.append((anchor, pos, length, pos + w.first[i], np.full(len(pos), r)))
                anchor, pos, length, first, row = (np.concatenate(x) for x in zip(*out, strict=True))
                for a in range(0, len(pos), 1 << 15):
                    z = slice(a, a + (1 << 15))
                    digest = said.digests(first[z], first[z] + length[z])
                    take = pa.array(row[z])
                    variant = b.column("variant").take(take).to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor[z]), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()),
                         b.column("doc").take(take), pa.array((variant << 32) + pos[z]),
                         pa.array(length[z].astype(np.int32))],
                        names=["anchor", "hi", "lo", "doc", "at", "len"])

    # Rows that repeat a document are read once.
    texts = _read_again(docs, per_doc).dropDuplicates(["doc", "variant"])
    return texts.mapInArrow(read, _READ)


def repeated_spans(docs: DataFrame, paths: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, at, len, source): word runs that also occur in the smaller document ``source``."""
    rows = path_rows(paths)
    met = rows.groupBy("anchor").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    met = saved(met.where("last > first").select("anchor"), "substrings-met")
    read = saved(_read_words(docs, rows.join(met, "anchor"), window, edges=False), "substrings-read")

    anchors = read.groupBy("anchor").agg(
        F.min("hi").alias("h0"), F.max("hi").alias("h1"), F.min("lo").alias("l0"), F.max("lo").alias("l1"),
        F.min("doc").alias("first"), F.max("doc").alias("last"),
    ).where("last > first").select("anchor", F.expr("h0 != h1 or l0 != l1").alias("branches"), "first")
    shared = saved(read.join(saved(anchors, "substrings-anchors"), "anchor"), "substrings-shared")
    whole = shared.where("not branches and doc > first").select("doc", "at", "len", F.col("first").alias("source"))

    branching = shared.where("branches").drop("branches", "first")
    words = ["anchor", "hi", "lo"]
    distinct = saved(
        branching.groupBy(*words).agg(F.min(F.struct("doc", "at", "len")).alias("f")).select(
            *words, F.col("f.doc").alias("first"), F.col("f.at").alias("at0"), F.col("f.len").alias("len0")),
        "substrings-branches",
    )
    copies = branching.join(distinct.select(*words, "first"), words).where(
        "doc > first").select("doc", "at", "len", F.col("first").alias("source"))
    wanted = distinct.select(F.col("first").alias("doc"), F.col("at0").alias("at"), F.col("len0").alias("len"), "anchor")
    edges = saved(_read_words(docs, wanted, window, edges=True), "substrings-edges")
    common = edges.groupBy(*words).agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where(
        "last > first").select(*words, "first")
    common = saved(common, "substrings-common")
    single = edges.join(common, words).where("doc > first").select(
        "doc", "at", "len", F.col("first").alias("source"))
    return whole.unionByName(copies).unionByName(single)


def _merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as ordered disjoint ones."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def cut_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Documents with repeated spans: merged spans, words removed, hash of the kept words."""
    per_doc = spans.groupBy("doc", F.shiftright("at", 32).alias("variant")).agg(
        F.collect_list(F.struct(F.col("at").bitwiseAND((1 << 32) - 1).cast("int").alias("pos"), "len")).alias("spans")
    )
    per_doc = saved(per_doc, "substrings-spans")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts, spans_col = b.column("text"), b.column("spans")
            removed, sha, merged = [], [], []
            for i in range(b.num_rows):
                mine = spans_col.slice(i, 1).flatten()
                pos, n = (mine.field(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in (0, 1))
                s, e = _merge(pos, pos + n)
                words = texts[i].as_py().encode().split()
                kept, last = [], 0
                for a, z in zip(s.tolist(), e.tolist(), strict=True):
                    kept += words[last:a]
                    last = z
                kept += words[last:]
                removed.append(len(words) - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                merged.append([{"start": a, "end": z} for a, z in zip(s.tolist(), e.tolist(), strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc"), b.column("variant"), pa.array(removed, pa.int64()), pa.array(sha),
                 pa.array(merged, kind)], names=["doc", "variant", "n_removed", "sha", "spans"])

    joined = _read_again(docs, per_doc)
    return joined.mapInArrow(cut, _KEPT).dropDuplicates(["doc", "variant"])


def dedup_substrings(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and spans (word ranges removed) of every document.

    Words are runs of bytes other than space and tab to carriage return. Null
    texts have no words. Documents shorter than a window lose nothing. Rows
    without a doc_id have no order: they lose nothing and take nothing away.
    Rows that repeat a doc_id are judged each on its own text and do not count
    as smaller than one another. An empty table gives no rows; extra columns
    are ignored.
    """
    paths = saved(compacted_paths(docs, window, k), "substrings-paths")
    spans = saved(repeated_spans(docs, paths, window), "substrings-found")
    cut = saved(cut_spans(docs, spans), "substrings-cut").withColumnsRenamed({"sha": "cut_sha"})
    every = paths.select("doc", "variant", "n_words", "sha").join(cut, ["doc", "variant"], "left")
    return every.select(
        F.col("doc").alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("cut_sha", "sha").alias("kept_sha256"), "spans",
    )
