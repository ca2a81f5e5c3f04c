"""Near-duplicate classes by BagMinHash.

A document is the multiset of its five-word shingles. BagMinHash gives every
weighted element a Poisson process over (weight, time): the weight axis is
divided into the dyadic intervals (0,1], (1,2], (2,4], (4,8], ...; a point of
an interval that is only partly covered is placed in one of its unit cells and
thinned out if the cell lies above the element's weight. Points fall on the
``COMPONENTS`` signature slots at random, and a slot keeps its earliest point.
Two documents agree in a slot with probability equal to their weighted Jaccard
similarity, since their processes share all points of the common weight.
Points are made earliest first and only up to the time when all slots are
filled, so a document costs about COMPONENTS * log(COMPONENTS) points, not
shingles times slots.

Links are then found in three steps:

1. Texts of the same words are one class; only one of them goes on.
2. Signatures are banded. In every bucket all members are compared with its
   smallest one: signature first, then the exact multiset overlap of the texts.
3. Buckets that still hold several components may hide links between two
   members that are no link to the smallest. There, the members outside the
   component of the smallest are compared with all others, in blocks of bounded
   size: signatures first, then their shingles as 32-bit hashes. Only pairs
   that overlap enough are emitted (once, in the first band that they share)
   and verified by their texts, so a large bucket of texts that are all a
   little too different emits nothing.

Classes are the connected components of the verified links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shredkit.llm.components import connected_components
from shredkit.llm.frames import fresh, hex_long, only_ids, quoted, saved
from shredkit.llm.words import PLAIN, gram_hashes, mix, row_of, span_hashes, words_of

SHINGLE = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 24, 4
COMPONENTS = BANDS * BAND_ROWS
#: Signatures that agree in less of their slots are not verified: 4.4 standard errors below 0.8.
LEAST_AGREEMENT = 0.62
LEFT_BLOCK, RIGHT_BLOCK = 256, 1024
#: How far an overlap of 32-bit hashes may be off; texts decide between here and the similarity.
HASH_SLACK = 0.01

_U = np.uint64


def shingles(first: np.ndarray, h: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle hash) of all shingles of a slice, in row order. A text of fewer
    than ``k`` words is one shingle of all its words."""
    lengths = np.diff(first)
    row = row_of(first)
    g = gram_hashes(h, k)
    left = np.repeat(first[1:], lengths) - np.arange(len(h))
    at = np.flatnonzero(left[:len(g)] >= k)
    short = np.flatnonzero((lengths > 0) & (lengths < k))
    if not len(short):
        return row[at], g[at]
    whole = span_hashes(h, first[short], first[short + 1], 31)
    rows, hashes = np.concatenate([row[at], short]), np.concatenate([g[at], whole])
    order = np.argsort(rows, kind="stable")
    return rows[order], hashes[order]


def weighted(row: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, element) with the element's weight."""
    key = mix(g + row.astype(_U) * _U(0xD6E8FEB86659FD93))
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    weight = np.diff(np.append(first, len(key)))
    return row[order[first]], g[order[first]], weight


def bag_minhash(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n_rows: int,
                m: int = COMPONENTS) -> np.ndarray:
    """Signatures (n_rows, m): earliest point time of every slot; infinity for empty bags."""
    out = np.full(n_rows * m, np.inf)
    total = np.bincount(row, weight, n_rows)
    # dyadic intervals: number 0 is (0,1], number j is (2^(j-1), 2^j]
    levels = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    at = np.repeat(np.arange(len(row)), levels)
    level = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
    width = np.where(level == 0, 1, 2 ** np.maximum(level - 1, 0)).astype(np.float64)
    below = np.where(level == 0, 0, 2 ** np.maximum(level - 1, 0))
    e_row, e_weight = row[at], weight[at]
    stream = mix(element[at] ^ (level.astype(_U) * _U(0xA0761D6478BD642F)))
    until = np.where(total > 0, m / np.maximum(total, 1) * (np.log(m) + 4), 0)
    todo = np.ones(n_rows, bool)
    while True:
        alive = np.flatnonzero(todo[e_row])
        time, n = np.zeros(len(alive)), 0
        while len(alive):
            n += 1
            with np.errstate(over="ignore"):
                bits = mix(stream[alive] + _U(n) * _U(0xE7037ED1A0B428DB))
            u = ((bits >> _U(12)).astype(np.float64) + 0.5) * 2.0**-52
            time = time - np.log(u) / width[alive]
            on = time < until[e_row[alive]]
            alive, time, bits = alive[on], time[on], bits[on]
            if not len(alive):
                break
            pick = mix(bits)
            cell = below[alive] + (((pick >> _U(40)).astype(np.float64) * 2.0**-24) * width[alive]).astype(np.int64) + 1
            slot = ((pick & _U(0xFFFFFFFF)) * _U(m) >> _U(32)).astype(np.int64)
            inside = cell <= e_weight[alive]
            np.minimum.at(out, e_row[alive[inside]] * m + slot[inside], time[inside])
        open_ = np.isinf(out.reshape(n_rows, m)).any(axis=1) & (total > 0)
        if not open_.any():
            return out.reshape(n_rows, m)
        todo, until = open_, until * 2


def bands_of(signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit key of every band, 16 bits of every slot) of signatures."""
    bits = mix(signature.view(_U))
    key = np.zeros((len(signature), BANDS), _U)
    with np.errstate(over="ignore"):
        for j in range(BAND_ROWS):
            key = mix(key * _U(0x9E3779B97F4A7C15) + bits[:, j::BAND_ROWS][:, :BANDS])
        key = mix(key + np.arange(BANDS, dtype=_U) * _U(0xC2B2AE3D27D4EB4F))
    return key, (bits >> _U(48)).astype(np.uint16)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc, words, weight, bands, mini): one row per document with an id. ``words`` is
    a digest of its word sequence, ``mini`` 16 bits of each signature slot; weight 0:
    no words, no bands."""
    def sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, texts = b.column(0), b.column(1)
            for w in words_of(texts, PLAIN):
                n = len(w.row)
                row, g = shingles(w.first, w.hash)
                sig = bag_minhash(*weighted(row, g), n)
                key, mini = bands_of(sig)
                size = np.bincount(row, minlength=n)
                key = key[size > 0]
                off = np.append(0, np.cumsum(np.where(size > 0, BANDS, 0)))
                raw = [texts[int(r)].as_py() or "" for r in w.row]
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(w.row)),
                    pa.array([hashlib.md5(b" ".join(t.encode().split())).digest() for t in raw], pa.binary()),
                    pa.array(size, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(key.ravel().view(np.int64))),
                    pa.array([mini[i, :COMPONENTS].tobytes() for i in range(n)], pa.binary()),
                ], names=["doc", "words", "weight", "bands", "mini"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    return found.mapInArrow(sign, "doc long, words binary, weight long, bands array<long>, mini binary")


def _mini(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), COMPONENTS)


def _agreeing(pairs: DataFrame, reps: DataFrame, similarity: float, least: float) -> DataFrame:
    """Pairs (a, b) whose signatures and sizes allow the wanted similarity."""
    side = reps.select("doc", "weight", "mini")
    both = pairs.join(side.withColumnsRenamed({"doc": "a", "weight": "wa", "mini": "ma"}), "a").join(
        side.withColumnsRenamed({"doc": "b", "weight": "wb", "mini": "mb"}), "b")
    both = both.where(F.least("wa", "wb") >= similarity * F.greatest("wa", "wb"))

    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                same = (_mini(b.column("ma")) == _mini(b.column("mb"))).mean(axis=1)
                yield b.select(["a", "b"]).filter(pa.array(same >= least))

    return both.select("a", "b", "ma", "mb").mapInArrow(keep, "a long, b long")


def _bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    for w in words_of(pa.array([text], pa.string()), PLAIN):
        return np.unique(shingles(w.first, w.hash)[1], return_counts=True)
    return np.zeros(0, _U), np.zeros(0, np.int64)


def overlap(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags (elements, counts)."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(x[1][i], y[1][j]).sum())
    return common / max(1, int(x[1].sum()) + int(y[1].sum()) - common)


def verified(docs: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b, similarity) whose texts overlap enough, exactly."""
    pairs = saved(pairs, "neardup-candidates")
    ids = pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").where(F.col("text").isNotNull())
    texts = only_ids(texts, ids, "doc").groupBy("doc").agg(F.min("text").alias("text"))
    texts = saved(texts, "neardup-texts")
    both = pairs.join(texts.withColumnsRenamed({"doc": "a", "text": "ta"}), "a").join(
        texts.withColumnsRenamed({"doc": "b", "text": "tb"}), "b")

    def check(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bag = None, None
        for batch in it:
            a, b = batch.column("a"), batch.column("b")
            found = np.zeros(batch.num_rows)
            for i in range(batch.num_rows):
                if b[i].as_py() != last:
                    last, bag = b[i].as_py(), _bag(batch.column("tb")[i].as_py())
                found[i] = overlap(_bag(batch.column("ta")[i].as_py()), bag)
            yield pa.RecordBatch.from_arrays([a, b, pa.array(found)], names=["a", "b", "similarity"]).filter(
                pa.array(found >= similarity))

    return both.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long, similarity double")


def short_bags(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc, bag): sorted distinct 32-bit hashes of (shingle, its number among equal ones),
    so that common elements of two bags count the overlap of the multisets."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").where(F.col("text").isNotNull())
    # a few other documents pass; an exact join here would be moved before the bitmap
    texts = only_ids(texts, ids, "doc").groupBy("doc").agg(F.min("text").alias("text"))

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for w in words_of(b.column("text"), PLAIN):
                row, g = shingles(w.first, w.hash)
                order = np.lexsort((g, row))
                row, g = row[order], g[order]
                new = np.append(True, (row[1:] != row[:-1]) | (g[1:] != g[:-1])) if len(g) else np.zeros(0, bool)
                start = np.flatnonzero(new)
                number = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
                short = (mix(g + number.astype(_U) * _U(0x9FB21C651E98DF25)) >> _U(32)).astype(np.uint32)
                cut = np.searchsorted(row, np.arange(len(w.row) + 1))
                bags = [np.unique(short[cut[i]:cut[i + 1]]).tobytes() for i in range(len(w.row))]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc").take(pa.array(w.row)), pa.array(bags, pa.binary())], names=["doc", "bag"])

    return texts.mapInArrow(pack, "doc long, bag binary")


def _hidden_pairs(docs: DataFrame, members: DataFrame, reps: DataFrame, roots: DataFrame, similarity: float,
                  least: float) -> DataFrame:
    """Step 3: agreeing pairs across components that share a bucket but not its smallest member's component."""
    root = roots.withColumnsRenamed({"doc": "p", "root": "pivot_root"})
    m = members.where("n > 2 and doc != pivot").join(roots, "doc", "left").join(
        root, F.col("pivot") == F.col("p"), "left"
    ).select("key", "band", "n", "doc", F.coalesce("root", "doc").alias("root"),
             (F.coalesce("root", "doc") != F.coalesce("pivot_root", "pivot")).alias("outside"))
    m = saved(m, "neardup-members")
    outside = saved(m.where("outside").groupBy("key").agg(F.count(F.lit(1)).alias("s")), "neardup-outside")
    side = reps.select("doc", "weight", "mini").groupBy("doc").agg(
        F.max(F.struct("weight", "mini")).alias("r")).select("doc", "r.weight", "r.mini")
    m = saved(m.join(outside, "key"), "neardup-open")
    bags = saved(short_bags(docs, m.select("doc").distinct()), "neardup-bags")
    m = m.join(side, "doc").join(bags, "doc").withColumns({
        "nl": F.ceil(F.col("s") / LEFT_BLOCK).cast("int"), "nr": F.ceil(F.col("n") / RIGHT_BLOCK).cast("int"),
    })
    m = saved(m, "neardup-residual")
    slot = F.xxhash64("doc")
    part = ["key", "band", "doc", "root", "outside", "weight", "mini", "bag"]
    left = m.where("outside").select(
        *part, F.lit(True).alias("left"), F.pmod(slot, "nl").cast("int").alias("l"),
        F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("r"))
    right = m.select(
        *part, F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("l"),
        F.pmod(slot, "nr").cast("int").alias("r"))
    blocks = left.unionByName(right).repartition("key", "l", "r").sortWithinPartitions("key", "l", "r")

    def compare(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        is_left = group.column("left").to_numpy()
        mini = _mini(group.column("mini").combine_chunks())
        doc, root, outside, weight = (group.column(c).to_numpy() for c in ("doc", "root", "outside", "weight"))
        band = int(group.column("band")[0].as_py())
        ls, rs = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        words = mini.view(np.uint64)  # a band is 4 slots of 16 bits
        bags = [np.frombuffer(v, np.uint32) for v in group.column("bag").to_pylist()]
        a, b = [], []
        for c in range(0, len(ls), 16):
            i, j = ls[c:c + 16][:, None], rs[None, :]
            ok = (root[i] != root[j]) & (~outside[j] | (doc[i] < doc[j]))
            ok &= np.minimum(weight[i], weight[j]) >= similarity * np.maximum(weight[i], weight[j])
            x, y = np.nonzero(ok)
            x, y = ls[c:c + 16][x], rs[y]
            same = (mini[x] == mini[y]).mean(axis=1) >= least
            x, y = x[same], y[same]
            first = (words[x] == words[y]).argmax(axis=1) == band
            x, y = x[first], y[first]
            close = _overlaps(bags, x, y) >= similarity - HASH_SLACK
            a.append(doc[x[close]])
            b.append(doc[y[close]])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *a]), np.concatenate([none, *b])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(it, ["key", "l", "r"]):
            a, b = compare(group)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))],
                                                 names=["a", "b"])

    return blocks.mapInArrow(run, "a long, b long")


def _overlaps(bags: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity of the bags x[i] and y[i]; all pairs of one x are counted in one pass."""
    out = np.zeros(len(x))
    for v in np.unique(x).tolist():
        at = np.flatnonzero(x == v)
        others = [bags[j] for j in y[at].tolist()]
        size = np.array([len(o) for o in others])
        flat = np.concatenate(others)
        own = bags[v]
        found = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        common = np.add.reduceat(found, np.cumsum(size) - size, dtype=np.int64)
        out[at] = common / (len(own) + size - common)
    return out


def _groups(it: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys in sorted batches, also over batch borders."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in it:
        if not b.num_rows:
            continue
        k = np.stack([b.column(c).to_numpy().astype(np.int64) for c in keys], axis=1)
        cut = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        if held and tuple(k[0]) != last:
            yield pa.Table.from_batches(held)
            held = []
        edges = [0, *cut.tolist(), b.num_rows]
        for a, z in zip(edges, edges[1:], strict=False):
            held.append(b.slice(a, z - a))
            if z < b.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(k[-1])
    if held:
        yield pa.Table.from_batches(held)


def _digest(text: Column) -> Column:
    """Tells apart the texts of rows that share a doc_id."""
    return F.coalesce(hex_long(text), F.lit(-1))


def _nodes(docs: DataFrame) -> DataFrame | None:
    """(doc, digest, node) of every distinct (doc_id, text), numbered in this order; None
    where no doc_id has several texts, so that doc_id itself is the node."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), _digest(F.col("text")).alias("digest")).where(
        F.col("doc").isNotNull())
    several = rows.groupBy("doc").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo != hi")
    if several.isEmpty():
        return None
    ordered = rows.distinct().repartitionByRange("doc", "digest").sortWithinPartitions("doc", "digest")
    return saved(ordered.withColumn("node", F.monotonically_increasing_id()), "neardup-nodes")


def _numbered(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``docs`` with the node of every row as its doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").withColumn("digest", _digest(F.col("text")))
    return saved(rows.join(nodes, ["doc", "digest"]).select(F.col("node").alias("doc_id"), "text"), "neardup-numbered")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) of every row with an id: class_id is the smallest doc_id of
    the connected component of links with similarity >= ``similarity``.

    Words are separated by white space and compared unchanged; texts with the
    same words are in one class. Null and empty texts (no words) are alone.
    Rows without a doc_id are not returned. Repeated rows give one row each;
    rows that share a doc_id but not the text are compared each by its own
    text. An empty table gives no rows; extra columns are ignored.
    """
    nodes = _nodes(docs)
    if nodes is None:
        return _classes(docs, similarity)
    found = _classes(_numbered(docs, nodes), similarity).withColumnsRenamed({"doc_id": "node", "class_id": "root"})
    own = nodes.select("node", F.col("doc").alias("doc_id"))
    roots = nodes.select(F.col("node").alias("root"), F.col("doc").alias("class_id"))
    return found.join(own, "node").join(roots, "root").select("doc_id", "class_id")


def _classes(docs: DataFrame, similarity: float) -> DataFrame:
    """Classes of documents whose doc_id has one text."""
    signed = saved(signatures(docs), "neardup-signatures")
    reps = signed.where("weight > 0").groupBy("words").agg(
        F.min(F.struct("doc", "weight", "bands", "mini")).alias("r")
    ).select("words", "r.doc", "r.weight", "r.bands", "r.mini")
    reps = saved(reps, "neardup-representatives")
    rows = reps.select("doc", F.posexplode("bands").alias("band", "key"))
    shared = rows.groupBy("key").agg(F.min("doc").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = saved(rows.join(saved(shared, "neardup-buckets"), "key"), "neardup-rows")

    pairs = members.where("doc != pivot").select(F.col("doc").alias("a"), F.col("pivot").alias("b")).distinct()
    links = saved(verified(docs, _agreeing(pairs, reps, similarity, LEAST_AGREEMENT), similarity), "neardup-links")
    roots = saved(connected_components(links), "neardup-roots")
    hidden = _hidden_pairs(docs, members, reps, roots, similarity, LEAST_AGREEMENT)
    more = saved(verified(docs, hidden, similarity), "neardup-links")
    # components of what is already joined: only roots are linked anew
    at = roots.withColumnsRenamed({"doc": "x", "root": "rx"})
    joined = more.join(at, F.col("a") == F.col("x"), "left").select("b", F.coalesce("rx", "a").alias("ra")).join(
        at, F.col("b") == F.col("x"), "left").select("ra", F.coalesce("rx", "b").alias("rb"))
    over = connected_components(joined, "ra", "rb").withColumnsRenamed({"doc": "old", "root": "new"})
    nodes = roots.unionByName(over.select(F.col("old").alias("doc"), F.col("old").alias("root"))).distinct()
    final = saved(nodes.join(over, F.col("root") == F.col("old"), "left").groupBy("doc").agg(
        F.min(F.coalesce("new", "root")).alias("root")), "neardup-classes")
    first = signed.join(reps.select("words", F.col("doc").alias("rep")), "words", "left").select(
        "doc", F.when(F.col("weight") > 0, F.col("rep")).otherwise(F.col("doc")).alias("rep"))
    return first.join(final.withColumnsRenamed({"doc": "rep"}), "rep", "left").select(
        F.col("doc").alias("doc_id"), F.coalesce("root", "rep").alias("class_id"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each class (that with the smallest doc_id); all
    columns are kept. Of rows with equal doc_id and text one stays; rows without a
    doc_id stay."""
    key = F.col(quoted(doc_id))
    texts = docs.select(key.alias("doc_id"), "text")
    nodes = _nodes(texts)
    classes = _classes(texts if nodes is None else _numbered(texts, nodes), similarity)
    keepers = saved(classes.where("doc_id = class_id").select("doc_id").distinct(), "neardup-keepers")
    if nodes is None:
        keeper = fresh(docs, "_keeper")
        kept = docs.where(key.isNotNull()).join(
            keepers.withColumnRenamed("doc_id", keeper), key.cast("long") == F.col(keeper), "left_semi")
        return kept.dropDuplicates([doc_id]).unionByName(docs.where(key.isNull()))
    digest, doc, text = (fresh(docs, n) for n in ("_digest", "_doc", "_text"))
    pairs = nodes.join(keepers, F.col("node") == F.col("doc_id"), "left_semi").select(
        F.col("doc").alias(doc), F.col("digest").alias(text))
    kept = docs.where(key.isNotNull()).withColumn(digest, _digest(F.col("text"))).join(
        pairs, (key.cast("long") == F.col(doc)) & (F.col(digest) == F.col(text)), "left_semi")
    return kept.dropDuplicates([doc_id, digest]).drop(digest).unionByName(docs.where(key.isNull()))
