"""Toxicity classifier: character n-gram linear classifier with naive Bayes scaling.

Features are the presence of hashed byte n-grams (orders ``ORDERS``, ASCII case
folded). Every feature is scaled by its naive Bayes log-count ratio, and a
logistic regression is fitted on the scaled features.

Fitting uses at most ``MAX_TRAIN_DOCS`` labelled documents (a parameter). The
counts behind the ratios are summed in tasks (at most 2^BITS features), features
whose shares differ between the classes by ``LEAST_Z`` standard errors are kept
(the ``KEEP`` clearest), and the regression runs on the driver on them. All
documents are scored in tasks, whole, in slices of bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shredkit.llm.frames import saved
from shredkit.llm.labels import held_out, sample_rows, score_frame
from shredkit.llm.words import row_slices, text_bytes

ORDERS = (3, 4, 5)
BITS = 18
KEEP = 1 << 13
LEAST_Z = 4.0
MAX_TRAIN_DOCS = 6000
STEPS = 200
SLICE = 1 << 18

_U = np.uint32
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


@dataclass
class LinearModel:
    """``weight`` (regression weight times log-count ratio) for every hash bucket; 0: not used."""

    weight: np.ndarray
    bias: float


def _grams(b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(order, bucket of every n-gram) of folded bytes."""
    h = b.copy()
    for n in range(2, max(ORDERS) + 1):
        if len(b) < n:
            return
        h = h[:-1] * _U(0x01000193) + b[n - 1:]
        if n in ORDERS:
            x = (h ^ (h >> _U(15))) * _U(0x85EBCA6B) + _U(n)
            x = (x ^ (x >> _U(13))) * _U(0xC2B2AE35)
            yield n, x >> _U(32 - BITS)


def hits(raw: np.ndarray, off: np.ndarray, used: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Distinct (row, feature) of texts where ``used[feature]``, slice by slice:
    (first row, end row, rows, features). A text longer than a slice is read in
    pieces that overlap by the longest order."""
    for a, b in row_slices(off, SLICE):
        lo, hi = int(off[a]), int(off[b])
        rows, feats = [], []
        for p in range(lo, max(hi, lo + 1), SLICE):
            q = min(hi, p + SLICE + max(ORDERS) - 1)
            piece = _FOLD[raw[p:q]]
            for n, bucket in _grams(piece):
                start = min(len(bucket), SLICE)
                at = np.flatnonzero(used[bucket[:start]])
                if len(at):
                    row = np.searchsorted(off[a:b + 1], at + p, side="right") - 1
                    inside = at + p + n <= off[a + 1 + row]
                    rows.append(row[inside])
                    feats.append(bucket[at[inside]].astype(np.int64))
        if rows:
            key = np.unique((np.concatenate(rows) << BITS) | np.concatenate(feats))
            yield a, b, (key >> BITS) + a, (key & ((1 << BITS) - 1)).astype(np.int64)


def _counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold each feature, summed over the task's rows."""
    sums = np.zeros((2, 1 << BITS), np.int64)
    every = np.ones(1 << BITS, bool)
    for b in it:
        raw, off = text_bytes(b.column("text"))
        label = b.column("label").to_numpy(zero_copy_only=False)
        for _, _, row, feat in hits(raw, off, every):
            for y in (0, 1):
                sums[y] += np.bincount(feat[label[row] == y], minlength=1 << BITS)
    seen = np.flatnonzero(sums.sum(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(seen), pa.array(sums[0, seen]), pa.array(sums[1, seen])], names=["feature", "n0", "n1"]
    )


def fit_linear(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, steps: int = STEPS,
               l2: float = 1e-3, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Logistic regression by full-batch Adam on binary features times ``ratio``."""
    y = np.asarray(labels, float)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    val = ratio[col]
    w, b = np.zeros(len(ratio)), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(row, val * w[col], len(y)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(y)
        gw = np.bincount(col, val * g[row], len(w)) + l2 * w
        gb = float(g.sum())
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = rate * (1 - t / (steps + 1))
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, b


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, keep: int = KEEP) -> LinearModel:
    """Fit on a bounded sample of the labelled documents that are not held out.

    Without labelled documents of both classes every score is the (smoothed)
    share of label 1.
    """
    sample = saved(sample_rows(docs, labels, "toxic", 4, 2, max_docs), "toxicity-sample")
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    weight = np.zeros(1 << BITS)
    if not n0 or not n1:
        return LinearModel(weight.astype(np.float32), float(np.log((n1 + 0.5) / (n0 + 0.5))))
    counted = sample.select("text", "label").mapInArrow(_counts, "feature long, n0 long, n1 long")
    c = counted.groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    feature = c.column("feature").to_numpy()
    k0, k1 = c.column("n0").to_numpy(), c.column("n1").to_numpy()
    ratio = np.log(((k1 + 1) / (n1 + 2)) / ((k0 + 1) / (n0 + 2)))
    share = (k0 + k1 + 1) / (n0 + n1 + 2)
    z = np.abs(k1 / n1 - k0 / n0) / np.sqrt(share * (1 - share) * (1 / n0 + 1 / n1))
    best = np.lexsort((feature, -z))[:keep]
    best = best[z[best] >= LEAST_Z]
    chosen = np.sort(feature[best])
    used = np.zeros(1 << BITS, bool)
    used[chosen] = True
    scale = np.zeros(1 << BITS)
    scale[feature] = ratio

    def pick(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            raw, off = text_bytes(b.column("text"))
            got: list[np.ndarray] = [np.zeros(0, np.int32)] * b.num_rows
            for lo, hi, row, feat in hits(raw, off, used):
                cut = np.searchsorted(row, np.arange(lo, hi + 1))
                for i in range(lo, hi):
                    got[i] = feat[cut[i - lo]:cut[i - lo + 1]].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("label"), pa.array(got, pa.list_(pa.int32()))],
                names=["doc_id", "label", "features"],
            )

    rows = sample.select("doc_id", "label", "text").mapInArrow(
        pick, f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, label int, features array<int>"
    ).collect()  # at most max_docs rows of at most ``keep`` features
    rows.sort(key=lambda r: r["doc_id"])
    place = np.zeros(1 << BITS, np.int64)
    place[chosen] = np.arange(len(chosen))
    w, b = fit_linear([place[np.array(r["features"], np.int64)] for r in rows],
                      np.array([r["label"] for r in rows]), scale[chosen])
    weight[chosen] = w * scale[chosen]
    return LinearModel(weight.astype(np.float32), b)


def score_texts(model: LinearModel, column: pa.Array) -> np.ndarray:
    """Probabilities for a text column; null and empty texts have the bias alone."""
    raw, off = text_bytes(column)
    z = np.full(len(column), model.bias)
    used = model.weight != 0
    for _, _, row, feat in hits(raw, off, used):
        z += np.bincount(row, model.weight[feat].astype(np.float64), len(z))
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def score_toxicity(docs: DataFrame, model: LinearModel, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if score >= threshold).

    Only the text is read; equal texts score equally. Input columns called
    ``score`` or ``predicted`` are replaced.
    """
    return score_frame(docs, lambda column: score_texts(model, column), threshold)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Train and score: doc_id, held_out, score, predicted for every document."""
    scored = score_toxicity(docs.select("doc_id", "text"), train(docs, labels), threshold)
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")
