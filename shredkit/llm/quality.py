"""Quality classifier: a byte-level convolutional network in numpy.

Every byte of a text is embedded; ``FILTERS`` learned filters, ``WIDTH`` bytes
wide, move over the text in steps of ``STEP`` bytes. The text is covered by
chunks of ``CHUNK`` bytes that overlap by half. Each filter is max-pooled in
each chunk, and the pooled values of all chunks (their mean, largest and
smallest over the document) are combined into one probability by a logistic
layer. Embedding, filters and logistic layer are trained together.

The network is fitted on the driver on at most ``MAX_TRAIN_DOCS`` labelled
documents and at most ``MAX_TRAIN_BYTES`` of their text (both parameters); all
documents are scored in tasks, whole, one slice of bytes after another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shredkit.llm.labels import held_out, score_frame, training_sample
from shredkit.llm.words import text_bytes

EMBED, WIDTH, STEP, FILTERS = 8, 8, 2, 32
BLOCK, CHUNK_BLOCKS = 128, 4
CHUNK = BLOCK * CHUNK_BLOCKS
SLICE_BLOCKS = 512
PER_BLOCK = BLOCK // STEP

MAX_TRAIN_DOCS = 3000
MAX_TRAIN_BYTES = 24 << 20
EPOCHS = 8


@dataclass
class Network:
    embed: np.ndarray  # (256, EMBED)
    filters: np.ndarray  # (WIDTH * EMBED, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (3 * FILTERS,)
    out_bias: np.ndarray  # (1,)
    mean: np.ndarray  # (3 * FILTERS,) of the combined features over the training documents
    scale: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.out_bias]


def new_network(seed: int = 5) -> Network:
    r = np.random.Generator(np.random.PCG64(seed))
    f32 = np.float32
    return Network(
        r.normal(0, 1, (256, EMBED)).astype(f32),
        r.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH * EMBED, FILTERS)).astype(f32),
        np.zeros(FILTERS, f32), np.zeros(3 * FILTERS, f32), np.zeros(1, f32),
        np.zeros(3 * FILTERS, f32), np.ones(3 * FILTERS, f32),
    )


def _blocks(raw: np.ndarray) -> np.ndarray:
    """A text as rows of BLOCK bytes, each followed by the first bytes of the next row."""
    n = max(1, -(-len(raw) // BLOCK))
    padded = np.zeros((n + 1) * BLOCK, np.uint8)
    padded[:len(raw)] = raw
    return np.lib.stride_tricks.as_strided(padded, (n, BLOCK + WIDTH - STEP), (BLOCK, 1))


def _windows(net: Network, blocks: np.ndarray) -> np.ndarray:
    """Embedded bytes under every filter position: (blocks * PER_BLOCK, WIDTH * EMBED)."""
    e = net.embed[blocks]  # (n, BLOCK + WIDTH - STEP, EMBED)
    n = len(blocks)
    s = e.strides
    view = np.lib.stride_tricks.as_strided(
        e, (n, PER_BLOCK, WIDTH * EMBED), (s[0], STEP * s[1], s[2])
    )
    return view.reshape(n * PER_BLOCK, WIDTH * EMBED)


def _block_maxima(net: Network, blocks: np.ndarray) -> np.ndarray:
    """Largest response of each filter in each block, before the bias."""
    return (_windows(net, blocks) @ net.filters).reshape(len(blocks), PER_BLOCK, FILTERS).max(axis=1)


def _chunk_starts(n_blocks: int) -> np.ndarray:
    """First blocks of the chunks: half overlapping, the last one ends with the text."""
    return np.arange(0, max(1, n_blocks - CHUNK_BLOCKS // 2), CHUNK_BLOCKS // 2)


def _combine(pooled: np.ndarray, doc_of: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean, largest and smallest pooled value over the chunks of each document."""
    count = np.diff(np.append(first, len(pooled)))[:, None]
    total = np.add.reduceat(pooled, first, axis=0, dtype=np.float64)
    return np.concatenate([
        (total / count).astype(np.float32),
        np.maximum.reduceat(pooled, first, axis=0), np.minimum.reduceat(pooled, first, axis=0),
    ], axis=1)


def _features(net: Network, maxima: np.ndarray, n_blocks: np.ndarray) -> np.ndarray:
    """Combined features of documents whose blocks follow each other in ``maxima``."""
    begin = np.cumsum(n_blocks) - n_blocks
    starts = [_chunk_starts(int(n)) for n in n_blocks]
    n_chunks = np.array([len(s) for s in starts])
    doc_of = np.repeat(np.arange(len(n_blocks)), n_chunks)
    start = np.concatenate(starts) + begin[doc_of]
    last = (begin + n_blocks - 1)[doc_of]
    pooled = maxima[start]
    for j in range(1, CHUNK_BLOCKS):
        pooled = np.maximum(pooled, maxima[np.minimum(start + j, last)])
    pooled = np.maximum(pooled + net.bias, 0)
    first = np.cumsum(n_chunks) - n_chunks
    return _combine(pooled, doc_of, first)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def score_texts(net: Network, texts: list[np.ndarray]) -> np.ndarray:
    """Probabilities of texts given as byte arrays. Texts are processed in slices of
    SLICE_BLOCKS blocks, so memory depends on neither their number nor their length
    (but for FILTERS floats per block)."""
    maxima, counts, waiting, room = [], [], [], 0

    def flush() -> None:
        nonlocal waiting, room
        if waiting:
            maxima.append(_block_maxima(net, np.concatenate(waiting)))
        waiting, room = [], 0

    for t in texts:
        b = _blocks(t)
        counts.append(len(b))
        for a in range(0, len(b), SLICE_BLOCKS):
            piece = b[a:a + SLICE_BLOCKS]
            waiting.append(piece)
            room += len(piece)
            if room >= SLICE_BLOCKS:
                flush()
    flush()
    x = _features(net, np.concatenate(maxima), np.array(counts))
    x = (x - net.mean) / net.scale
    # einsum adds in one order for any number of rows: a text's score depends on nothing else
    z = np.einsum("ij,j->i", x.astype(np.float64), net.out.astype(np.float64))
    return np.round(_sigmoid(z + float(net.out_bias[0])), 6)


def _gradients(net: Network, blocks: np.ndarray, n_blocks: np.ndarray, y: np.ndarray, l2: float):
    """Gradients of the mean log loss over a batch, by hand."""
    w = _windows(net, blocks)
    act = (w @ net.filters).reshape(len(blocks), PER_BLOCK, FILTERS)
    at = act.argmax(axis=1)
    maxima = np.take_along_axis(act, at[:, None, :], axis=1)[:, 0, :]
    begin = np.cumsum(n_blocks) - n_blocks
    starts = [_chunk_starts(int(n)) for n in n_blocks]
    n_chunks = np.array([len(s) for s in starts])
    doc_of = np.repeat(np.arange(len(n_blocks)), n_chunks)
    start = np.concatenate(starts) + begin[doc_of]
    last = (begin + n_blocks - 1)[doc_of]
    member = np.stack([np.minimum(start + j, last) for j in range(CHUNK_BLOCKS)])  # (4, chunks)
    best = maxima[member].argmax(axis=0)  # (chunks, FILTERS)
    block = np.take_along_axis(member[:, :, None], best[None], axis=0)[0]
    f = np.arange(FILTERS)
    pre = maxima[block, f] + net.bias
    pooled = np.maximum(pre, 0)
    first = np.cumsum(n_chunks) - n_chunks
    raw = _combine(pooled, doc_of, first)
    x = (raw - net.mean) / net.scale
    p = _sigmoid(x @ net.out + net.out_bias)
    g = ((p - y) / len(y)).astype(np.float32)
    d_out, d_bias = x.T @ g + l2 * net.out, g.sum(keepdims=True)
    dx = (g[:, None] * net.out) / net.scale  # (docs, 3F)
    d_pool = (dx[:, :FILTERS] / n_chunks[:, None])[doc_of]
    largest, smallest = raw[:, FILTERS:2 * FILTERS][doc_of], raw[:, 2 * FILTERS:][doc_of]
    for part, ref in ((1, largest), (2, smallest)):
        hit = pooled == ref
        ties = np.maximum(np.add.reduceat(hit.astype(np.float32), first, axis=0), 1)[doc_of]
        d_pool = d_pool + hit * dx[:, part * FILTERS:(part + 1) * FILTERS][doc_of] / ties
    d_pool = np.where(pre > 0, d_pool, 0).astype(np.float32)
    row = block * PER_BLOCK + at[block, f]  # (chunks, FILTERS): filter position that won
    d_filters, d_w = np.empty_like(net.filters), np.zeros((256, EMBED), np.float32)
    for k in range(FILTERS):
        src = w[row[:, k]]
        d_filters[:, k] = src.T @ d_pool[:, k]
        under = blocks[block[:, k][:, None], (at[block[:, k], k] * STEP)[:, None] + np.arange(WIDTH)]
        share = d_pool[:, k][:, None, None] * net.filters[:, k].reshape(WIDTH, EMBED)[None]
        for e in range(EMBED):
            d_w[:, e] += np.bincount(under.ravel(), share[:, :, e].ravel(), 256).astype(np.float32)
    return [d_w, d_filters, d_pool.sum(axis=0), d_out, d_bias]


def fit(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5,
        rate: float = 0.01, batch: int = 32, l2: float = 1e-3) -> Network:
    """Adam on the log loss. Without documents of both classes the score is the
    (smoothed) share of label 1."""
    net = new_network(seed)
    y = np.asarray(labels, np.float32)
    share = (y.sum() + 0.5) / (len(y) + 1)
    net.out_bias[:] = np.log(share / (1 - share))
    if len(y) == 0 or y.min() == y.max():
        return net
    all_blocks = [_blocks(t) for t in texts]
    r = np.random.Generator(np.random.PCG64(seed + 1))
    probe = r.permutation(len(y))[:256]
    x = _features(net, _block_maxima_of(net, [all_blocks[i] for i in probe]),
                  np.array([len(all_blocks[i]) for i in probe]))
    net.mean, net.scale = x.mean(axis=0), x.std(axis=0) + np.float32(0.05)
    params = net.parameters()
    m = [np.zeros_like(p) for p in params]
    v = [np.zeros_like(p) for p in params]
    t = 0
    for epoch in range(epochs):
        order = r.permutation(len(y))
        # texts of about one length together: a batch is one array of blocks
        for a in range(0, len(order), batch):
            pick = order[a:a + batch]
            blocks = np.concatenate([all_blocks[i] for i in pick])
            grads = _gradients(net, blocks, np.array([len(all_blocks[i]) for i in pick]), y[pick], l2)
            t += 1
            step = rate * (1 - epoch / epochs)
            for p, g, mm, vv in zip(params, grads, m, v, strict=True):
                mm += 0.1 * (g - mm)
                vv += 0.01 * (g * g - vv)
                p -= step * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.99**t)) + 1e-8)
    return net


def _block_maxima_of(net: Network, many: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([
        _block_maxima(net, b[a:a + SLICE_BLOCKS]) for b in many for a in range(0, len(b), SLICE_BLOCKS)
    ])


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS,
          max_bytes: int = MAX_TRAIN_BYTES, epochs: int = EPOCHS) -> Network:
    """Fit on a bounded sample of the labelled documents that are not held out."""
    rows = training_sample(docs, labels, "quality", 5, 0, max_docs, max_bytes)
    texts = [np.frombuffer(r["text"], np.uint8) for r in rows]
    return fit(texts, np.array([r["label"] for r in rows]), epochs)


def score_quality(docs: DataFrame, net: Network, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if score >= threshold).

    Only the text is read. Null texts score like empty ones, which score like
    a block of zero bytes; equal texts score equally (scores are rounded to six
    places, beyond float32 noise). Input columns called ``score`` or
    ``predicted`` are replaced.
    """
    def scores(column: pa.Array) -> np.ndarray:
        raw, off = text_bytes(column)
        out = np.empty(len(column))
        for a in range(0, len(column), 64):
            b = min(a + 64, len(column))
            out[a:b] = score_texts(net, [raw[off[i]:off[i + 1]] for i in range(a, b)])
        return out

    return score_frame(docs, scores, threshold)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Train and score: doc_id, held_out, score, predicted for every document."""
    net = train(docs, labels)
    scored = score_quality(docs.select("doc_id", "text"), net, threshold)
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


