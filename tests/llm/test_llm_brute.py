"""Classifier scores by plain loops over bytes, and license finds by aligning every place."""

import math
import random

import numpy as np
import pytest
from conftest import prose

from shredkit.llm import licenses, quality, toxicity
from shredkit.llm.queries import table

TEXTS = ["", "a", "Short TEXT.", "é ü ñ " * 40, prose(5, 90), prose(6, 400), "x" * 127, "y" * 128, "z" * 129, "w" * 513, prose(7, 2000)]


def plain_quality(net, text):
    """The network's score of one text: every filter at every place of every chunk."""
    raw = text.encode()
    n = max(1, math.ceil(len(raw) / quality.BLOCK))
    padded = raw + bytes((n + 1) * quality.BLOCK - len(raw))
    pooled = []
    for start in range(0, max(1, n - quality.CHUNK_BLOCKS // 2), quality.CHUNK_BLOCKS // 2):
        end = min(start + quality.CHUNK_BLOCKS, n)
        best = np.full(quality.FILTERS, -np.inf)
        for at in range(start * quality.BLOCK, end * quality.BLOCK, quality.STEP):
            window = list(padded[at:at + quality.WIDTH])
            seen = np.concatenate([net.embed[byte] for byte in window]).astype(np.float64)
            best = np.maximum(best, seen @ net.filters.astype(np.float64))
        pooled.append(np.maximum(best + net.bias, 0))
    p = np.array(pooled)
    x = (np.concatenate([p.mean(axis=0), p.max(axis=0), p.min(axis=0)]) - net.mean) / net.scale
    return 1 / (1 + math.exp(-float(x @ net.out + net.out_bias[0])))


def plain_toxicity(model, text):
    """The linear score of one text: its distinct byte n-grams, hashed one by one."""
    raw = [32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in text.encode()]
    features = set()
    for n in toxicity.ORDERS:
        for i in range(len(raw) - n + 1):
            h = raw[i]
            for c in raw[i + 1:i + n]:
                h = (h * 0x01000193 + c) & 0xFFFFFFFF
            x = ((h ^ (h >> 15)) * 0x85EBCA6B + n) & 0xFFFFFFFF
            x = ((x ^ (x >> 13)) * 0xC2B2AE35) & 0xFFFFFFFF
            features.add(x >> (32 - toxicity.BITS))
    z = model.bias + sum(float(model.weight[f]) for f in features)
    return 1 / (1 + math.exp(-z))


def _scored(spark, score, docs):
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(2)
    return {r["doc_id"]: r["score"] for r in score(df).collect()}


def test_quality_scores_equal_plain_loops(spark, sf_small, small_docs):
    net = quality.train(small_docs, table(spark, sf_small, "labels"), epochs=2)
    docs = TEXTS + [r["text"] for r in small_docs.limit(15).collect()]
    got = _scored(spark, lambda df: quality.score_quality(df, net), docs)
    for i, text in enumerate(docs):
        assert abs(got[i] - plain_quality(net, text)) < 1e-3, text[:50]


def test_the_end_of_a_very_long_text_counts_for_quality(spark, sf_small, small_docs):
    net = quality.train(small_docs, table(spark, sf_small, "labels"), epochs=1)
    head = "plain words " * 60_000
    got = _scored(spark, lambda df: quality.score_quality(df, net), [head, head + "\x01\x02#!~" * 400])
    assert got[0] != got[1]


def test_toxicity_scores_equal_plain_loops(spark, sf_small, small_docs):
    model = toxicity.train(small_docs, table(spark, sf_small, "labels"))
    docs = TEXTS + [r["text"] for r in small_docs.limit(60).collect()]
    got = _scored(spark, lambda df: toxicity.score_toxicity(df, model), docs)
    for i, text in enumerate(docs):
        assert got[i] == pytest.approx(plain_toxicity(model, text), abs=1e-6)


def aligned_everywhere(text, templates, coverage):
    """The licenses of a text by patience alignment of every window, best finds first."""
    words, *own = licenses._hashes([text, *templates.values()])
    finds = []
    for name, template in zip(templates, own):
        slack = max(2, len(template) // 4)
        for d in range(-len(template), len(words)):
            a, z = max(0, d - slack), min(len(words), d + len(template) + slack)
            got = licenses.patience(words[a:z], template) if z > a else []
            if len(got) >= coverage * len(template):
                finds.append((-len(got), -len(got) / len(template), name, a + got[0][0], a + got[-1][0] + 1))
    chosen = []
    for _, _, name, s, e in sorted(finds):
        if all(e <= c[1] or s >= c[2] for c in chosen):
            chosen.append((name, s, e))
    return chosen


@pytest.mark.parametrize("share", [0.0, 0.05, 0.12, 0.3])
def test_edited_licenses_are_found_as_by_aligning_every_place(spark, share):
    r = random.Random(int(share * 100))
    templates = {n: licenses.TEMPLATES[n] for n in ("ISC", "BSD-2-Clause", "MPL-2.0-header", "Apache-2.0-notice")}
    docs = []
    for i, (name, text) in enumerate(templates.items()):
        words = [w if r.random() >= share else r.choice(["changed", "", f"{w} added"]) for w in text.split()]
        docs.append(f"{prose(i, 60)} {' '.join(words)} {prose(50 + i, 60)}")
    docs.append(prose(9, 150) + " permission to use copy modify without fee license license the software")
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = sorted((x["doc_id"], x["license"]) for x in licenses.scan_licenses(df, templates).collect())
    want = sorted((i, name) for i, text in enumerate(docs) for name, *_ in aligned_everywhere(text, templates, licenses.COVERAGE))
    assert got == want
    assert share > 0.1 or len(want) == 4
