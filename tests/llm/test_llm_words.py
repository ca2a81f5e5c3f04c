"""The word hashing kernels against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from shredkit.llm import words as W

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\t\n\x0b!Z", max_size=30)), max_size=8)


def plain_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(1, 40))
def test_words_are_the_words_of_each_row(texts, limit):
    seen = []
    for w in W.words_of(pa.array(texts, pa.string()), W.PLAIN, limit):
        for i in range(len(w.row)):
            seen.append([w.text(j) for j in range(w.first[i], w.first[i + 1])])
    assert seen == [plain_words(t) for t in texts]


def test_empty_rows_between_words():
    w = list(W.words_of(pa.array(["a", "", None, "b", "c"])))[0]
    assert np.diff(w.first).tolist() == [1, 0, 0, 1, 1]
    assert [w.text(j) for j in range(3)] == ["a", "b", "c"]


@settings(max_examples=100, deadline=None)
@given(TEXT)
def test_hashes_depend_on_the_word_alone(texts):
    found = {}
    for w in W.words_of(pa.array(texts, pa.string())):
        for j in range(len(w.start)):
            assert found.setdefault(w.text(j), w.hash[j]) == w.hash[j]
    assert len(set(found.values())) == len(found)


def test_a_word_across_pieces_hashes_like_any_other():
    long = "c" * (W.SLICE_BYTES + 77)
    a, b = (list(W.words_of(pa.array([t])))[0] for t in ("x " * 5000 + long, long))
    assert a.hash[-1] == b.hash[0]
    assert a.text(len(a.start) - 1) == long


def test_folded_words():
    w = list(W.words_of(pa.array(["The CAT-sat; on"]), W.FOLDED))[0]
    v = list(W.words_of(pa.array(["the cat sat on"]), W.FOLDED))[0]
    assert (w.hash == v.hash).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.integers(1, 12))
def test_gram_and_span_hashes(values, k):
    h = W.mix(np.array(values, np.uint64))
    g = W.gram_hashes(h, k)
    grams = [tuple(values[i:i + k]) for i in range(len(values) - k + 1)]
    assert len(g) == len(grams)
    assert len(set(g.tolist())) == len(set(grams))
    s = np.arange(len(grams))
    spans = W.span_hashes(h, s, s + k, 5)
    assert len(set(spans.tolist())) == len(set(grams))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 99), min_size=1, max_size=60), st.integers(1, 20))
def test_sliding_min(values, w):
    got = W.sliding_min(np.array(values), w).tolist()
    assert got == [min(values[i:i + w]) for i in range(len(values) - w + 1)]
