"""Filter audit: the byte pass against plain Python, the audit against evaluating every order."""

import hashlib
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from shredkit.llm import filters
from shredkit.llm.filters import Profile, audit_filters, distinct_spans, profile
from shredkit.llm.words import text_bytes

TEXTS = [None, "", " \t\n", "a", "a a A", "one\x0btwo\x0cone", "é É é $5 #x |", "中文 中文", "x" * 200 + " " + "x" * 200,
         "x" * 199 + "y " + "x" * 200, "\x1f\x00 \x00", "END", "end END &", "tail ", " head"]


def plain(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    return (len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall("[#$%&*|]", text)))


def profiled(texts):
    raw, off = text_bytes(pa.array(texts, pa.string()))
    p = Profile(raw, off)
    return [tuple(int(x) for x in r) for r in zip(p.words, p.distinct, p.capitals, p.points, p.symbols)]


@pytest.mark.parametrize("piece", [1 << 20, 1, 2, 7])
def test_profile_equals_plain_counts(monkeypatch, piece):
    monkeypatch.setattr(filters, "PIECE_BYTES", piece)
    assert profiled(TEXTS) == [plain(t) for t in TEXTS]


def test_equal_hashes_do_not_merge_words():
    raw, off = text_bytes(pa.array(["aa ab aa ba aaaaaaaa aaaaaaab aa"], pa.string()))
    p = Profile(raw, off)
    first = distinct_spans(raw, p.row, p.start, p.end, np.zeros(len(p.start), np.uint64))
    assert [raw[p.start[i]:p.end[i]].tobytes().decode() for i in first] == ["aa", "ab", "ba", "aaaaaaaa", "aaaaaaab"]


def test_the_end_of_a_long_text_counts():
    text = "w " * 900_000 + "Z $ é" + "q" * 3_000_000
    assert profiled([text, "a"]) == [plain(text), plain("a")]


def brute(docs, labels):
    """Every document through every order."""
    rows = []
    for doc_id, text, source in docs:
        n, distinct, capitals, points, symbols = plain(text)
        earlier = [d for d, t, _ in docs if (t or "") == (text or "") and d is not None and doc_id is not None and d < doc_id]
        fails = {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals > 2 * points, "D": symbols > 0,
                 "E": bool(earlier)}
        good = any(d == doc_id and q == 1 for d, q, _ in labels) if doc_id is not None else False
        toxic = any(d == doc_id and t == 1 for d, _, t in labels) if doc_id is not None else False
        rows.append((source or "", {f for f, bad in fails.items() if bad}, good, toxic))
    out = {}
    total = {}
    for part in {r[0] for r in rows}:
        here = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            gone = set()
            for step, f in enumerate(order, 1):
                hit = [r for r in here if f in r[1] and not r[1] & gone]
                kept = sum(not r[1] & (gone | {f}) for r in here)
                redundant = sum(f in r[1] and bool(r[1] & gone) for r in here)
                alone = sum(r[1] == {f} for r in here)
                out[part, "".join(order), step] = [kept, len(hit), redundant, alone, sum(r[2] for r in hit),
                                                   sum(r[3] for r in hit)]
                total[part, f] = total.get((part, f), 0) + len(hit)
                gone.add(f)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_every_order_on_messy_rows(spark, messy):
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (4, None, 1), (None, 1, 1), (7, 1, 1), (99, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"],
                                                     r["good_lost"], r["toxic_lost"], r["shapley"])
           for r in audit_filters(messy, table).collect()}
    docs = [(r["doc_id"], r["text"], r["source"]) for r in messy.select("doc_id", "text", "source").collect()]
    assert got == brute(docs, labels)
    assert ("", "ABCDE", 1) in got  # the null source


def test_audit_of_nothing(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_filters(nothing, labels).collect() == []


def test_own_filters(spark, messy):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = audit_filters(messy, labels, {"S": "n_words < 5", "R": "repeated"}).collect()
    assert {(r["filter_order"], r["step"]) for r in rows} == {("SR", 1), ("SR", 2), ("RS", 1), ("RS", 2)}
    with pytest.raises(ValueError):
        audit_filters(messy, labels, {})


def test_digest_is_of_the_whole_text(spark, messy):
    for r in profile(messy, keep=("doc_id", "text")).collect():
        assert bytes(r["digest"]) == hashlib.sha256((r["text"] or "").encode()).digest()
