"""Spelling variants against plain Python over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from shredkit.llm import variants
from shredkit.llm.variants import count_words, group_variants, near_words


def brute_counts(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
            n[word] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(n):
    near = {w: [v for v in n if is_near(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 5 * n[w]}
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


def found(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def misspelt(seed, n):
    """Texts of few words in very different numbers, with edits (runs of equal letters too)."""
    r = random.Random(seed)
    words = ["committee", "commmittee", "address", "façade", "façades", "straße", "ÀÉÎÕÜ", "letters", "letterss", "aaaaaa"]
    out = []
    for i in range(n):
        said = []
        for _ in range(300):
            w = words[min(int(r.expovariate(0.7)), len(words) - 1)]
            if r.random() < 0.1:
                at = r.randrange(len(w))
                w = r.choice([w[:at] + w[at + 1:], w[:at] + r.choice("aét") + w[at:], w[:at] + "s" + w[at + 1:]])
            said.append(w.upper() if r.random() < 0.1 else w)
        out.append((i, r.choice([" ", "-", "1", "×2 ", "Ā"]).join(said)))
    chain = ["gardener"] * 300 + ["gardenir"] * 50 + ["gardinir"] * 7  # two steps to the root
    return [*out, (n, " ".join(chain)), (None, "gardinir"), (n + 1, None)]


@pytest.mark.parametrize("limit", [1 << 22, 64])
def test_variants_equal_all_pairs(spark, monkeypatch, limit):
    monkeypatch.setattr(variants, "SLICE_BYTES", limit)
    monkeypatch.setattr(variants, "HELD", 4 if limit == 64 else 1 << 18)
    docs = misspelt(3, 40)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute(brute_counts(docs))
    assert len(want) > 80 and any(v[1] not in (w, v[0]) for w, v in want.items())  # a chain of forms
    assert found(group_variants(df)) == want


def test_messy_rows(spark, messy):
    docs = [(r["doc_id"], r["text"]) for r in messy.select("doc_id", "text").collect()]
    assert found(group_variants(messy)) == brute(brute_counts(docs))


def test_no_words(spark, nothing):
    assert group_variants(nothing).collect() == []
    few = spark.createDataFrame([(1, "shorty only once here")], "doc_id long, text string")
    assert group_variants(few).collect() == []


def test_long_runs_and_runs_at_row_borders(spark):
    docs = [(i, t) for i in range(250) for t in ["abcdef", "abcdef", "q" * 100, "xyzxyz" * 30_000 if i < 6 else "é" * 70]]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    got = {r["word"]: r["n"] for r in count_words(df).collect()}
    assert got == brute_counts(docs)


def test_groups_that_cross_batches():
    rows = [("b$a", s, "a" + s + "b", 5) for s in ("", "c", "d")] + [("x$", "y", "yx", 5)]
    t = pa.table({"prefix": [r[0] for r in rows], "skipped": [r[1] for r in rows], "word": [r[2] for r in rows],
                  "n": pa.array([r[3] for r in rows], pa.int64())})
    whole = [b.to_pydict() for b in variants._scan(iter(t.to_batches()))]
    split = [b.to_pydict() for b in variants._scan(iter(t.to_batches(max_chunksize=1)))]
    assert whole == split
    assert whole[0]["n_near"] == [2, 2, 2]


def test_deleting_from_a_run_of_equal_letters_counts_once(spark):
    words = spark.createDataFrame([("letterss", 9), ("letters", 50), ("lettters", 5)], "word string, n long")
    got = {r["word"]: (r["n_near"], r["near"]) for r in near_words(words).collect()}
    assert got == {"letterss": (1, "letters"), "letters": (2, "letterss"), "lettters": (1, "letters")}
