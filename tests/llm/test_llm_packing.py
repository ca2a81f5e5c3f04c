"""Packing: ids equal the tokenizer's, every id in one piece, sequences full."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from shredkit.llm.packing import Packer, Piece, pack_tokens
from shredkit.llm.tokens import Encoder, kind_table

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def spec():
    with open(PATH, encoding="utf-8") as f:
        return f.read()


def encoded(spec, kinds, texts):
    return [ids.tolist() for _, rows in Encoder(spec, kinds).encode(pa.array(texts, pa.string())) for ids in rows]


def test_ids_are_those_of_the_tokenizer(spec, tokenizer):
    r = random.Random(5)
    alphabet = [*"aabstmdrevl's''   \n\t\r!.,0123é ñ中文Ж 　 ’́²٣\x00\x1c\x85",
                "\U0001f600", "'s", "'ll", "'re", " '", "<|endoftext|>", "࢏", "\U000323b0"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(0, 40))) for _ in range(8000)] + [None, "", " "]
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert encoded(spec, kind_table(spec), texts) == want
    assert encoded(spec, None, texts[:500]) == want[:500]  # a tokenizer of unknown form


def test_a_long_text_is_encoded_whole(spec, tokenizer):
    text = "word's  " * 300_000 + "the end" + "x" * 5000
    assert encoded(spec, kind_table(spec), [text, "a"]) == [
        tokenizer.encode(t, add_special_tokens=False).ids for t in (text, "a")]


def check(rows, docs, tokenizer, length):
    """Round trip: the pieces of every document give its ids, the sequences are gapless and full."""
    ids = defaultdict(list)
    for doc_id, text in docs:
        ids[doc_id].append(tokenizer.encode(text or "", add_special_tokens=False).ids + [0])
    pieces = defaultdict(Counter)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]][r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
    for doc_id, copies in ids.items():
        covered = Counter()
        for (start, n, crc, total), times in pieces[doc_id].items():
            fits = [c for c in copies if len(c) == total
                    and zlib.crc32(np.array(c[start:start + n], "<u4").tobytes()) == crc]
            assert fits and n > 0
            covered.update({p: times for p in range(start, start + n)})
        assert covered == Counter(p for c in copies for p in range(len(c)))
    assert pieces.keys() == ids.keys()
    short = []
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length and at & (at - 1) == 0  # full, or a power of two: no padding
        short += [at] if at < length else []
    assert len(short) == len(set(short))  # the binary digits of one leftover


@pytest.mark.parametrize("parts", [1, 7, 150])
def test_round_trip(spark, small_docs, tokenizer, parts):
    docs = small_docs.select("doc_id", "text")
    got = pack_tokens(docs.repartition(parts), PATH).collect()
    check(got, [(r["doc_id"], r["text"]) for r in docs.collect()], tokenizer, 1024)


def test_messy_rows(spark, messy, tokenizer):
    got = pack_tokens(messy, PATH, length=64, windows=2).collect()
    check(got, [(r["doc_id"], r["text"]) for r in messy.select("doc_id", "text").collect()], tokenizer, 64)


def test_nothing(spark, nothing):
    assert pack_tokens(nothing, PATH).collect() == []
    with pytest.raises(ValueError):
        pack_tokens(nothing, PATH, length=1000)


def test_best_fit_with_few_windows():
    p = Packer(10, 0, windows=2)
    for doc, n in enumerate([6, 7, 3, 4, 9]):
        p.add(Piece(doc, 0, np.arange(n, dtype=np.uint32), n))
    # 6 and 7 open two windows; 3 fills the 7, 4 fills the 6, 9 opens the next
    assert [(r[0], r[5], r[6]) for r in p.rows] == [(1, 0, 0), (2, 0, 7), (0, 1, 0), (3, 1, 6)]
    p.add(Piece(5, 0, np.arange(5, dtype=np.uint32), 5))
    p.add(Piece(6, 0, np.arange(8, dtype=np.uint32), 8))  # fits nowhere: tops up the 9, the rest opens a window
    assert [(r[0], r[1], r[2], r[5]) for r in p.rows[4:]] == [(4, 0, 9, 2), (6, 0, 1, 2)]
    left = p.leftover()  # the windows of 7 and 5 merge into one of 10; 2 ids are left
    assert [(r[0], r[1], r[2], r[6]) for r in p.rows[6:]] == [(6, 1, 7, 0), (5, 0, 3, 7)]
    assert [(q.doc_id, q.start, len(q.ids)) for q in left] == [(5, 3, 2)]
