"""Token ids of whole texts with a public byte-level BPE tokenizer, fast enough for a corpus.

The ids are those of the tokenizer itself. It cuts a text into pieces (words with the
space before them, numbers, signs, white space) and merges within each piece, so a
piece has the same ids wherever it stands. Here numpy finds the pieces of a slice of
texts at once and only distinct pieces that the task has not met go to the tokenizer.
Texts with anything the piece finder is not sure about (code points on which the
tokenizer's own Unicode tables differ, its special tokens) are handed to it whole.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex

from shredkit.llm.words import row_slices, text_bytes

SLICE_BYTES = 1 << 22
CACHED = 1 << 19  # pieces a task remembers

#: What the tokenizer's pieces are made of (fixed values of its published pattern).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LETTER, _NUMBER, _SIGN, _SPACE, _UNSURE = range(5)
_NONE = 9
_TABLE = 0x20000
_KINDS = {_LETTER: r"\p{L}", _NUMBER: r"\p{N}", _SIGN: r"[^\s\p{L}\p{N}]", _SPACE: r"\s"}


def _byte_letters() -> dict[int, int]:
    """The letter by which a byte-level vocabulary writes each byte: printable Latin-1
    characters stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: 0x100 + i for i, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


def kind_table(spec: str) -> np.ndarray | None:
    """Kind of every code point below 0x20000, where the tokenizer agrees on it.

    None if the tokenizer is not of the known form; all texts then go to it whole.
    """
    from tokenizers import Tokenizer

    parts = json.loads(spec)
    form = parts.get("pre_tokenizer") or {}
    if parts.get("normalizer") or form.get("type") != "ByteLevel" or form.get("add_prefix_space") \
            or not form.get("use_regex", True) or parts["model"].get("type") != "BPE":
        return None
    cut = Tokenizer.from_str(spec).pre_tokenizer.pre_tokenize_str
    table = np.full(_TABLE, _UNSURE, np.uint8)
    points = "".join(chr(c) for c in range(_TABLE) if not 0xD800 <= c < 0xE000)
    for kind, pattern in _KINDS.items():
        assigned = "".join(regex.findall(rf"(?=[^\p{{Cn}}\p{{Co}}]){pattern}", points))
        for _, (a, b) in cut(assigned.replace("'", "")):
            if b - a < 2:
                continue
            # One piece of several code points: all are of the kind of its first.
            run = assigned.replace("'", "")[a:b]
            if kind == _true_kind(cut, run[0]):
                table[[ord(c) for c in run]] = kind
    table[ord("'")] = _SIGN
    return table


def _true_kind(cut, char: str) -> int:
    """What the tokenizer takes a code point for: it joins a letter, a digit or a sign before it."""
    for kind, before in ((_LETTER, "a"), (_NUMBER, "1"), (_SIGN, "!")):
        if len(cut(before + char)) == 1:
            return kind
    return _SPACE


def piece_starts(points: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces start, for code points of texts that start at ``first``."""
    n = len(points)
    head = np.zeros(n + 1, bool)
    head[first] = True
    head[n] = True
    before = np.empty(n, np.uint8)
    before[0], before[1:] = _NONE, kind[:-1]
    before[head[:n]] = _NONE
    after = np.empty(n, np.uint8)
    after[-1], after[:-1] = _NONE, kind[1:]
    after[head[1:]] = _NONE
    blank = points == 32
    led = np.zeros(n, bool)
    led[1:] = blank[:-1]
    led &= ~head[:n]  # a space before it belongs to the piece
    space = kind == _SPACE
    start = (kind != before) & ~(led & ~space)
    # White space before a word: its last character is a piece or leads the word.
    start |= space & (before == _SPACE) & (after != _SPACE) & (after != _NONE)
    # Contractions: an apostrophe that starts a piece, and s t m d, re ve ll.
    at = np.flatnonzero((points == 39) & start & (after == _LETTER))
    if len(at):
        one = points[at + 1]
        two = np.where(at + 2 < n, points[np.minimum(at + 2, n - 1)], 0)
        two = np.where(head[np.minimum(at + 2, n)], 0, two)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        size = np.where(single, 1, np.where(double, 2, 0))
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = False
        end = at + 1 + size
        inside = end < n
        end = end[inside]
        start[end[(kind[end] == _LETTER)]] = True
    start |= head[:n]
    return start


class Encoder:
    """Ids of texts, for one task. ``spec`` is the tokenizer file's JSON, ``kinds`` its table."""

    def __init__(self, spec: str, kinds: np.ndarray | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.kinds = kinds
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(first row, ids of each row) of a text column, slice by slice; null texts are empty."""
        raw, off = text_bytes(column)
        for a, b in row_slices(off, SLICE_BYTES):
            yield a, self._slice(raw[off[a]:off[b]], off[a:b + 1] - off[a])

    def _slice(self, raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        try:
            text = raw.tobytes().decode()
        except UnicodeDecodeError:  # bytes that are no UTF-8 count as U+FFFD
            texts = [raw[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(off[:-1], off[1:])]
            text = "".join(texts)
            sizes = [len(t.encode()) for t in texts]
            raw, off = np.frombuffer(text.encode(), np.uint8), np.concatenate([[0], np.cumsum(sizes)])
        n_rows = len(off) - 1
        if not len(raw):
            return [np.zeros(0, np.uint32)] * n_rows
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        byte_at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        first = np.searchsorted(byte_at, off)  # the rows' first code points, and the end
        if self.kinds is None:
            odd = np.ones(n_rows, bool)
            kind = np.full(len(points), _UNSURE, np.uint8)
        else:
            kind = np.where(points < _TABLE, self.kinds[np.minimum(points, _TABLE - 1)], _UNSURE).astype(np.uint8)
            unsure = np.concatenate([[0], np.cumsum(kind == _UNSURE)])
            odd = unsure[first[1:]] > unsure[first[:-1]]
            for s in self.special:
                at = text.find(s)
                while at >= 0:
                    odd[np.searchsorted(first, at, side="right") - 1] = True
                    at = text.find(s, at + 1)
        heads = first[:-1][first[:-1] < len(points)]
        cut = np.flatnonzero(piece_starts(points, kind, heads))
        rows = np.searchsorted(cut, first)
        edges = byte_at[np.append(cut, len(points))].astype(np.int32)
        pieces = pa.Array.from_buffers(pa.string(), len(cut), [None, pa.py_buffer(edges), pa.py_buffer(raw.tobytes())])
        if odd.any():  # their pieces are not needed
            drop = np.repeat(odd, np.diff(rows))
            keep = ~drop
            rows = np.concatenate([[0], np.cumsum(keep)])[rows]
            pieces = pieces.filter(pa.array(keep))
        coded = pieces.dictionary_encode()
        ids, size = self._pieces(coded.dictionary.to_pylist())
        begin = np.concatenate([[0], np.cumsum(size)])
        which = coded.indices.to_numpy(zero_copy_only=False)
        sizes = size[which]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        flat = ids[np.repeat(begin[which] - upto[:-1], sizes) + np.arange(upto[-1])]
        ends = upto[rows]
        out = [flat[s:e] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
        for i in np.flatnonzero(odd):
            out[i] = self._whole(text[first[i]:first[i + 1]])
        return out

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one after the other, and how many each has."""
        if len(self.known) > CACHED:
            self.known.clear()
        known, merge = self.known, self.tokenizer.model.tokenize
        for p in pieces:
            if p not in known:
                letters = p.encode().decode("latin-1").translate(_BYTE_LETTERS)
                known[p] = array("I", [t.id for t in merge(letters)]).tobytes()
        found = [known[p] for p in pieces]
        size = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        return np.frombuffer(b"".join(found), np.uint32), size
