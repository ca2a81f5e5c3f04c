"""Word and n-gram hashing of Arrow text columns with numpy, in bounded memory.

A task gets its texts as Arrow record batches. The helpers here look at the
UTF-8 bytes of a column in place and work in slices of about ``SLICE_BYTES``,
so their memory does not depend on the batch or on the length of a text (a
text is hashed piece by piece; only 16 bytes per word are kept).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_U = np.uint64


def _random_words(seed: int, n: int) -> np.ndarray:
    """``n`` 64-bit words of splitmix64, the same on every machine."""
    with np.errstate(over="ignore"):
        x = _U(seed) + np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
        return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the 64-bit word."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(n, base, dtype=_U)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=_U)


_BASE = 0x9B97F4A7C15F39D5
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the rolling base and of its inverse, made once per task and never shipped."""

    def __init__(self) -> None:
        self.made: tuple[np.ndarray, np.ndarray] | None = None

    def __reduce__(self):
        return _Powers, ()

    def get(self) -> tuple[np.ndarray, np.ndarray]:
        if self.made is None:
            self.made = _powers(_BASE, SLICE_BYTES + 1), _powers(_INVERSE, SLICE_BYTES + 1)
        return self.made


_TABLES = _Powers()


@dataclass(frozen=True)
class WordRule:
    """Which bytes separate words and what each byte counts as."""

    separator: np.ndarray
    value: np.ndarray


def _rule(separators: bytes, fold_case: bool) -> WordRule:
    sep = np.zeros(256, dtype=bool)
    sep[list(separators)] = True
    value = _random_words(7, 256)
    if fold_case:
        value[65:91] = value[97:123]
    return WordRule(sep, value)


#: Words are runs of bytes other than space and tab..carriage return, unchanged.
PLAIN = _rule(b"\x20\x09\x0a\x0b\x0c\x0d", False)
#: Words are runs of ASCII letters, digits and bytes above ASCII; ASCII case is folded.
FOLDED = _rule(
    bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122)), True
)


@dataclass
class Words:
    """Words of one slice of texts, in order.

    ``row`` are the batch rows of the slice; ``first`` (one longer) are the
    offsets of each row's words; ``start``/``end`` are byte positions in
    ``data``; ``hash`` is a 64-bit word hash.
    """

    row: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray

    def text(self, i: int) -> str:
        return self.data[self.start[i]:self.end[i]].tobytes().decode("utf-8", "replace")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column; null texts have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, dtype=kind, count=column.offset + n + 1)[column.offset:]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off.astype(np.int64)


def row_slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes together (a longer row is alone)."""
    n, a = len(off) - 1, 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def _hash_bytes(raw: np.ndarray, lo: int, hi: int, cuts: np.ndarray, rule: WordRule):
    """Word starts, ends and hashes of raw[lo:hi]; words also end at ``cuts``."""
    pow_, inv = _TABLES.get()
    starts, ends, hashes = [], [], []
    carry_start, carry = -1, _U(0)  # a word that runs over the end of a piece
    p = lo
    with np.errstate(over="ignore"):
        while p < hi:
            q = min(hi, p + SLICE_BYTES)
            b = raw[p:q]
            word = ~rule.separator[b]
            edge = np.empty(len(b) + 1, dtype=bool)
            edge[0], edge[-1] = word[0], word[-1]
            np.not_equal(word[1:], word[:-1], out=edge[1:-1])
            inner = cuts[np.searchsorted(cuts, p, "right"):np.searchsorted(cuts, q, "left")] - p
            split = np.unique(inner[word[inner] & word[inner - 1]])  # empty rows repeat a cut
            pos = np.flatnonzero(edge)
            if len(split):
                pos = np.sort(np.concatenate([pos, split, split]), kind="stable")
            s, e = pos[0::2], pos[1::2]
            pre = np.empty(len(b) + 1, dtype=_U)
            pre[0] = 0
            np.cumsum(rule.value[b] * pow_[:len(b)], out=pre[1:])
            h = (pre[e] - pre[s]) * inv[s]
            if carry_start >= 0:
                if len(s) and s[0] == 0 and not np.any(cuts == p):
                    n = p - carry_start
                    h[0] = carry + h[0] * _U(pow(_BASE, n, 1 << 64))
                    s = s.copy()
                    s[0] = carry_start - p
                else:
                    starts.append(np.array([carry_start]))
                    ends.append(np.array([p]))
                    hashes.append(np.array([carry], dtype=_U))
                carry_start = -1
            if q < hi and len(e) and e[-1] == len(b):
                carry_start, carry = int(s[-1]) + p, h[-1]
                s, e, h = s[:-1], e[:-1], h[:-1]
            starts.append(s + p)
            ends.append(e + p)
            hashes.append(h)
            p = q
        if not starts:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0, _U)
        return np.concatenate(starts), np.concatenate(ends), mix(np.concatenate(hashes))


def words_of(column: pa.Array, rule: WordRule = PLAIN, limit: int = SLICE_BYTES) -> Iterator[Words]:
    """The words of a text column, slice by slice of rows."""
    raw, off = text_bytes(column)
    for a, b in row_slices(off, limit):
        s, e, h = _hash_bytes(raw, int(off[a]), int(off[b]), off[a + 1:b], rule)
        first = np.searchsorted(s, off[a:b + 1], side="left")
        yield Words(np.arange(a, b), first, s, e, h, raw)


def gram_hashes(h: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hashes of every run of ``k`` consecutive words (``len(h) - k + 1`` of them).

    Runs over the end of a row are included; the caller masks them with
    :func:`starts_inside`.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    base = int(_random_words(seed, 1)[0]) | 1
    q = _U(base)
    with np.errstate(over="ignore"):
        out = h[k - 1:].copy()
        if k <= 8:
            for j in range(k - 2, -1, -1):  # Horner's rule
                out = out * q + h[j:j + n]
        else:
            pw = _powers(base, len(h))
            pre = np.empty(len(h) + 1, dtype=_U)
            pre[0] = 0
            np.cumsum(h * pw, out=pre[1:])
            out = (pre[k:] - pre[:-k]) * _powers(pow(base, -1, 1 << 64), n)
        return mix(out)


def span_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of the word runs [start, end) of any lengths."""
    base = int(_random_words(seed, 1)[0]) | 1
    with np.errstate(over="ignore"):
        pre = np.empty(len(h) + 1, dtype=_U)
        pre[0] = 0
        np.cumsum(h * _powers(base, len(h)), out=pre[1:])
        out = (pre[end] - pre[start]) * _powers(pow(base, -1, 1 << 64), len(h) + 1)[start]
        return mix(out + (end - start).astype(_U))


def starts_inside(first: np.ndarray, k: int) -> np.ndarray:
    """For runs of ``k`` words over a slice: does the run stay inside one row?"""
    total = int(first[-1])
    ok = np.ones(max(0, total - k + 1), dtype=bool)
    for j in range(1, k):
        at = first[1:-1] - j
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


def row_of(first: np.ndarray) -> np.ndarray:
    """The row (counted in the slice) of every word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of ``w`` values (``len(x) - w + 1`` of them)."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    out, span = x, 1
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[:n], out[w - span:w - span + n])
