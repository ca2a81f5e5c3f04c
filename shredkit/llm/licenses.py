"""License scan by patience alignment.

A license template is found in a text by patience alignment: words that occur
exactly once in both are anchors, the longest increasing run of them (patience
sorting) is kept, and the gaps between anchors are aligned in the same way,
where more words have become unique. ``coverage`` is the share of the
template's words that are aligned.

Only places that can reach the wanted coverage are aligned. A place is given
by a telling word of the template (any but the most common English words) and
its place in the template; it is dropped if too few of the template's words
occur in it at all, which bounds the coverage from above. So the scan loses
nothing against aligning every place, and a text of any length is scanned
whole in windows of about one template.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shredkit.llm.words import FOLDED, words_of

COVERAGE = 0.8

# License notices, headers and short texts as published.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
    "International License.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
    "If a copy of the MPL was not distributed with this file, You can obtain one at "
    "https://mozilla.org/MPL/2.0/.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this '
    "file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
    'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
    "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
    "permissions and limitations under the License.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms "
    "of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
    "License, or (at your option) any later version. This program is distributed in the hope that it will be "
    "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
    "PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    'associated documentation files (the "Software"), to deal in the Software without restriction, including '
    "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions: The above copyright notice and this permission notice shall be included in all copies "
    'or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
    "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
    "is hereby granted, provided that the above copyright notice and this permission notice appear in all "
    'copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS '
    "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
    "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
    "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
    "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are "
    "permitted provided that the following conditions are met: 1. Redistributions of source code must retain the "
    "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary "
    "form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.",
}

#: Words too common to mark a place.
COMMON = "a all and any are as at be but by can for from if in is it no not of on or that the this to was with you"


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions of equal words of ``a`` and ``b``, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        pairs = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if w in place and in_a[w] == 1]
        chain = longest_increasing(pairs)
        if not chain:
            continue
        out += chain
        edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs (ordered by their first part) that rises in the second: each
    pair goes on the leftmost pile whose top is not smaller, and points at the pile before."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        if p == len(tops):
            tops.append(j)
            piles.append(n)
        else:
            tops[p], piles[p] = j, n
        back[n] = piles[p - 1] if p else -1
    chain, n = [], piles[-1] if piles else -1
    while n >= 0:
        chain.append(pairs[n])
        n = back[n]
    return chain[::-1]


def _hashes(texts: list[str]) -> list[list[int]]:
    out: list[list[int]] = []
    for w in words_of(pa.array(texts, pa.string()), FOLDED):
        out += [w.hash[w.first[i]:w.first[i + 1]].tolist() for i in range(len(w.row))]
    return out


class Scanner:
    """The templates as word hashes, and where their telling words stand."""

    def __init__(self, templates: dict[str, str], coverage: float) -> None:
        self.coverage = coverage
        self.names = sorted(templates)
        self.words = _hashes([templates[n] for n in self.names])
        common = set(_hashes([COMMON])[0])
        telling: dict[int, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.words):
            own = [w for w in words if w not in common] or words
            # less than the wanted coverage must be possible without these words
            enough = own if len(own) > (1 - coverage) * len(words) else words
            for j, w in enumerate(words):
                if w in set(enough):
                    telling.setdefault(w, []).append((t, j))
        self.telling = telling
        self.known = np.array(sorted(telling), dtype=np.uint64)
        self.table = np.zeros(1 << 16, bool)
        if len(self.known):
            self.table[(self.known >> np.uint64(48)).astype(np.int64)] = True

    def places(self, h: np.ndarray) -> np.ndarray:
        """Positions of telling words in a slice."""
        at = np.flatnonzero(self.table[(h >> np.uint64(48)).astype(np.int64)])
        if not len(at):
            return at
        s = np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)
        return at[self.known[s] == h[at]]

    def scan(self, words: np.ndarray, at: np.ndarray) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, end word) in one text; of overlapping
        finds the one that aligns more words stays."""
        starts: dict[int, set[int]] = {}
        for p in at.tolist():
            for t, j in self.telling[int(words[p])]:
                starts.setdefault(t, set()).add(p - j)
        finds = []
        for t, diagonals in starts.items():
            template = self.words[t]
            size, need = len(template), self.coverage * len(template)
            slack = max(2, size // 4)
            done = None
            for d in sorted(diagonals):
                if done is not None and d - done < max(1, slack // 2):
                    continue
                a, z = max(0, d - slack), min(len(words), d + size + slack)
                window = words[a:z].tolist()
                inside = set(window)
                if sum(w in inside for w in template) < need:
                    continue
                done = d
                got = patience(window, template)
                if len(got) >= need:
                    finds.append((-len(got), -len(got) / size, self.names[t], a + got[0][0], a + got[-1][0] + 1))
        chosen: list[tuple[str, float, int, int]] = []
        for _, share, name, s, e in sorted(finds):
            if all(e <= c[2] or s >= c[3] for c in chosen):
                chosen.append((name, -share, s, e))
        return sorted(chosen, key=lambda c: c[2])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None,
                  coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, coverage, start, end (word positions): one row per license found.

    Words are runs of letters and digits, ASCII case folded. Null and empty
    texts have no rows; repeated rows are reported each; an empty table gives
    no rows; extra columns are ignored.
    """
    scanner = Scanner(templates or TEMPLATES, coverage)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for w in words_of(b.column("text"), FOLDED):
                at = scanner.places(w.hash)
                if not len(at):
                    continue
                row = np.searchsorted(w.first, at, side="right") - 1
                cut = np.flatnonzero(np.append(True, np.diff(row) != 0))
                rows, found = [], []
                for a, z in zip(cut, np.append(cut[1:], len(row)), strict=True):
                    r = int(row[a])
                    f = int(w.first[r])
                    for hit in scanner.scan(w.hash[f:w.first[r + 1]], at[a:z] - f):
                        rows.append(int(w.row[r]))
                        found.append(hit)
                if found:
                    name, share, start, end = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").take(pa.array(rows)), pa.array(name), pa.array(share),
                         pa.array(start, pa.int32()), pa.array(end, pa.int32())],
                        names=["doc_id", "license", "coverage", "start", "end"])

    return docs.select(F.col("doc_id"), F.col("text")).mapInArrow(
        run, f"doc_id {id_type}, license string, coverage double, start int, end int")
