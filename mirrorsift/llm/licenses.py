"""License scans by patience alignment.

A text and a template are aligned on the words that are unique in both: the longest increasing
subsequence of their positions is kept, and the gaps between kept words are aligned the same way,
recursively; where a gap has no unique common words, its equal ends are matched.  Coverage is the share of
the template's words that were matched.

Long texts are not aligned whole.  A template covered to at least MIN_COVERAGE must show one of its
(1 - MIN_COVERAGE) * n + 1 longest words, so texts without any are passed over; in the others, regions
dense in template words are found by a sliding count, and each is aligned, in windows where it holds more
than one copy.

Defined results: null texts are empty and match nothing; every place of a license is reported, one row
each, overlapping places of one template once (the best); rows with equal doc_id are scanned row by row;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorsift.runtime import configure, spread

MIN_COVERAGE = 0.8
# Notices and whole texts of well-known licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "BSD-2-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
COLUMNS = ["doc_id", "license_id", "coverage", "start", "end", "n_anchors"]
SCHEMA = "doc_id long, license_id string, coverage double, start long, end long, n_anchors long"


def tokens(text: str) -> list[str]:
    return [m.group().lower() for m in WORD.finditer(text)]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of pairs (sorted by the first) that increases in the second: patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        if pile == len(tops):
            tops.append(b)
            at.append(i)
        else:
            tops[pile], at[pile] = b, i
        before.append(at[pile - 1] if pile else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> tuple[list[tuple[int, int]], int]:
    """Matched (text, template) positions in order, and how many were unique anchors."""
    matched: list[tuple[int, int]] = []
    anchors = 0
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d:
            continue
        once, also = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(text[a:b], a) if once[w] == 1}
        kept = increasing(sorted((place[w], j) for j, w in enumerate(template[c:d], c) if also[w] == 1 and w in place))
        if kept:
            anchors += len(kept)
            matched += kept
            edges = [(a - 1, c - 1), *kept, (b, d)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
            continue
        while a < b and c < d and text[a] == template[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            matched.append((b - 1, d - 1))
            b, d = b - 1, d - 1
    return sorted(matched), anchors


class Template:
    def __init__(self, name: str, text: str, min_coverage: float = MIN_COVERAGE):
        self.name, self.words = name, tokens(text)
        self.counts = Counter(self.words)
        self.need = max(1, -int(-min_coverage * len(self.words) // 1))
        self.wide = max(len(self.words) + 4, len(self.words) * 3 // 2)
        spare = len(self.words) - self.need
        self.lead = frozenset(self.words[: spare + 1])  # a place begins with one of these
        longest = sorted(set(self.words), key=lambda w: (-len(w), w))
        stems, n = [], 0
        for w in longest:  # so many occurrences that not all can be missing
            stems.append(w)
            n += self.counts[w]
            if n > spare:
                break
        self.stems = stems

    def regions(self, words: list[str]) -> list[tuple[int, int]]:
        """Runs of the text, not overlapping, that hold enough template words close together."""
        hits = [i for i, w in enumerate(words) if w in self.counts]
        out: list[list[int]] = []
        seen: Counter = Counter()
        n = first = 0
        for last, i in enumerate(hits):
            w = words[i]
            seen[w] += 1
            n += seen[w] <= self.counts[w]
            while i - hits[first] >= self.wide:
                v = words[hits[first]]
                n -= seen[v] <= self.counts[v]
                seen[v] -= 1
                first += 1
            if n >= self.need:
                if out and hits[first] <= out[-1][1]:
                    out[-1][1] = i
                else:
                    out.append([hits[first], i])
        return [(a, b + 1) for a, b in out]

    def aligned(self, words: list[str], a: int, b: int) -> tuple[int, int, int, int] | None:
        """(first, last, matched words, anchors) of the stretch's alignment, if it covers enough."""
        matched, anchors = align(words[a:b], self.words)
        return (a + matched[0][0], a + matched[-1][0], len(matched), anchors) if len(matched) >= self.need else None

    def places(self, words: list[str], a: int, b: int) -> list[tuple[int, int, int, int]]:
        """Places of a region, not overlapping.

        No word is unique among copies close together, so a stretch whose own alignment is not one whole copy
        is aligned in windows from each word that can be a place's first.  The best windows are kept, and the
        parts before, between and after them are searched the same way.
        """
        out, todo = [], [(a, b)]
        while todo:
            a, b = todo.pop()
            if sum((Counter(w for w in words[a:b] if w in self.counts) & self.counts).values()) < self.need:
                continue
            whole = self.aligned(words, a, b) if b - a <= 2 * self.wide else None
            if whole and whole[2] == len(self.words) and whole[1] - whole[0] < self.wide:
                found = [whole]
            else:
                found, i = [], a
                while i < b:
                    near = [p for size in (len(self.words), self.wide) if words[i] in self.lead and (p := self.aligned(words, i, min(b, i + size)))]
                    found += near
                    # nothing that starts inside a word-for-word copy is better than it
                    i += len(self.words) if any(p[2] == len(self.words) == p[1] - p[0] + 1 for p in near) else 1
                if not found:  # its words lie further apart than a window
                    found = [p for p in [whole or self.aligned(words, a, b)] if p]
                found = sorted(set(found), key=lambda p: (-p[2], p[1] - p[0], p))
            kept: list[tuple[int, int, int, int]] = []
            for p in found:
                at = bisect_left(kept, p)
                if (at == 0 or kept[at - 1][1] < p[0]) and (at == len(kept) or p[1] < kept[at][0]):
                    kept.insert(at, p)
            if kept:
                out += kept
                edges = [a, *(x for p in kept for x in (p[0], p[1] + 1)), b]
                todo += zip(edges[::2], edges[1::2], strict=True)
        return out


def scan_text(text: str, templates: list[Template]) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, start, end, anchors) of each place, in code points."""
    low = text.lower()
    wanted = [t for t in templates if any(s in low for s in t.stems)]
    if not wanted:
        return []
    spots = [(m.start(), m.end(), m.group().lower()) for m in WORD.finditer(text)]
    words = [w for _, _, w in spots]
    out = []
    for t in wanted:
        for i, j, n, anchors in sorted(p for a, b in t.regions(words) for p in t.places(words, a, b)):
            out.append((t.name, round(n / len(t.words), 6), spots[i][0], spots[j][1], anchors))
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license_id, coverage, start, end, n_anchors: one row for each place of a license."""
    configure(docs.sparkSession)
    texts = dict(TEMPLATES if templates is None else templates)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = spread(rows).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Template(k, v, min_coverage) for k, v in texts.items() if tokens(v)]
        types = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        for b in batches:
            found = [(d, *x) for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for x in scan_text(t.as_py(), made)]
            cols = list(zip(*found, strict=True)) or [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names=COLUMNS)

    return rows.mapInArrow(run, SCHEMA)
