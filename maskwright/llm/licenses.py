"""Licence scans by patience alignment of texts with licence templates.

A template's distinct word pairs form a broadcast set (templates are a bounded
parameter, `MAX_TEMPLATE_WORDS` in total). Where a text holds enough of a
template's pairs close together, each start that a pair speaks for is tried, the
one with most pairs first: a template-long window there, then a longer one, is
aligned inside what no earlier finding of the template has taken, and what is
left between findings is aligned as a whole. In an alignment, words unique to both sides are anchors, the longest increasing subsequence of
anchors is kept, and the gaps between anchors are aligned the same way. Coverage
is the share of template words aligned; a region at or above `COVERAGE` is a
finding, with its words.

Texts are tokenised in numpy over Arrow buffers; only texts that hold pairs of a
template are looked at in Python. Nothing is shuffled.

Words: A-Z lower-cased, then runs of ASCII letters, digits and non-ASCII.
Defined results: null and wordless texts have no findings; of overlapping
findings the one with more aligned words stays, then the earlier, then by name;
repeated rows are separate; empty tables give no rows; other columns are not
read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

COVERAGE = 0.8
MAX_TEMPLATE_WORDS = 200_000
_BITS = 20

_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GNU = lambda name, version: f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
_WITHOUT = lambda name: f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."

# Public licences and their notices, as their authors word them, by paragraphs: each is found and covered by itself.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", _GRANT),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GNU("General Public License", 3)),
    ("GPL-3.0", _WITHOUT("General Public License")),
    ("GPL-2.0", _GNU("General Public License", 2)),
    ("LGPL-3.0", _GNU("Lesser General Public License", 3)),
    ("LGPL-3.0", _WITHOUT("Lesser General Public License")),
    ("LGPL-2.1", _GNU("Lesser General Public License", 2.1)),
    ("AGPL-3.0", _GNU("Affero General Public License", 3)),
    ("AGPL-3.0", _WITHOUT("Affero General Public License")),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD", _BSD),
    ("BSD", _BSD_1),
    ("BSD", _BSD_2),
    ("BSD-3-Clause", _BSD_3),
    ("BSD", _BSD_END),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("ISC", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
)


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs (i, j) with a[i] == b[j], ascending on both sides."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        once_a, once_b = _once(a, i, i_end), _once(b, j, j_end)
        anchors = _rising([(p, once_b[w]) for w, p in once_a.items() if w in once_b])
        if not anchors:
            # No unique word in common: the first word that both have goes on.
            first = {}
            for q in range(j, j_end):
                first.setdefault(b[q], q)
            hit = next(((p, first[a[p]]) for p in range(i, i_end) if a[p] in first), None)
            if hit:
                out.append(hit)
                todo.append((hit[0] + 1, i_end, hit[1] + 1, j_end))
            continue
        for p, q in anchors:
            out.append((p, q))
            todo.append((i, p, j, q))
            i, j = p + 1, q + 1
        todo.append((i, i_end, j, j_end))
    return sorted(out)


def _once(words: list, start: int, end: int) -> dict:
    at: dict = {}
    for i in range(start, end):
        at[words[i]] = -1 if words[i] in at else i
    return {w: i for w, i in at.items() if i >= 0}


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs that rises on both sides."""
    pairs.sort()
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for n, (_, q) in enumerate(pairs):
        k = bisect_left(tails, q)
        before[n] = ends[k - 1] if k else -1
        tails[k : k + 1] = [q]
        ends[k : k + 1] = [n]
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


class Templates:
    def __init__(self, templates):
        self.names, self.words, self.hashes = [], [], []
        #: For each template, the words at which each of its pairs begins.
        self.places: list[dict[int, list[int]]] = []
        pairs: dict[int, list[int]] = {}
        for name, text in templates:
            for b in K.blocks(pa.array([text], pa.string())):
                t = K.tokens(b, K.ALNUM)
                if not len(t.start):
                    continue
                at = len(self.names)
                self.names.append(name)
                self.hashes.append(t.hash.tolist())
                begins: dict[int, list[int]] = {}
                for q, x in enumerate(self._pairs(t.hash, t.row)[0].tolist()):
                    begins.setdefault(x, []).append(q)
                self.places.append(begins)
                for x in begins:
                    pairs.setdefault(x, []).append(at)
        if sum(map(len, self.hashes)) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates have more than {MAX_TEMPLATE_WORDS} words")
        self.pairs = pairs
        self.need = [max(1, len({*zip(h, h[1:])}) // 3) for h in self.hashes]
        self.map = np.zeros(1 << _BITS, bool)
        if pairs:
            self.map[np.fromiter(pairs, np.uint64, len(pairs)) >> np.uint64(64 - _BITS)] = True

    @staticmethod
    def _pairs(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return K.windows(h, row, 2) if len(h) > 1 else K.windows(h, row, 1)

    def _cluster(self, t: int, words: list[int], low: int, high: int, hits: list[tuple[int, int]], coverage: float) -> list[tuple[int, int, int]]:
        """(aligned words, first word, end word) of a template's disjoint findings in words[low:high]."""
        template, size = self.hashes[t], len(self.hashes[t])
        places = [pos for pos, _ in hits]
        taken: list[tuple[int, int, int]] = []
        votes: dict[int, int] = {}
        for pos, pair in hits:
            for q in self.places[t][pair]:
                votes[pos - q] = votes.get(pos - q, 0) + 1

        def best(windows) -> tuple[int, int, int] | None:
            got = []
            for i, k in windows:
                if bisect_left(places, k) - bisect_left(places, i) >= self.need[t] and (pairs := patience(words[i:k], template)) and len(pairs) >= coverage * size:
                    got.append((len(pairs), i + pairs[0][0], i + pairs[-1][0] + 1))
            # A word more has to be worth the words that it stretches the finding by.
            return max(got, key=lambda x: (4 * x[0] - (x[2] - x[1]), -x[1]), default=None)

        slack = size // 4 + 2
        for s in sorted(votes, key=lambda s: (-votes[s], s)):
            n = bisect_left(taken, s + 1, key=lambda x: x[1])
            left, right = taken[n - 1][2] if n else low, taken[n][1] if n < len(taken) else high
            if s + size > left and (one := best((max(left, a), min(right, e)) for a, e in ((s, s + size), (s, s + size + slack), (s - slack, s + size + slack)))):
                insort(taken, one, key=lambda x: x[1])
        todo = list(zip([low, *(x[2] for x in taken)], [*(x[1] for x in taken), high]))
        while todo:
            i, k = todo.pop()
            if one := best([(i, k)]):
                taken.append(one)
                todo += [(i, one[1]), (one[2], k)]
        return taken

    def find(self, words: list[int], hits: list[tuple[int, int]], coverage: float) -> list[tuple[str, float, int, int]]:
        """(name, coverage, first word, end word) in one text, from its (position, pair) hits."""
        by: dict[int, list[tuple[int, int]]] = {}
        for pos, pair in hits:
            for t in self.pairs.get(pair, ()):
                by.setdefault(t, []).append((pos, pair))
        found = []
        for t, at in by.items():
            size, start = len(self.hashes[t]), 0
            for i in range(1, len(at) + 1):
                # Hits further apart than the template is long are of different places.
                if i < len(at) and at[i][0] - at[i - 1][0] <= size:
                    continue
                if i - start >= self.need[t]:
                    low, high = max(0, at[start][0] - size), min(len(words), at[i - 1][0] + size + 1)
                    found += [(-n, s, self.names[t], n / size, e) for n, s, e in self._cluster(t, words, low, high, at[start:i], coverage)]
                start = i
        kept: list[tuple[str, float, int, int]] = []
        for _, s, name, share, e in sorted(found):
            if all(e <= a or b <= s for _, _, a, b in kept):
                kept.append((name, share, s, e))
        return sorted(kept, key=lambda x: (x[2], x[0]))


_FINDING = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])


def _scan(templates: Templates, coverage: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = np.zeros(batch.num_rows, np.int64)
        found: list[list[dict]] = [[]] * batch.num_rows
        for b in K.blocks(batch.column(1)):
            t = K.tokens(b, K.ALNUM)
            words[b.first : b.first + b.rows] = K.per_row(t.row, b.rows)
            h, at = Templates._pairs(t.hash, t.row)
            hit = np.flatnonzero(templates.map[h >> np.uint64(64 - _BITS)])
            rows = t.row[at[hit]]
            cuts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else []
            for i, j in zip(cuts, [*cuts[1:], len(rows)]):
                r = int(rows[i])
                first, end = np.searchsorted(t.row, [r, r + 1])
                hits = [(int(at[k] - first), int(h[k])) for k in hit[i:j].tolist()]
                got = templates.find(t.hash[first:end].tolist(), hits, coverage)
                found[b.first + r] = [dict(zip(("license", "coverage", "start", "end"), x)) for x in got]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(found, pa.list_(_FINDING))], names=["doc_id", "n_words", "findings"])


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, n_words, findings): findings are (license, coverage, start, end) in words."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(Templates(templates))
    ddl = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, findings array<struct<license:string, coverage:double, start:long, end:long>>"
    return rows.mapInArrow(lambda it: _scan(held.value, coverage, it), ddl)


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    out = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("findings", lambda x: x["license"]))), ",")
    spans = F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    best = F.coalesce(F.array_max(F.transform("findings", lambda x: x["coverage"])), F.lit(0.0))
    return out.select("doc_id", "n_words", F.size("findings").cast("long").alias("n_findings"), names.alias("licenses"), best.alias("coverage"), spans.alias("spans"))
