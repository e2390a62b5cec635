"""License scan: winnowed fingerprints pick candidates, banded alignment measures them.

Templates and documents are read as lower-case runs of letters and digits. Every template's
k-word fingerprints are winnowed into an inverted index (a few hundred entries, shipped with the
tasks). A document's fingerprints that occur in the index give hits; hits of one template on
nearby diagonals give a candidate region; a banded alignment of template and region counts the
template words that are found in order; then the text between matches is aligned again, until no
hit is left in it that gives one. Matches are reported with coverage and spans. Of short notices
and full texts that begin alike, the one with most words found is reported.

Defined results: null, empty and wordless texts give no rows; each occurrence gives a row, so a
document can have several; repeated rows give repeated results. Spans are code points, end
exclusive. Input columns other than the id and text are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textvec as tv
from .common import tidy

# License notices, by name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "MIT-notice": "Released under the MIT License",
    "MIT-licensed": "Licensed under the MIT License",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-notice": "Released under the BSD License",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0",
    "CC-BY-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "all-rights-reserved": "All rights reserved",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-2-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause-conditions": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "GPL-3.0-header-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "MPL-2.0-text": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSL-1.0-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
}
#: Words in a fingerprint, fingerprints in a winnowing window, band of the alignment (words),
#: and the least part of a template that must be found.
GRAM, WINDOW, BAND, COVERAGE = 3, 2, 8, 0.8


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, edges = tv.tokens(data, off, tv.ALNUM)
    return starts, ends, edges, tv.hash_spans(tv.prefix_sums(data), starts, ends)


class Index:
    """Templates as word hashes, and the inverted index of their winnowed fingerprints."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, gram: int = GRAM, window: int = WINDOW):
        self.names, self.words, self.gram = list(templates), [], gram
        entries = []
        for t, text in enumerate(templates.values()):
            data = np.frombuffer(text.encode(), np.uint8)
            *_, h = _words(data, np.array([0, len(data)]))
            self.words.append(h)
            prints, _ = tv.ngrams(h, np.array([0, len(h)]), gram)
            last = -1
            for i in range(max(1, len(prints) - window + 1)):
                part = prints[i : i + window]
                j = i + len(part) - 1 - int(np.argmin(part[::-1]))  # rightmost least print
                if j != last:
                    entries.append((int(prints[j]), t, j))
                    last = j
        entries.sort()
        self.prints = np.array([e[0] for e in entries], np.uint64)
        self.where = [(t, j) for _, t, j in entries]
        self.mask = np.zeros(1 << 16, bool)
        self.mask[(self.prints & np.uint64(0xFFFF)).astype(np.int64)] = True

    def hits(self, prints: np.ndarray) -> np.ndarray:
        """Positions of the prints that occur in the index."""
        maybe = np.flatnonzero(self.mask[(prints & np.uint64(0xFFFF)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.prints, prints[maybe]), len(self.prints) - 1)
        return maybe[self.prints[k] == prints[maybe]]

    def entries(self, fingerprint: np.uint64) -> list[tuple[int, int]]:
        a, b = np.searchsorted(self.prints, [fingerprint, fingerprint + np.uint64(1)])
        return self.where[a:b]


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """Most template words found in order within `band` of the diagonal `shift`; returns the
    number, and the first and end word of the shortest such stretch that ends earliest."""
    width = 2 * band + 1
    # best[d] for the diagonal d: (matched, -start) of alignments that end on this row
    best: list[tuple[int, int]] = [(0, -(1 << 60))] * width
    top, end = (0, -(1 << 60)), 0
    for i, w in enumerate(template):
        row: list[tuple[int, int]] = []
        for d in range(width):
            j = i + shift + d - band
            here = max(best[d + 1] if d + 1 < width else (0, -(1 << 60)), row[d - 1] if d else (0, -(1 << 60)))  # a template or a text word is skipped
            if 0 <= j < len(text) and text[j] == w:
                n, s = best[d]
                here = max(here, (n + 1, s if n else -j))
                if here > top:
                    top, end = here, j + 1
            elif best[d] > here:
                here = best[d]
            row.append(here)
        best = row
    return top[0], -top[1], end


def find(index: Index, words: np.ndarray, prints: np.ndarray, hit: np.ndarray, band: int, coverage: float) -> list[tuple[int, int, float, int, int]]:
    """(template, matched, coverage, first word, end word) of one document's matches."""
    places: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for p in hit:
        for t, j in index.entries(prints[p]):
            places[t].append((int(p), j))
    found = []
    for t, hits in places.items():
        # stretches of text without a match so far, and the hits in each
        open_ = [(0, len(words), sorted(set(hits)))]
        while open_:
            a, b, mine = open_.pop()
            new, last = [], None
            for s in sorted({p - j for p, j in mine}):
                if last is not None and s - last <= band // 2:
                    continue  # the band around the last one covers it, or the next round does
                last = s
                # a band reaches no further than this, so a stretch is not copied for each
                low, high = max(a, s - band), min(b, s + len(index.words[t]) + band)
                n, first, end = align(index.words[t], words[low:high], s - low, band)
                if n / len(index.words[t]) >= coverage:
                    new.append((t, n, n / len(index.words[t]), low + first, low + end))
            taken = apart(new)
            found += taken
            for x, y in zip([a, *(m[4] for m in taken)], [*(m[3] for m in taken), b], strict=True) if taken else ():
                rest = mine[bisect_left(mine, (x, -1)) : bisect_left(mine, (y - index.gram + 1, -1))]
                if rest:
                    open_.append((x, y, rest))
    return apart(found)


def apart(found: list[tuple[int, int, float, int, int]]) -> list[tuple[int, int, float, int, int]]:
    """Matches that do not overlap, in order."""
    # of overlapping matches the one with most words stays; ties to the shorter span, then the first template
    kept: list[tuple[int, int, float, int, int]] = []
    for m in sorted(set(found), key=lambda m: (-m[1], m[4] - m[3], m[0], m[3])):
        at = bisect_left(kept, m[3], key=lambda k: k[3])  # kept are in order and apart
        if (at == 0 or kept[at - 1][4] <= m[3]) and (at == len(kept) or m[4] <= kept[at][3]):
            kept.insert(at, m)
    return kept


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, gram: int = GRAM, window: int = WINDOW, band: int = BAND, coverage: float = COVERAGE) -> DataFrame:
    """One row per match: id, license, matched_words, coverage, span_start, span_end."""
    index = Index(templates, gram, window)
    used = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cols = [], [[], [], [], [], []]
            for i, _, data, off in tv.chunks(batch.column(1)):
                starts, ends, edges, h = _words(data, off)
                prints, at = tv.ngrams(h, edges, gram)
                hit = index.hits(prints)
                if not len(hit):
                    continue
                owner = np.searchsorted(at, hit, "right") - 1
                for d in np.unique(owner):
                    mine = hit[owner == d] - at[d]
                    a, b = edges[d], edges[d + 1]
                    found = find(index, h[a:b], prints[at[d] : at[d + 1]], mine, band, coverage)
                    if found:
                        text = data[off[d] : off[d + 1]]
                        points = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
                        for t, n, share, first, end in found:
                            rows.append(i + int(d))
                            span = (int(points[starts[a + first] - off[d]]), int(points[ends[a + end - 1] - off[d]]))
                            for c, v in zip(cols, (index.names[t], n, share, *span), strict=True):
                                c.append(v)
            kinds = [pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=[id_col, "license", "matched_words", "coverage", "span_start", "span_end"],
            )

    return used.mapInArrow(tidy(run), f"`{id_col}` {dict(used.dtypes)[id_col]}, license string, matched_words int, coverage double, span_start bigint, span_end bigint")
