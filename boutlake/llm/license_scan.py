"""License scans: winnowed fingerprints in an inverted index, then banded alignment.

Templates are bounded in number and length (the index is sent to every
executor). Of each template's word k-grams winnowing keeps each window's least
hash; these fingerprints make the inverted index. All k-grams of a text are looked
up, so every whole template and every run of window + k - 1 of its words is found,
however short the template. The fingerprints found vote for (template, diagonal
band); a banded alignment of the template with that part of the text gives a piece,
and pieces of one template that follow on each other are chained, so that foreign
words within an occurrence don't split it. A chain gives matched words, coverage
and spans.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from boutlake.llm.common import id_and_text

# Wording of well-known licenses and notices.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-notice": "Released under the MIT License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to http://unlicense.org/",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "All-rights-reserved": "All rights reserved.",
}
# End of fixed values.

WORD = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*")


def lower(text: str) -> str:
    """The text in lower case with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join([c.lower() if len(c.lower()) == 1 else c for c in text])


def words_of(text: str) -> list[str]:
    return WORD.findall(lower(text))


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the hashes that winnowing keeps: of each window the least, the last of equals."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64)
    w = min(window, n)
    views = np.lib.stride_tricks.sliding_window_view(hashes, w)
    last_least = w - 1 - views[:, ::-1].argmin(axis=1)
    return np.unique(np.arange(len(views)) + last_least)


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k-grams of word numbers."""
    if len(ids) < k:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(ids) - k + 1, np.uint64)
    for j in range(k):
        h = (h ^ ids[j : len(ids) - k + 1 + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


#: Cells of an alignment that one sweep holds (five bytes each).
SWEEP = 1 << 22


@dataclass
class Index:
    """The templates' words, numbered, and the inverted index from fingerprint to (template, place)."""

    names: list[str]
    words: list[np.ndarray]
    numbers: dict[str, int]
    places: dict[int, list[tuple[int, int]]]
    hashes: np.ndarray
    k: int
    window: int


def build_index(templates: dict[str, str], k: int = 3, window: int = 4) -> Index:
    """The index of the templates' winnowed fingerprints; a template of fewer than k words has none."""
    names = sorted(templates)
    split = [words_of(templates[n]) for n in names]
    numbers = {w: i + 1 for i, w in enumerate(sorted({w for s in split for w in s}))}
    words = [np.array([numbers[w] for w in s], np.int64) for s in split]
    places: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for t, ids in enumerate(words):
        hashes = gram_hashes(ids, k)
        for p in winnow(hashes, window).tolist():
            places[int(hashes[p])].append((t, p))
    return Index(names, words, numbers, dict(places), np.array(sorted(places), np.uint64), k, window)


def align_all(a: np.ndarray, b: np.ndarray, centres: np.ndarray, band: int) -> list[list[tuple[int, int]]]:
    """For each centre the matched places (i in template a, j in text b) of a best local-in-b alignment within ``band`` of the diagonal j - i = centre.

    Score: 2 for equal words, -1 for a substitution, an insertion or a deletion.
    All diagonals of a template are aligned in one sweep over its words, so time
    in Python is len(a) a sweep and memory len(a) x centres x (2 band + 1).
    """
    n, m, width = len(a), len(centres), 2 * band + 1
    steps = np.arange(width)
    off = centres[:, None] - band + steps
    score = np.zeros((n + 1, m, width), np.int32)
    move = np.zeros((n + 1, m, width), np.int8)
    never = np.full((m, 1), -(1 << 20), np.int32)
    for i in range(1, n + 1):
        j = off + i - 1
        inside = (j >= 0) & (j < len(b))
        same = inside & (b[np.where(inside, j, 0)] == a[i - 1])
        before = score[i - 1]
        diagonal = np.where(inside, before + np.where(same, 2, -1), never)
        skip_a = np.concatenate([before[:, 1:] - 1, never], axis=1)
        best = np.maximum(np.maximum(diagonal, skip_a), 0)
        along = np.maximum.accumulate(best + steps, axis=1) - steps  # words of the text that the template lacks
        row_move = np.where(diagonal >= skip_a, np.where(same, 1, 2), 3)
        row_move[best == 0] = 0
        row_move[along > best] = 4
        score[i], move[i] = along, row_move
    out = []
    for g in range(m):
        i, c = np.unravel_index(int(score[:, g].argmax()), (n + 1, width))
        pairs = []
        while i > 0 and score[i, g, c] > 0:
            kind = move[i, g, c]
            if kind == 4:
                c -= 1
            elif kind == 3:
                i, c = i - 1, c + 1
            elif kind == 0:
                break
            else:
                if kind == 1:
                    pairs.append((int(i - 1), int(off[g, c] + i - 1)))
                i -= 1
        out.append(pairs[::-1])
    return out


def align(a: np.ndarray, b: np.ndarray, centre: int, band: int) -> list[tuple[int, int]]:
    """``align_all`` for one diagonal."""
    return align_all(a, b, np.array([centre]), band)[0]


def chains(pieces: list[list[tuple[int, int]]], size: int, min_coverage: float, slack: int) -> list[list[tuple[int, int]]]:
    """Occurrences of at least ``min_coverage``, fullest first: pieces of one template joined where template and text both go on.

    Between two joined pieces lie at most ``size`` words of the text. A piece may lose
    up to ``slack`` pairs at a joint besides those that both hold. No word of the text
    is in two occurrences.
    """
    out: list[list[tuple[int, int]]] = []
    used: set[int] = set()
    while True:
        pieces = sorted((p for p in ([x for x in piece if x[1] not in used] for piece in pieces) if p), key=lambda p: (p[0][1], p[-1][1]))
        longest = max((p[-1][1] - p[0][1] for p in pieces), default=0)
        held = [set(p) for p in pieces]
        best: list[tuple[int, int, int, int, int]] = []  # matched, -pieces, start, piece before, pairs cut
        for f, p in enumerate(pieces):
            top = (len(p), -1, p[0][1], -1, 0)
            for g in range(f - 1, -1, -1):
                q = pieces[g]
                if p[-1][1] - q[0][1] > 2 * longest + size:
                    break
                cut = max(bisect_right(p, q[-1][0], key=lambda x: x[0]), bisect_right(p, q[-1][1], key=lambda x: x[1]))
                if cut == len(p) or p[cut][1] - q[-1][1] > size or cut > slack and cut - len(held[g].intersection(p[:cut])) > slack:
                    continue
                top = max(top, (best[g][0] + len(p) - cut, best[g][1] - 1, best[g][2], g, cut))
            best.append(top)
        taken = False
        for f in sorted(range(len(pieces)), key=lambda f: (-best[f][0], -best[f][1], pieces[f][-1][1] - best[f][2], f)):
            if best[f][0] < min_coverage * size:
                break
            parts, at = [], f
            while at >= 0:
                parts.append(pieces[at][best[at][4] :])
                at = best[at][3]
            pairs = [x for part in reversed(parts) for x in part]
            if used.isdisjoint(j for _, j in pairs):
                used.update(j for _, j in pairs)
                out.append(pairs)
                taken = True
        if not taken:
            return out


def scan_text(text: str | None, index: Index, min_coverage: float, band: int) -> list[tuple[str, float, int, list[tuple[int, int]]]]:
    """(license, coverage, matched words, spans as character ranges) of each occurrence, in order of place."""
    if not text:
        return []
    low, get = lower(text), index.numbers.get
    ids = np.array([get(w, 0) for w in WORD.findall(low)], np.int64)
    known = np.flatnonzero(np.convolve(ids > 0, np.ones(index.k, np.int64), "valid") == index.k) if len(ids) >= index.k else ids[:0]
    if not len(known):
        return []
    hashes = gram_hashes(ids, index.k)
    kept = known[np.isin(hashes[known], index.hashes)]
    if not len(kept):
        return []
    matches = list(WORD.finditer(low))
    votes: dict[int, list[int]] = defaultdict(list)
    for p in kept.tolist():
        for t, q in index.places[int(hashes[p])]:
            votes[t].append(p - q)
    found = []
    for t, diagonals in votes.items():
        size = len(index.words[t])
        reach = min(band, size - 1)  # occurrences that follow on each other lie a template's length apart
        diagonals.sort()
        at, centres = 0, []
        while at < len(diagonals):
            stop = at
            while stop < len(diagonals) and diagonals[stop] - diagonals[at] <= reach:
                stop += 1
            centres.append(diagonals[(at + stop - 1) // 2])
            at = stop
        some = max(1, SWEEP // (size * (2 * reach + 1)))
        pieces = [p for lo in range(0, len(centres), some) for p in align_all(index.words[t], ids, np.array(centres[lo : lo + some]), reach)]
        for pairs in chains(pieces, size, min_coverage, index.window + index.k - 1):
            spans, start = [], 0
            places = [j for _, j in pairs]
            for x in range(1, len(places) + 1):
                if x == len(places) or places[x] != places[x - 1] + 1:
                    spans.append((matches[places[start]].start(), matches[places[x - 1]].end()))
                    start = x
            found.append((index.names[t], len(pairs) / size, len(pairs), spans))
    found.sort(key=lambda f: (f[3][0][0], -f[2], f[0]))
    return found


def scan(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = 0.6, band: int = 16, k: int = 3, window: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, coverage, matched_words, spans) of every occurrence of a template in a whole text.

    An occurrence that holds a whole template or a run of window + k - 1 of its
    words is always a candidate; a template of fewer than k words never is. The
    band is narrower than the template where that is short, so that occurrences
    side by side stay apart. Pieces of a template up to its own length of words apart count as one occurrence. spans are character ranges [start, end) of matched
    runs. Null and empty texts have no row; repeated rows and null ids are scanned like
    others; other columns are not read. Nothing is shuffled. ``templates`` (name to
    text) takes the place of TEMPLATES, of which Apache, GPL and MPL are the notices
    that files carry, not the whole licenses.
    """
    index = build_index(TEMPLATES if templates is None else templates, k, window)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        ix = shared.value
        for b in batches:
            at, rows = [], []
            for i, text in enumerate(b.column(1)):
                for r in scan_text(text.as_py(), ix, min_coverage, band):
                    at.append(i)
                    rows.append(r)
            spans = pa.array([[{"start": s, "end": e} for s, e in r[3]] for r in rows], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.int32()), spans],
                names=["id", "license", "coverage", "matched_words", "spans"],
            )

    plain, id_type = id_and_text(docs, id_col, text_col)
    return plain.mapInArrow(run, f"id {id_type}, license string, coverage double, matched_words int, spans array<struct<start:int,end:int>>").withColumnRenamed("id", id_col)
