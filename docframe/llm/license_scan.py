"""License scans by patience alignment of texts with license templates.

Words unique to both the text and the template anchor the alignment: the
longest increasing subsequence of their places is kept, and the gaps between
anchors are aligned in the same way, equal words at the edges of a gap first.
Of the aligned words the run is taken that gains most: each aligned word counts
3, each word of the text's span and of the template takes one away, so that both
missing and inserted words cost.  ``coverage`` is the share of the template's
words that are aligned, ``precision`` the share of the span's words; both must
reach ``least``.

A notice has a phrase that tells its license apart, in braces in its template:
the phrase must stand in the text word by word.  So "GNU Lesser General Public
License" is no hit of the GPL, nor "Attribution-NonCommercial 4.0" one of
"Attribution 4.0".  Phrases are searched first; the words before and after are
aligned with what stands around.

A license text without a phrase is aligned where it may stand at all: in texts
that hold enough of its distinct words, a window of ``SPREAD`` times its length is
a candidate if the template's words found in it, each counted as often as the
template has it, reach the least coverage.  Alignment can't align more, so nothing
is lost by that, and a license in the middle of a long text is found as well as one
alone.  Windows overlap by more than a template's length.

Of touching hits of any licenses the one that gains most is reported; ties go to
the earlier template, then place.

Everything happens within a row, on whole texts.  Null and empty texts have no
hits.  Words are runs of letters and digits, lower-cased (A-Z); templates
without words are never found.  Rows are scanned one by one, repeated ones too;
only doc_id and text are read, so that other columns may have any name; an empty
table gives an empty one.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import by_slices, list_column

LEAST, SPREAD = 0.8, 3

_GNU = (("GPL-2.0", "GNU General Public License", "2", "2"), ("GPL-3.0", "GNU General Public License", "3", "3"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1", "2.1"), ("LGPL-3.0", "GNU Lesser General Public License", "3", "3"), ("AGPL-3.0", "GNU Affero General Public License", "3", "3"))
_CC = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
_NAMED = (("MIT", "MIT"), ("ISC", "ISC"), ("BSD", "BSD"), ("BSD-2-Clause", "BSD 2-Clause"), ("BSD-3-Clause", "BSD 3-Clause"), ("Zlib", "zlib"), ("Unlicense", "Unlicense"))

_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_ENDORSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_DISCLAIM = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

# Notices by which texts state their license, with the phrase that tells it apart in braces, and whole license texts.
TEMPLATES = (
    *((name, f"Released under the {{{word} License}}.") for name, word in _NAMED),
    *((name, f"Licensed under the {{{word} License}}.") for name, word in _NAMED),
    ("Apache-2.0", "Licensed under the {Apache License, Version 2.0}."),
    ("Apache-2.0", 'Licensed under the {Apache License, Version 2.0} (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MPL-2.0", "Licensed under the {Mozilla Public License, Version 2.0}."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the {Mozilla Public License, v. 2.0}. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *((name, f"This work is licensed under the {{{title}, version {v}}}.") for name, title, v, _ in _GNU),
    *((name, f"This program is free software: you can redistribute it and/or modify it under the terms of the {{{title} as published by the Free Software Foundation, either version {v}}} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {title} for more details.") for name, title, v, _ in _GNU),
    *((f"CC-{code}-{v}", f"Licensed under {{CC {code} {v}}}.") for code, _ in _CC for v in ("3.0", "4.0")),
    *((f"CC-{code}-4.0", f"This work is licensed under a Creative Commons {{{title} 4.0}} International License.") for code, title in _CC),
    *((f"CC-{code}-3.0", f"This work is licensed under a Creative Commons {{{title} 3.0}} Unported License.") for code, title in _CC),
    ("CC0-1.0", "To the extent possible under law, the author has {waived all copyright and related or neighboring rights} to this work."),
    *((name, f"{{SPDX-License-Identifier: {name}}}") for name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "Unlicense", "Apache-2.0", "MPL-2.0", "CC0-1.0", "BSL-1.0", *(g[0] for g in _GNU), *(f"CC-{c}-4.0" for c, _ in _CC))),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", _GRANT + _DISCLAIM),
    ("BSD-3-Clause", _GRANT + _ENDORSE + _DISCLAIM),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
)


def patience(text: list, template: list) -> list[tuple[int, int]]:
    """Aligned places (text, template), increasing in both."""
    out: list[tuple[int, int]] = []
    work = [(0, len(text), 0, len(template))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        seen: dict = {}
        for side, (low, high, words) in enumerate(((a, b, text), (c, d, template))):
            for i in range(low, high):
                entry = seen.setdefault(words[i], [0, 0, 0, 0])
                entry[side] += 1
                entry[2 + side] = i
        pairs = sorted((e[2], e[3]) for e in seen.values() if e[0] == 1 and e[1] == 1)
        tails: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for i, (_, y) in enumerate(pairs):
            at = bisect_left(tails, y)
            back.append(ends[at - 1] if at else -1)
            if at == len(tails):
                tails.append(y)
                ends.append(i)
            else:
                tails[at], ends[at] = y, i
        anchors = []
        i = ends[-1] if ends else -1
        while i >= 0:
            anchors.append(pairs[i])
            i = back[i]
        if not anchors:
            continue
        anchors.reverse()
        out += anchors
        for (x0, y0), (x1, y1) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
            work.append((x0 + 1, x1, y0 + 1, y1))
    return sorted(out)


def most_gained(aligned: list[tuple[int, int]], length: int) -> tuple[list[tuple[int, int]], int]:
    """The run of aligned places that gains most, and its gain: 3 a place, less the words of its span and of the template."""
    best, low, first = (0, 0, -1), 0, 0
    for j, (x, _) in enumerate(aligned):
        if 3 * first - aligned[first][0] > 3 * j - x:
            first = j
        gain = 3 * (j - first + 1) - (x - aligned[first][0] + 1)
        if gain > best[0]:
            best = (gain, first, j)
    low, high = best[1], best[2] + 1
    return aligned[low:high], best[0] - length


class Templates:
    """Templates as numbers of a common vocabulary; ``phrases`` are the word ranges in braces, or None."""

    def __init__(self, templates=TEMPLATES):
        parts = [part.encode() for _, t in templates for part in (t.split("{")[0], *(t.partition("{")[2].partition("}")[::2]))]
        data = np.frombuffer(b"".join(parts), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(r) for r in parts])]).astype(np.int64)
        starts, ends, ranges = K.words(data, off, K.ALNUM)
        hashes = K.word_hashes(data, starts, ends, lower=True)
        self.names = [n for n, _ in templates]
        self.vocabulary = np.unique(hashes)
        numbers = self.number(hashes)
        self.words = [numbers[ranges[3 * i] : ranges[3 * i + 3]] for i in range(len(templates))]
        self.phrases = [(int(ranges[3 * i + 1] - ranges[3 * i]), int(ranges[3 * i + 2] - ranges[3 * i])) if ranges[3 * i + 2] > ranges[3 * i + 1] else None for i in range(len(templates))]

    def number(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), max(len(self.vocabulary) - 1, 0))
        return np.where(self.vocabulary[at] == hashes, at, -1) if len(self.vocabulary) else np.full(len(hashes), -1)


Hit = tuple[int, int, int, float, float, int]  # first and end word, template, coverage, precision, gain


def _hit(aligned: list[tuple[int, int]], t: int, length: int, least: float) -> Hit | None:
    run, gain = most_gained(aligned, length)
    if not run:
        return None
    span = run[-1][0] - run[0][0] + 1
    if len(run) < least * length or len(run) < least * span:
        return None
    return run[0][0], run[-1][0] + 1, t, round(len(run) / length, 6), round(len(run) / span, 6), gain


def notice_hits(numbers: np.ndarray, low: int, high: int, at: int, templates: Templates, t: int, least: float) -> Hit | None:
    """The hit of a notice whose phrase stands at word ``at`` of the text of the words from ``low`` to ``high``."""
    words, (a, b) = templates.words[t].tolist(), templates.phrases[t]
    reach = SPREAD * len(words)
    left, right = max(low, at - reach), min(high, at + b - a + reach)
    # From the phrase outwards: both sides reversed on the left, so that equal words next to the phrase come first.
    before = [(at - 1 - x, a - 1 - y) for x, y in patience(numbers[left:at][::-1].tolist(), words[:a][::-1])]
    after = [(at + b - a + x, b + y) for x, y in patience(numbers[at + b - a : right].tolist(), words[b:])]
    aligned = sorted([*before, *((at + i, a + i) for i in range(b - a)), *after])
    found = _hit(aligned, t, len(words), least)
    return found if found and found[0] <= at and found[1] >= at + b - a else None


def text_hits(numbers: np.ndarray, low: int, templates: Templates, t: int, least: float) -> list[Hit]:
    """Hits of a license text in one text, whose first word is number ``low`` of all."""
    words = templates.words[t]
    m = len(words)
    allowed = np.bincount(words, minlength=len(templates.vocabulary))
    mine = np.flatnonzero((numbers >= 0) & (allowed[numbers] > 0))
    width = SPREAD * m
    step = max(1, width - 2 * m)
    found = []
    for w in np.unique(np.concatenate([mine // step, np.maximum(mine - width + step, 0) // step])).tolist():
        first, end = w * step, w * step + width
        part = numbers[mine[np.searchsorted(mine, first) : np.searchsorted(mine, end)]]
        if np.minimum(np.bincount(part, minlength=len(allowed)), allowed).sum() < least * m:
            continue
        hit = _hit([(low + first + x, y) for x, y in patience(numbers[first:end].tolist(), words.tolist())], t, m, least)
        if hit:
            found.append(hit)
    return found


def find_hits(numbers: np.ndarray, ranges: np.ndarray, templates: Templates, least: float) -> list[Hit]:
    """Hits in texts of numbered words, -1 for words of no template, in order; touching ones are resolved."""
    found: list[Hit] = []
    doc = K.owners(ranges)
    inside = np.flatnonzero(numbers >= 0)
    pairs = np.unique(doc[inside] * (len(templates.vocabulary) + 1) + numbers[inside])
    holder, word = pairs // (len(templates.vocabulary) + 1), pairs % (len(templates.vocabulary) + 1)
    for t, words in enumerate(templates.words):
        if not len(words):
            continue
        if templates.phrases[t]:
            a, b = templates.phrases[t]
            at = inside[numbers[inside] == words[a]]
            at = at[at + b - a <= len(numbers)]
            for i in range(1, b - a):
                at = at[numbers[at + i] == words[a + i]]
            at = at[doc[at] == doc[at + b - a - 1]]
            for x in at.tolist():
                d = int(doc[x])
                hit = notice_hits(numbers, int(ranges[d]), int(ranges[d + 1]), x, templates, t, least)
                if hit:
                    found.append(hit)
        else:
            own = np.zeros(len(templates.vocabulary) + 1, bool)
            own[words] = True
            missing = len(words) - np.ceil(least * len(words))
            held = np.bincount(holder[own[word]], minlength=len(ranges) - 1)
            for d in np.flatnonzero(held >= max(1, own.sum() - missing)).tolist():
                found += text_hits(numbers[ranges[d] : ranges[d + 1]], int(ranges[d]), templates, t, least)
    best: list[Hit] = []
    starts: list[int] = []
    for hit in sorted(set(found), key=lambda h: (-h[5], h[2], h[0])):
        i = bisect_left(starts, hit[0])
        if (i == 0 or best[i - 1][1] <= hit[0]) and (i == len(best) or best[i][0] >= hit[1]):
            best.insert(i, hit)
            starts.insert(i, hit[0])
    return best


def scan(docs: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """(doc_id, hits) of each row; a hit has the license, its coverage and precision, and its words and bytes in the text."""
    model = Templates(templates)

    def work(rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
        starts, ends, ranges = K.words(data, off, K.ALNUM)
        found = find_hits(model.number(K.word_hashes(data, starts, ends, lower=True)), ranges, model, least)
        first, last = (np.array([h[i] for h in found], np.int64) for i in (0, 1))
        of = np.searchsorted(ranges, first, "right") - 1
        columns = {
            "license": pa.array([model.names[h[2]] for h in found], pa.string()),
            "coverage": pa.array([h[3] for h in found], pa.float64()),
            "precision": pa.array([h[4] for h in found], pa.float64()),
            "start": pa.array((first - ranges[of]).astype(np.int32)),
            "end": pa.array((last - ranges[of]).astype(np.int32)),
            "byte_start": pa.array(starts[first] - off[of]),
            "byte_end": pa.array(ends[last - 1] - off[of]),
        }
        spans = pa.StructArray.from_arrays(list(columns.values()), list(columns))
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), list_column(spans, np.searchsorted(of, np.arange(len(rows) + 1)))], names=["doc_id", "hits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_slices(docs.select("doc_id", F.col("text").cast("string").alias("text")), "text", work, f"doc_id {kind}, hits array<struct<license:string,coverage:double,precision:double,start:int,end:int,byte_start:bigint,byte_end:bigint>>")


def digest(docs: DataFrame) -> DataFrame:
    """Per row its hits: how many, the licenses, the best coverage, and the spans in words."""
    return scan(docs).select("doc_id", F.size("hits").cast("bigint").alias("n_hits"), F.array_join(F.array_sort(F.array_distinct("hits.license")), ",").alias("licenses"), F.coalesce(F.array_max("hits.coverage"), F.lit(0.0)).alias("coverage"), F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["license"], h["start"].cast("string"), h["end"].cast("string"))), ",").alias("spans"))


def brute_force(docs: list[tuple], templates=TEMPLATES, least: float = LEAST) -> list[tuple]:
    """(doc_id, licenses found) by longest common subsequences of all spans with all templates, for tests on short texts."""
    import re

    split = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    out = []
    for doc, text in docs:
        words, found = split(text or ""), []
        for t, (name, pattern) in enumerate(templates):
            before, _, rest = pattern.partition("{")
            phrase, _, after = rest.partition("}")
            whole, inner, at = split(before) + split(phrase) + split(after), split(phrase), len(split(before))
            m = len(whole)
            for i in range(len(words)):
                # One row for each first word: common subsequences of words[i:j] with the template, through the phrase if it has one.
                if words[i] not in whole:
                    continue
                row, past = [0] * (m + 1), [-1] * (m + 1)
                for j in range(i, min(len(words), i + int(m / least) + 1)):
                    new, new_past = [0] * (m + 1), [-1] * (m + 1)
                    for k in range(m):
                        new[k + 1] = row[k] + 1 if words[j] == whole[k] else max(row[k + 1], new[k])
                        if inner:
                            p = at + len(inner)
                            if k + 1 == p and words[j + 1 - len(inner) : j + 1] == inner and j + 1 - len(inner) >= i:
                                new_past[k + 1] = len(inner) + _common(words[i : j + 1 - len(inner)], whole[:at])
                            new_past[k + 1] = max(new_past[k + 1], past[k + 1], new_past[k] if k + 1 > p else -1, past[k] + 1 if past[k] >= 0 and k >= p and words[j] == whole[k] else -1)
                    row, past = new, new_past
                    best, span = (past if inner else row)[m], j - i + 1
                    if best >= least * m and best >= least * span:
                        found.append((3 * best - span - m, t, i, j + 1, name))
        chosen: list[tuple] = []
        for f in sorted(found, key=lambda f: (-f[0], f[1], f[2])):
            if all(f[3] <= c[2] or f[2] >= c[3] for c in chosen):
                chosen.append(f)
        out.append((doc, sorted({c[4] for c in chosen})))
    return out


def _common(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        old = row
        row = [0]
        for k, y in enumerate(b):
            row.append(old[k] + 1 if x == y else max(old[k + 1], row[k]))
    return row[-1]
