"""License scans: winnowed template fingerprints pick candidates, banded alignment confirms them (operator 10)."""

from __future__ import annotations

import bisect
import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm._common import hash_spans, in_slices, mix, word_bounds

#: Public license notices and texts, as (name, text).
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_TAIL = ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.')
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program. If not, see https://www.gnu.org/licenses/."
_GNU_KINDS = (("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"), ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"), ("AGPL-3.0", "Affero General Public License", "3"))
_CC_KINDS = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
_CC_VERSIONS = (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International"))
TEMPLATES = (
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    *((f"{name}-notice", f"This work is licensed under the GNU {kind}, version {version}.") for name, kind, version in _GNU_KINDS),
    *((name, _GNU.format(kind, version)) for name, kind, version in _GNU_KINDS),
    ("MIT-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT-short", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *((f"CC-{short}-{version}", f"Licensed under CC {short} {version}.") for short, _ in _CC_KINDS for version, _ in _CC_VERSIONS),
    *((f"CC-{short}-{version}-long", f"This work is licensed under a Creative Commons {long} {version} {scope} License.") for short, long in _CC_KINDS for version, scope in _CC_VERSIONS),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("All-rights-reserved", "All rights reserved."),
)
#: Words that tell one license from another, and words whose number is a version.
TELLING = frozenset("cc by sa nc nd apache mit gnu lesser affero mozilla boost attribution sharealike noncommercial noderivatives".split())
_NUMBERED = TELLING | {"version", "v", "license"}
#: Words of a gram and grams of a winnowing window; half width of the alignment band; share of a template that counts.
GRAM, WINDOW, BAND, COVERAGE = 3, 2, 8, 0.8
#: Templates of fewer words are indexed by all their pairs of words: with a fifth of its words changed, a longer one has four
#: words in a row left, which hold a winnowed gram, a shorter one surely two.
SHORT, PAIR = 16, 2
_IS_ALNUM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_FOLD = np.uint64(0x8CB92BA72F3D8DD7)


def _words(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Word hashes (A-Z lower-cased), byte starts and ends, and the bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw.lower(), np.uint8)
    starts, ends = word_bounds(data, _IS_ALNUM)
    return hash_spans(data, starts, ends), starts, ends, raw


def _grams(h: np.ndarray, size: int = GRAM) -> np.ndarray:
    if len(h) < size:
        return np.zeros(0, np.uint64)
    acc = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        acc = mix(acc * _FOLD + h[k : len(h) - size + 1 + k])
    return acc


def winnowed(grams: np.ndarray) -> list[int]:
    """Places of the rightmost least gram of every window of WINDOW grams: any WINDOW grams in a row hold one."""
    picked = set()
    for at in range(max(1, len(grams) - WINDOW + 1) if len(grams) else 0):
        window = grams[at : at + WINDOW]
        picked.add(at + len(window) - 1 - int(np.argmin(window[::-1])))
    return sorted(picked)


class Template:
    """A template's word hashes, and which of its words a match must have: its version, and what tells a short one from others."""

    def __init__(self, name: str, text: str):
        self.name = name
        self.words, starts, ends, raw = _words(text)
        low = [raw[a:b].lower().decode() for a, b in zip(starts, ends, strict=True)]
        self.short = len(low) < SHORT
        self.needed: set[int] = set()
        for k, w in enumerate(low):
            if w.isdigit() and k and (low[k - 1] in _NUMBERED or k - 1 in self.needed and low[k - 1].isdigit()) or self.short and w in TELLING:
                self.needed.add(k)
        self.least = math.ceil(COVERAGE * len(low))
        self.counts, self.needed_words = Counter(self.words.tolist()), {int(self.words[k]) for k in self.needed}


@lru_cache(maxsize=1)
def index() -> tuple[list[Template], dict[int, tuple[np.ndarray, list[list[tuple[int, int]]]]]]:
    """Templates, and for pairs and for grams the inverted index: sorted fingerprints with their (template, place) lists."""
    templates = [Template(name, text) for name, text in TEMPLATES]
    out = {}
    for size in (PAIR, GRAM):
        posts: dict[int, list[tuple[int, int]]] = {}
        for t, template in enumerate(templates):
            if template.short == (size == PAIR):
                g = _grams(template.words, size)
                for p in range(len(g)) if template.short else winnowed(g):
                    posts.setdefault(int(g[p]), []).append((t, p))
        keys = sorted(posts)
        out[size] = (np.array(keys, np.uint64), [posts[k] for k in keys])
    return templates, out


@lru_cache(maxsize=1)
def _telling() -> frozenset[int]:
    return frozenset(int(_words(w)[0][0]) for w in TELLING)


def align(template: list[int], words: list[int], low: int, high: int, shift: int, band: int = BAND) -> tuple[int, list[tuple[int, int]]]:
    """Banded local alignment around a diagonal within words[low:high]: its score, and the (template, text) places of equal words.

    A match scores 2, a substitution and a gap cost 1. Cells farther than the band from the diagonal aren't looked
    at. Of equal scores the one that ends first in the text wins, then the one that ends first in the template.
    """
    width = 2 * band + 1
    rows, best = [], (0, 0, 0, 0)
    above = [0] * width
    for i, word in enumerate(template):
        here = [0] * width
        for b in range(max(0, low - i - shift + band), min(width, high - i - shift + band)):
            j = i + shift + b - band
            s = above[b] + (2 if word == words[j] else -1)
            if b + 1 < width and above[b + 1] - 1 > s:
                s = above[b + 1] - 1
            if b and here[b - 1] - 1 > s:
                s = here[b - 1] - 1
            if s > 0:
                here[b] = s
                if (s, -j, -i) > best[:3]:
                    best = (s, -j, -i, b)
        rows.append(here)
        above = here
    score, j, i, b = best[0], -best[1], -best[2], best[3]
    pairs = []
    while score and i >= 0 and rows[i][b] > 0:
        j, here = i + shift + b - band, rows[i][b]
        same = template[i] == words[j]
        before = rows[i - 1] if i else [0] * width
        if here == before[b] + (2 if same else -1):
            if same:
                pairs.append((i, j))
            i -= 1
        elif b + 1 < width and here == before[b + 1] - 1:
            i, b = i - 1, b + 1
        else:
            b -= 1
    return score, pairs[::-1]


def _accepted(template: Template, words: list[int], digits: set[int], pairs: list[tuple[int, int]]) -> bool:
    """Enough words, the needed ones among them, and in a short one no telling word or number of the text between them."""
    if len(pairs) < template.least or not template.needed <= {i for i, _ in pairs}:
        return False
    if not template.short:
        return True
    used = {j for _, j in pairs}
    return not any(j not in used and (j in digits or words[j] in _telling()) for j in range(pairs[0][1], pairs[-1][1] + 1))


def _possible(template: Template, window: list[int]) -> bool:
    """Whether a stretch of text has enough of the template's words, in any order, and the needed ones."""
    if len(window) < template.least or not template.needed_words <= set(window):
        return False
    return (Counter(window) & template.counts).total() >= template.least


def occurrences(template: Template, words: list[int], digits: set[int], seeds: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(matched, first, last word) of all matches of a template, none over another, from (text place, template place) seeds.

    Seeds are taken in the order of the text, each aligned along its diagonal in what no match has yet. A match that
    begins beyond its seed leaves a stretch before it, whose other seeds are taken next.
    """
    seeds, target, out = sorted(set(seeds)), template.words.tolist(), []
    todo = [(0, len(seeds), 0, len(words))]
    while todo:
        k, end, low, high = todo.pop()
        tried: set[int] = set()
        while k < end:
            p, q = seeds[k]
            k += 1
            if p < low or (shift := p - q) in tried:
                continue
            tried.add(shift)
            begin, stop = max(low, shift - BAND), min(high, shift + len(target) + BAND)
            if not _possible(template, words[begin:stop]):
                continue
            _, pairs = align(target, words, begin, stop, shift)
            if pairs and _accepted(template, words, digits, pairs):
                a, b = pairs[0][1], pairs[-1][1]
                out.append((len(pairs), a, b))
                before = bisect.bisect(seeds, (a, -1), k, end)
                if before > k:
                    todo.append((k, before, low, a))
                low, tried = b + 1, set()
                k = bisect.bisect(seeds, (low, -1), before, end)
    return out


def _apart(found: list[tuple[int, int, int, str, int]]) -> list[tuple[int, int, int, str, int]]:
    """Of matches that overlap the one with most words; what is taken is kept in order, so each looks at its neighbours only."""
    taken: list[tuple[int, int]] = []
    out = []
    for one in sorted(found, key=lambda x: (-x[0], x[4], x[1], x[3])):
        at = bisect.bisect(taken, (one[1], one[1]))
        if (not at or taken[at - 1][1] < one[1]) and (at == len(taken) or taken[at][0] > one[2]):
            taken.insert(at, (one[1], one[2]))
            out.append(one)
    return out


def find_licenses(text: str | None) -> list[tuple[str, int, int, int, int]]:
    """(name, start, end, matched, words of the template) in code points, by start; the fullest match of a place wins."""
    templates, indexes = index()
    h, starts, ends, raw = _words(text)
    seeds: dict[int, list[tuple[int, int]]] = {}
    for size, (keys, posts) in indexes.items():
        grams = _grams(h, size)
        if not len(grams):
            continue
        place = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        for p in np.flatnonzero(keys[place] == grams).tolist():
            for t, q in posts[place[p]]:
                seeds.setdefault(t, []).append((p, q))
    if not seeds:
        return []
    words = h.tolist()
    digits = {k for k in range(len(words)) if raw[starts[k] : ends[k]].isdigit()} if any(templates[t].short for t in seeds) else set()
    found = [(n, a, b, templates[t].name, len(templates[t].words)) for t, each in seeds.items() for n, a, b in occurrences(templates[t], words, digits, each)]
    out, at, byte = [], 0, 0
    for n, a, b, name, size in sorted(_apart(found), key=lambda x: x[1]):
        start = at + len(raw[byte : starts[a]].decode("utf-8", "surrogatepass"))
        at, byte = start + len(raw[starts[a] : ends[b]].decode("utf-8", "surrogatepass")), int(ends[b])
        out.append((name, start, at, n, size))
    return out


def license_spans(documents: DataFrame) -> DataFrame:
    """Licenses in every whole text: doc_id, n_licenses, licenses and spans.

    Needs doc_id and text; other columns are ignored. A text's 3-word grams are looked up among the winnowed
    fingerprints of the templates (a fixed table, so the index has a fixed size), its pairs of words among those of
    short templates. Each hit is aligned along its diagonal in the stretch of text that no match of the template has
    yet, so every repeat is found, and counts with 80 % of the template's words matched, its version among them; of a
    short one also the words that tell it from others. A match with so many words, none of them changed by more than
    replacement or omission, always has a hit; one with words put in between most of its words may have none.
    licenses has the names, in order of place, comma-joined; spans start:end:matched:words in code points, joined
    likewise. Of matches that overlap the one with most words stays, then the shorter template, the earlier place,
    the name. One pass, no shuffle. A null or blank text has none; each row is judged by itself, so repeated rows
    give repeated results.
    """

    def run(batches):
        for batch in batches:
            rows = [find_licenses(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(r) for r in rows], pa.int64()), pa.array([",".join(x[0] for x in r) for r in rows], pa.string()), pa.array([",".join(f"{a}:{b}:{m}:{n}" for _, a, b, m, n in r) for r in rows], pa.string())],
                names=["doc_id", "n_licenses", "licenses", "spans"],
            )

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(in_slices(run), "doc_id long, n_licenses long, licenses string, spans string")
