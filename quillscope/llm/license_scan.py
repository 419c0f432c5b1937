"""Operator 7, license scans: conditional compression.

A passage that quotes a license shrinks when it is compressed with that
license's wording as dictionary. Every text is read whole, as a row of words,
so neither line ends, blank lines nor comment marks matter. Candidate blocks of
a template are the stretches that hold enough of its words, in one piece or with
words changed, left out or put in; a template that has too many words which the
whole text lacks has none. Each candidate block is compressed with zstandard
once plain and once with each of its templates as raw dictionary. The bytes
saved, less those of wording that the block lacks, rank all candidates of a
text, and from the best on each is confirmed by its exact wording differences if
more than half of its words belong to no better one. All winners are returned,
with the words that are missing, inserted or replaced.

A template of up to 20 words must be there whole, with at most ``SLACK`` words
put in; a longer one may lack a tenth of its words, in their order.

Defined results: a null or empty text has no notice; ``line`` is the line on
which a notice starts and ``block`` the lines it stands on; repeated notices
each count; a tie goes to the first name; repeated rows and rows with a null
doc_id each give their notices; an empty table gives none; only doc_id and text
are read, so further columns don't matter. A text is held whole in memory, as a
list of its words.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import batch

# Parts that several licenses have in common word for word.
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_ADVERTISING = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the copyright holder."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'
_MIT_TERMS = ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE {} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_GNU = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."

#: Public wordings of license notices. ``bsd-opening`` and
#: ``mit-full`` are the first sentences alone, which don't tell the variants of
#: BSD and MIT apart; a whole wording wins against them.
TEMPLATES = {
    "0bsd": f"{_ISC}.{_ISC_WARRANTY}",
    "agpl-3.0-header": _GNU.format("program", "Affero ", "3"),
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-2-clause": f"{_BSD} {_BSD_BINARY} {_BSD_WARRANTY}",
    "bsd-3-clause": f"{_BSD} {_BSD_BINARY} {_BSD_NAMES} {_BSD_WARRANTY}",
    "bsd-4-clause": f"{_BSD} {_BSD_BINARY} {_BSD_ADVERTISING} {_BSD_NAMES} {_BSD_WARRANTY}",
    "bsd-opening": _BSD,
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-nd-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-nc-sa-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nd-4.0": "Licensed under CC BY-ND 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-2.0-header": _GNU.format("program", "", "2"),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": _GNU.format("program", "", "3"),
    "isc": f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.{_ISC_WARRANTY}",
    "lgpl-2.1-header": _GNU.format("library", "Lesser ", "2.1"),
    "lgpl-3.0-header": _GNU.format("program", "Lesser ", "3"),
    "mit": "Released under the MIT License.",
    "mit-0": f"{_MIT}, and to permit persons to whom the Software is furnished to do so." + _MIT_WARRANTY.format("AUTHORS OR COPYRIGHT HOLDERS"),
    "mit-full": f"{_MIT}.",
    "mit-text": _MIT + _MIT_TERMS + _MIT_WARRANTY.format("AUTHORS OR COPYRIGHT HOLDERS"),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "x11": _MIT + _MIT_TERMS + _MIT_WARRANTY.format("X CONSORTIUM") + " Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium.",
}
SHORT, SLACK, LACKING = 20, 20, 0.1
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_RESULT = pa.schema([("doc_id", pa.int64()), ("line", pa.int32()), ("license", pa.string()), ("exact", pa.bool_()), ("missing", pa.int32()), ("saved", pa.int32()), ("block", pa.string()), ("differences", pa.list_(pa.struct([("kind", pa.string()), ("template", pa.string()), ("found", pa.string())])))])
_RESULT_SQL = "doc_id long, line int, license string, exact boolean, missing int, saved int, block string, differences array<struct<kind:string,template:string,found:string>>"


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _common(masks: dict[str, int], n: int, words: list[str]) -> list[int]:
    """Length of the longest common subsequence of a template of ``n`` words
    with each prefix of ``words``, bit-parallel."""
    all_ones = (1 << n) - 1
    v, out = all_ones, [0]
    for w in words:
        u = v & masks.get(w, 0)
        if u:
            v = ((v + u) | (v - u)) & all_ones
            out.append(n - v.bit_count())
        else:
            out.append(out[-1])
    return out


def differences(template: list[str], found: list[str]) -> list[dict[str, str]]:
    """Words missing, inserted and replaced on the way from a template to what
    was found, along a longest common subsequence."""
    n, m = len(template), len(found)
    left = [[0] * (m + 1) for _ in range(n + 1)]  # common words of what follows
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            left[i][j] = left[i + 1][j + 1] + 1 if template[i] == found[j] else max(left[i + 1][j], left[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        a, b = i, j
        while i < n and j < m and template[i] == found[j]:
            i, j = i + 1, j + 1
        if i > a:
            continue
        while (i < n or j < m) and not (i < n and j < m and template[i] == found[j]):
            if j == m or (i < n and left[i + 1][j] >= left[i][j + 1]):
                i += 1
            else:
                j += 1
        kind = "replaced" if i > a and j > b else "missing" if i > a else "inserted"
        out.append({"kind": kind, "template": " ".join(template[a:i]), "found": " ".join(found[b:j])})
    return out


class Template:
    """One wording, and where it stands in a row of words."""

    def __init__(self, name: str, text: str):
        self.name, self.words = name, _words(text)
        self.n = len(self.words)
        self.bytes_a_word = len(text.encode()) / max(1, self.n)
        self.needs = Counter(self.words)
        self.allowed = 0 if self.n <= SHORT else int(LACKING * self.n)
        self.length = self.n + max(SLACK, self.n // 5)
        self.masks, self.back = {}, {}
        for i, w in enumerate(self.words):
            self.masks[w] = self.masks.get(w, 0) | 1 << i
            self.back[w] = self.back.get(w, 0) | 1 << (self.n - 1 - i)

    def possible(self, has: set[str]) -> bool:
        lacks, allowed = 0, self.allowed
        for w, n in self.needs.items():
            if w not in has:
                lacks += n
                if lacks > allowed:
                    return False
        return True

    def passages(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(start, end, missing words) of each quotation."""
        out, free, at = [], 0, 0
        while self.n and at + self.n <= len(words):
            try:
                at = words.index(self.words[0], at)
            except ValueError:
                break
            if words[at : at + self.n] == self.words:
                out.append((at, at + self.n, 0))
                at += self.n
            else:
                at += 1
        rest = []
        for start, end, _ in [*out, (len(words), len(words), 0)]:
            rest.append((free, start))
            free = end
        while rest:
            a, b = rest.pop()
            for s, e in self._runs(words, a, b):
                hit = self._whole(words, s, e) if self.n <= SHORT else self._aligned(words, s, e)
                if hit:
                    out.append(hit)
                    rest += [(s, hit[0]), (hit[1], b)]
                    break
        return sorted(out)

    def _runs(self, words: list[str], a: int, b: int) -> Iterator[tuple[int, int]]:
        """Spans of overlapping windows that have enough words of the template."""
        here, lacks, first, last = Counter(), self.n, None, None
        if b - a < self.n - self.allowed:
            return
        for i in range(a, b):
            w = words[i]
            if w in self.needs:
                here[w] += 1
                lacks -= here[w] <= self.needs[w]
            if i - a >= self.length and (old := words[i - self.length]) in self.needs:
                lacks += here[old] <= self.needs[old]
                here[old] -= 1
            if lacks <= self.allowed:
                first, last = (i if first is None else first), i
                if i - first >= self.length:
                    yield max(a, first + 1 - self.length), last + 1
                    first = None
            elif first is not None:
                yield max(a, first + 1 - self.length), last + 1
                first = None
        if first is not None:
            yield max(a, first + 1 - self.length), last + 1

    def _whole(self, words: list[str], a: int, b: int) -> tuple[int, int, int]:
        """The first stretch with all words, as short as it can be."""
        need, lacks, e = Counter(self.needs), self.n, a
        while lacks and e < b:
            lacks -= need[words[e]] > 0
            need[words[e]] -= 1
            e += 1
        s = a
        while need[words[s]] < 0:
            need[words[s]] += 1
            s += 1
        return s, e, 0

    def _aligned(self, words: list[str], a: int, b: int) -> tuple[int, int, int] | None:
        """The stretch with the template's words in order; a word at its edge
        counts if it lies within five words of others."""
        least = self.n - self.allowed

        def edge(found: list[int]) -> int:
            return max((i for i in range(len(found)) if found[i] >= least), key=lambda i: (found[i] - 0.2 * i, -i), default=0)

        e = edge(_common(self.masks, self.n, words[a:b]))
        if not e:
            return None
        found = _common(self.back, self.n, words[a : a + e][::-1])
        k = edge(found)
        return a + e - k, a + e, self.n - found[k]


class Templates:
    """Dictionaries and wordings of the templates, for one task."""

    def __init__(self, texts: dict[str, str], level: int = 3):
        import zstandard

        self.plain = zstandard.ZstdCompressor(level=level)
        self.all = [Template(name, text) for name, text in sorted(texts.items())]
        self.own = {name: zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for name, text in texts.items()}

    def notices(self, text: str) -> list[tuple]:
        """(line, template, exact, missing words, bytes saved, block, differences) of each notice of a text."""
        low = text.lower()
        words = _WORD.findall(low)
        has = set(words)
        likely = [t for t in self.all if t.possible(has)]
        if not likely:
            return []
        blocks = [(t, *p) for t in likely for p in t.passages(words)]
        if not blocks:
            return []
        spans = [m.span() for m in _WORD.finditer(low)]
        rivals = []
        for t, s, e, missing in blocks:
            raw = low[spans[s][0] : spans[e - 1][1]].encode("utf-8", "replace")
            saved = len(self.plain.compress(raw)) - len(self.own[t.name].compress(raw))
            exact = missing == 0 and words[s:e] == t.words
            rivals.append((missing * t.bytes_a_word - saved, not exact, -saved, t.name, s, e, missing, t))
        rivals.sort(key=lambda r: r[:6])
        claimed, out = bytearray(len(words)), []
        for _, inexact, saved, name, s, e, missing, t in rivals:
            # words that no better notice has taken must make up more than half
            # of this one; "CC BY 4.0 and CC BY-SA 4.0" shares its first words
            if any(claimed[s:e]) and t.n <= SHORT:
                e = min(s + t.length, len(words))
                if _common(t.masks, t.n, words[s:e])[-1] < t.n:
                    continue
            free = Counter(words[i] for i in range(s, e) if not claimed[i])
            if 2 * (free & t.needs).total() <= t.n:
                continue
            need, last = Counter(t.needs), s
            for i in sorted(range(s, e), key=lambda i: (claimed[i], i)):
                if need[words[i]] > 0:
                    need[words[i]] -= 1
                    claimed[i], last = 1, max(last, i)
            e = last + 1
            out.append((s, e, name, not inexact, missing, -saved, [] if not inexact else differences(t.words, words[s:e])))
        lines, rows = text.split("\n"), []
        ends = [i for i, c in enumerate(low) if c == "\n"]
        for s, e, name, exact, missing, saved, differs in sorted(out, key=lambda r: r[:6]):
            first, last = bisect_left(ends, spans[s][0]), bisect_left(ends, spans[e - 1][0])
            rows.append((first, name, exact, missing, saved, "\n".join(lines[first : last + 1]), differs))
        return rows


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, line, license, exact, missing, saved, block, differences) of each confirmed
    notice; ``exact`` when the template's words stand there in one piece."""
    if len(templates) > 10_000:
        raise ValueError("every task holds all templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for b in batches:
            own = own or Templates(templates)
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                rows += [(doc_id, *hit) for hit in own.notices(text.as_py() or "")]
            yield batch(_RESULT, *([r[i] for r in rows] for i in range(8)))

    return docs.select("doc_id", "text").mapInArrow(run, _RESULT_SQL)
