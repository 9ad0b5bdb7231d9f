"""Licence scan by the Dice coefficient over word bigrams (operator 7).

A text is compared as a whole, by paragraph, by line and by every run of consecutive
sentences, lines or paragraphs, so that a notice inside a longer text is found, however it
is broken up.  Each unit is normalised to lower-case words of ASCII letters and digits;
its set of word bigrams A is compared with that of each template B:

    dice = 2 |A and B| / (|A| + |B|)

As |A and B| is at most the smaller size, only templates with
t / (2 - t) |A| <= |B| <= (2 - t) / t |A| can reach a threshold t; they are kept sorted by
size, and the others are not looked at.  Runs are looked at for templates of which the whole
text has the bigrams that a match needs; a run grows sentence by sentence with its counts,
until it is too large or its first sentence adds nothing to the rest.  Whole numbers are compared, so results are exact.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from fractions import Fraction
from itertools import accumulate
from typing import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import handing_back

NUM, DEN = 80, 100           # a unit matches from a coefficient of NUM / DEN on
MAX_TEMPLATE_BYTES = 16 << 20    # templates travel with each task; more are refused
NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.")
BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON "
    "ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")

# Texts and usual notices of licences.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express '
        "or implied. See the License for the specific language governing permissions and limitations under the License."),
    "BSD-2-Clause": f"{BSD_CONDITIONS} {BSD_WARRANTY}",
    "BSD-3-Clause": (
        f"{BSD_CONDITIONS} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        f"products derived from this software without specific prior written permission. {BSD_WARRANTY}"),
    "BSD-notice": "Released under the BSD License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along "
        "with this program. If not, see <https://www.gnu.org/licenses/>."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
        "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the '
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        f"of the Software. {NO_WARRANTY}"),
    "MIT-notice": "Released under the MIT License.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_word = re.compile("[a-z0-9]+").findall
_paragraph = re.compile(r"\n[\x20\x09-\x0D]*\n")
_sentence = re.compile(r"\n|(?<=[.!?;:])[\x20\x09-\x0D]+")
_lower = {c: c + 32 for c in range(65, 91)}


def bigrams(text: str) -> frozenset[tuple[str, str]]:
    w = _word(text.translate(_lower))
    return frozenset(zip(w, w[1:]))


def units(text: str) -> set[str]:
    """The distinct units of a text: itself, its paragraphs and its lines."""
    return {text, *_paragraph.split(text), *text.split("\n")}


def _better(a: tuple[str, int, int], b: tuple[str, int, int] | None) -> bool:
    """Whether match a goes before b: by coefficient, then by name."""
    return b is None or (x := a[1] * b[2] - b[1] * a[2]) > 0 or x == 0 and a[0] < b[0]


def _rank(m: tuple[str, int, int]) -> tuple[Fraction, str]:
    return Fraction(-m[1], m[2]), m[0]


def _word_ends(parts: list[str]) -> list[int]:
    """Number of words up to the end of each part."""
    return list(accumulate(len(_word(p.translate(_lower))) for p in parts))


class Scanner:
    def __init__(self, templates: Mapping[str, str], num: int = NUM, den: int = DEN):
        if sum(len(t) for t in templates.values()) > MAX_TEMPLATE_BYTES:
            raise ValueError(f"templates of over {MAX_TEMPLATE_BYTES} bytes")
        known = sorted((len(b), name, b) for name, t in templates.items() if (b := bigrams(t)))
        self.sizes, self.known, self.num, self.den = [k[0] for k in known], known, num, den
        self.pairs = frozenset().union(*(b for _, _, b in known))
        self.words = frozenset(w for _, _, b in known for pair in b for w in pair)
        self.least = min(self.sizes, default=0) * num / (2 * den - num)
        self.most = max(self.sizes, default=0) * (2 * den - num) / num

    def match(self, a: frozenset[tuple[str, str]]) -> tuple[str, int, int] | None:
        """(name, shared bigrams, both sizes) of the best template for a unit's bigrams, the
        first by name on ties; null below the threshold."""
        n, num, den, best = len(a), self.num, self.den, None
        if not n:
            return None
        low = bisect_left(self.sizes, -(-n * num // (2 * den - num)))
        high = bisect_right(self.sizes, n * (2 * den - num) // num)
        for size, name, b in self.known[low:high]:
            both = len(a & b)
            if 2 * both * den >= num * (n + size):
                if _better(got := (name, both, n + size), best):
                    best = got
        return best

    def runs(self, text: str, whole: frozenset[tuple[str, str]]) -> list[tuple[int, int, tuple[str, int, int]]]:
        """(first word, end, match) of the runs of sentences that match a template: for each
        first sentence and template the best run, the shortest on ties."""
        num, den, have = self.num, self.den, self.pairs & whole
        near = [(size, name, b) for size, name, b in self.known if len(have & b) * (2 * den - num) >= size * num] if have else []
        if not near:
            return []
        w = _word(text.translate(_lower))
        pairs = list(zip(w, w[1:]))
        cuts = sorted({0, *_word_ends(_sentence.split(text))})
        out = []
        for size, name, b in near:
            most = size * (2 * den - num) // num
            for i, start in enumerate(cuts[:-1]):
                # without a bigram of the template the run is no worse from the next sentence on
                if b.isdisjoint(pairs[start:cuts[i + 1]]):
                    continue
                first = cuts[i + 1]
                seen, own, both, at, best = set(), set(pairs[start:first]), 0, start, None
                for end in cuts[i + 1:]:
                    for k in range(at, end - 1):
                        p = pairs[k]
                        if k >= first:
                            own.discard(p)
                        if p not in seen:
                            seen.add(p)
                            both += p in b
                    at, n = end - 1, len(seen)
                    # too large, or the same set as from the next sentence on
                    if n > most or not own:
                        break
                    got = name, both, n + size
                    if 2 * both * den >= num * (n + size) and (best is None or both * best[2][2] > best[2][1] * (n + size)):
                        best = start, end, got
                if best:
                    out.append(best)
        return out

    def _more(self, text: str, matched: set[str], found: list) -> int:
        """Distinct runs, taken best first and apart from each other, that meet no other matching unit."""
        if text in matched:
            return 0
        taken = []
        for parts in (_paragraph.split(text), text.split("\n")):
            ends = _word_ends(parts)
            taken += [(s, e) for p, s, e in zip(parts, [0, *ends], ends) if p in matched]
        covered = bytearray(max(e for _, e, _ in found))
        for s, e in taken:
            covered[s:e] = b"\1" * (min(e, len(covered)) - min(s, len(covered)))
        w, runs, used = _word(text.translate(_lower)), set(), bytearray(len(covered))
        for s, e, _ in sorted(found, key=lambda f: (_rank(f[2]), f[0])):
            if not any(used[s:e]):
                used[s:e] = b"\1" * (e - s)
                if not any(covered[s:e]):
                    runs.add(tuple(w[s:e]))
        return len(runs)

    def scan(self, text: str | None) -> tuple[str | None, float | None, int]:
        """(name, coefficient, matching units) of the best unit of a text."""
        if not text:
            return None, None, 0
        best, matched, whole = None, set(), bigrams(text)
        for u in units(text):
            got = self.match(whole if u is text else bigrams(u))
            if got:
                matched.add(u)
                if _better(got, best):
                    best = got
        matching = len(matched)
        if found := self.runs(text, whole):
            best = min([m for *_, m in found] + [best] * (best is not None), key=_rank)
            matching += self._more(text, matched, found)
        return (best[0], 2.0 * best[1] / best[2], matching) if best else (None, None, 0)


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text",
         num: int = NUM, den: int = DEN) -> DataFrame:
    """id_col, license (best template; null if none reaches num / den), score, n_units
    (distinct whole texts, paragraphs and lines that match a template, and the distinct runs
    that match apart from these, best first).

    Null and empty texts match nothing; ties go to the first name; one row per input row,
    repeated rows and null ids included; other columns are ignored; an empty table gives an
    empty result.  The templates travel with the tasks and are bounded in size."""
    scanner = Scanner(templates, num, den)

    @handing_back

    def run(batches):
        for b in batches:
            rows = [scanner.scan(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.float64(), pa.int64()))]],
                ["id", "license", "score", "n_units"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, license string, score double, n_units long")
    return out.withColumnRenamed("id", id_col)
