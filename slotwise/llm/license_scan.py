"""License scans: normalised text against licence templates by the Dice coefficient of word bigrams.

The units of a document are its lines, its paragraphs (between blank lines), its whole text, and
windows of consecutive words, wherever they begin and end, for licences of several paragraphs or
beside other text. A unit of a bigrams and a template of b, c of them common, have the Dice coefficient 2c / (a + b). As
c is at most the smaller of both, a coefficient of t needs a and b within a factor of (2 - t) / t;
templates outside are never compared. The others are found through an index from bigrams to
templates, so a unit that shares no bigram with any costs one lookup a bigram.

Windows begin and end with a bigram of their template, as any other word at the ends only lowers the
coefficient, and have at most (2 - t) / t times its words. A text without enough of a template's
bigrams has no window for it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, whole_text

THRESHOLD = 0.9

# Licence texts and notices, (name, text). Holders and years are not part of them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR
ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE
IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The
above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""),
)

# A copyright clause: its mark and years, and the holder up to the end of the sentence or line. A full stop after an
# initial or a company's form ends no sentence.
_NOTICE = re.compile(
    r"(?im)^[^\w\n©(]*(?:copyright|\(c\)|©)[^\n]*?\b\d{4}\b"
    r"(?:[^\n.;]|[.;](?!\s)|(?<=\b\w)\.|(?<=\binc)\.|(?<=\bltd)\.|(?<=\bco)\.|(?<=\bcorp)\.|(?<=\bllc)\.)*[.;]?"
)
_OTHER = re.compile(r"[^\w\n]+|_+")


def normalised_lines(text: str) -> list[list[str]]:
    """Words of each line: lower case, letters and digits only, without copyright clauses."""
    return _words(_NOTICE.sub("", text))


def _words(text: str) -> list[list[str]]:
    return [line.split() for line in _OTHER.sub(" ", text.lower()).split("\n")]


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


def _units(lines: list[list[str]]) -> Iterator[tuple[int, int, list[str]]]:
    """(first line, last line, words) of all lines, of all paragraphs of several lines, and of the whole text."""
    start, seen = 0, set()
    for end in range(len(lines) + 1):
        if end < len(lines) and lines[end]:
            yield end, end, lines[end]
            seen.add((end, end))
            continue
        if end - start > 1:
            yield start, end - 1, [w for line in lines[start:end] for w in line]
            seen.add((start, end - 1))
        start = end + 1
    filled = [k for k, line in enumerate(lines) if line]
    if filled and (filled[0], filled[-1]) not in seen:
        yield filled[0], filled[-1], [w for line in lines for w in line]


class Templates:
    """Bigrams of the templates, and which templates have which."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.names = [name for name, _ in templates]
        words = [[w for line in normalised_lines(text) for w in line] for _, text in templates]
        sets = [bigrams(own) for own in words]
        self.lengths = [int((len(own) - 1) * (2 - threshold) / threshold) for own in words]  # bigrams of a window
        self.sizes = [len(s) for s in sets]
        self.index: dict[tuple[str, str], list[int]] = {}
        for k, own in enumerate(sets):
            for pair in own:
                self.index.setdefault(pair, []).append(k)
        self.largest = max(self.sizes, default=0) * (2 - threshold) / threshold

    def matches(self, text: str) -> Iterator[tuple[float, str, int, int]]:
        """(coefficient, name, first line, last line) of all units that reach the threshold, best template each.

        Windows inside or across the end of another unit that matched, or around one of no smaller a
        template, are part of the same licence and not given out.
        """
        taken: list[tuple[int, int, int]] = []
        for first, last, words in _units(normalised_lines(text)):
            # A unit repeats some bigrams at most; one word alone has none.
            if len(words) < 2:
                continue
            own = bigrams(words)
            if len(own) > self.largest:
                continue
            common: dict[int, int] = {}
            for pair in own & self.index.keys():
                for k in self.index[pair]:
                    if self.threshold * (len(own) + self.sizes[k]) <= 2 * min(len(own), self.sizes[k]):
                        common[k] = common.get(k, 0) + 1
            reached = [
                (2 * c / (len(own) + self.sizes[k]), self.names[k], k) for k, c in common.items()
                if 2 * c >= self.threshold * (len(own) + self.sizes[k])
            ]
            if reached:
                value, name, k = min(reached, key=lambda r: (-r[0], r[1]))
                taken.append((first, last, self.sizes[k]))
                yield value, name, first, last
        yield from self._windows(text, taken)

    def _windows(self, text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[float, str, int, int]]:
        # Copyright clauses stay: where no sentence ends, the licence may follow on the same line.
        lines = _words(text)
        words = [w for line in lines for w in line]
        common: dict[int, int] = {}
        for pair in bigrams(words) & self.index.keys():
            for k in self.index[pair]:
                common[k] = common.get(k, 0) + 1
        # A window has at least so many of its template's bigrams.
        least = {k: self.threshold * self.sizes[k] / (2 - self.threshold) for k in common}
        hits: dict[int, list[int]] = {k: [] for k, c in common.items() if c >= least[k] - 1e-9}
        if not hits:
            return
        for at, pair in enumerate(zip(words, words[1:])):
            for k in self.index.get(pair, ()):
                if k in hits:
                    hits[k].append(at)
        line_of = [k for k, line in enumerate(lines) for _ in line]
        chosen: list[tuple[int, int]] = []
        found = []
        for k, places in hits.items():
            found += [(-self.sizes[k], -value, self.names[k], a, b) for value, a, b in self._of_template(k, words, places, least[k])]
        # The largest template first, so that a short one inside a longer licence is not told twice.
        for size, value, name, a, b in sorted(found):
            first, last = line_of[a], line_of[b]
            if any(a <= y and x <= b for x, y in chosen):
                continue
            if any(f <= last and first <= t and not (first <= f and t <= last and n < -size) for f, t, n in taken):
                continue
            chosen.append((a, b))
            yield -value, name, first, last

    def _of_template(self, k: int, words: list[str], places: list[int], least: float) -> Iterator[tuple[float, int, int]]:
        """(coefficient, first word, last word) of the windows that fit a template, the best of each neighbourhood."""
        own, inside, i = set(places), {(words[p], words[p + 1]) for p in places}, 0
        while i < len(places):
            best = None
            until = None
            while i < len(places) and (until is None or places[i] <= until):
                start = places[i]
                i += 1
                end = start + self.lengths[k]
                if bisect_right(places, end - 1) - i + 1 < least - 1e-9:
                    continue
                seen: set[tuple[str, str]] = set()
                common = 0
                for at in range(start, min(end, len(words) - 1)):
                    pair = (words[at], words[at + 1])
                    if pair not in seen:
                        seen.add(pair)
                        common += pair in inside
                    if at in own and 2 * common >= self.threshold * (len(seen) + self.sizes[k]):
                        value = 2 * common / (len(seen) + self.sizes[k])
                        if best is None or value > best[0]:
                            best = value, start, at + 1
                # Where a window fits, those that begin a little later may fit better.
                if best is not None and until is None:
                    until = start + self.lengths[k] - int(least)
            if best is not None:
                yield best
                i = max(i, bisect_right(places, best[2] - 1))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES,
                  threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, license (best match, or null), dice (of that match, or 0), n_matches,
    licenses (all names found, sorted, comma-joined), first_line and last_line (of the best match, from 0).

    Of equal coefficients the first name in the alphabet wins, then the first lines. Null texts count
    as empty and match nothing; repeated rows each get their answer; an empty table gives an empty
    result. Whole texts are read, however long.
    """

    def scan(stream):
        known = Templates(templates, threshold)
        for id_, text in stream:
            found = sorted(known.matches(text), key=lambda m: (-m[0], m[1], m[2], m[3]))
            names = ",".join(sorted({m[1] for m in found}))
            value, name, first, last = found[0] if found else (0.0, None, None, None)
            yield id_, name, value, len(found), names, first, last

    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    return mapped(
        rows, "id long, license string, dice double, n_matches long, licenses string, first_line int, last_line int", scan
    )
