"""License scans: winnowed fingerprints pick candidates, banded alignment reports them."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Wordings of public licenses and of the lines that grant them. Fixed values.
TEMPLATES = {
    "apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0/header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit/line": "Released under the MIT License.",
    "mit/text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "gpl-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0/header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "bsd/conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution."
    ),
    "bsd/disclaimer": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
        "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
        "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "lgpl/header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "agpl-3.0/header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "isc/text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "mpl-2.0/header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "mit/grant": "Licensed under the MIT License.",
    "gpl-2.0/line": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-3.0/line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0/line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "bsd/line": "Licensed under the BSD License.",
    "mpl-2.0/line": "Licensed under the Mozilla Public License, Version 2.0.",
    "cc-by-4.0/sentence": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}
TEMPLATES |= {f"cc-{kind}-4.0/line": f"Licensed under CC {kind.upper()} 4.0." for kind in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")}
# Words of a grant that do not say which license is granted. Fixed values.
GRANT_WORDS = frozenset("a an the this is are work code file files software released licensed distributed available under with terms conditions of license licence version v and or".split())
MAX_TEMPLATE_WORDS = 1_000_000
WORDS = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Scan:
    """Words of a gram; grams of which one is kept; steps off the diagonal; least coverage; templates below so many words are short."""

    gram: int = 3
    window: int = 3
    band: int = 8
    coverage: float = 0.8
    short: int = 16


class Index:
    """Inverted index from fingerprints to places in templates."""

    def __init__(self, templates: dict[str, str], how: Scan):
        self.how, self.names = how, sorted(templates)
        self.vocabulary: dict[str, int] = {}
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in WORDS.findall(templates[n].lower())], dtype=np.int64) for n in self.names]
        if sum(map(len, self.words)) > MAX_TEMPLATE_WORDS:
            raise ValueError("the templates are too large to be sent to every task")
        # Short templates keep every gram, of two words too: one edit leaves no winnowed one of them.
        places: dict[int, dict[int, list[tuple[int, int]]]] = {size: defaultdict(list) for size in sorted({2, how.gram})}
        for t, words in enumerate(self.words):
            for size in places if self.is_short(t) else (how.gram,):
                grams = self.grams(words, size)
                for at in range(len(grams)) if self.is_short(t) else self._winnowed(grams):
                    places[size][int(grams[at])].append((t, at))
        self.keys = {size: np.array(sorted(found), dtype=np.int64) for size, found in places.items()}
        self.places = {size: [found[int(k)] for k in self.keys[size]] for size, found in places.items()}
        # Which license a short template grants is said by few of its words.
        grants = {self.vocabulary[w] for w in GRANT_WORDS if w in self.vocabulary}
        self.naming = [frozenset(words.tolist()) - grants if self.is_short(t) else frozenset() for t, words in enumerate(self.words)]
        self.names_of_others = [frozenset().union(*self.naming) - frozenset(words.tolist()) if self.is_short(t) else frozenset() for t, words in enumerate(self.words)]

    def is_short(self, t: int) -> bool:
        return len(self.words[t]) < self.how.short

    def band(self, t: int) -> int:
        """Steps off the diagonal: never so many that the next copy of a short line is within reach."""
        return min(self.how.band, len(self.words[t]) // 2)

    def grams(self, ids: np.ndarray, size: int) -> np.ndarray:
        """A number for each gram; -1 where a word is in no template."""
        n = len(ids) - size + 1
        if n < 1:
            return np.zeros(0, dtype=np.int64)
        out, known = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        for k in range(size):
            out = out * (len(self.vocabulary) + 1) + ids[k : n + k]
            known &= ids[k : n + k] >= 0
        return np.where(known, out, -1)

    def _winnowed(self, grams: np.ndarray) -> list[int]:
        """Of every window of grams the rightmost with the least hash."""
        h = (grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        width = min(self.how.window, len(h))
        return sorted({a + max(range(width), key=lambda k: (-int(h[a + k]), k)) for a in range(len(h) - width + 1)}) if width else []

    def hits(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, place in it, place in the text) of shared fingerprints."""
        out = []
        for size, keys in self.keys.items():
            grams = self.grams(ids, size)
            if len(grams) and len(keys):
                at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
                out += [(t, p, int(k)) for k in np.flatnonzero(keys[at] == grams) for t, p in self.places[size][at[k]]]
        return out

    def match(self, t: int, ids: np.ndarray, shift: int) -> tuple[float, int, int, int] | None:
        """(coverage, equal words, first, last + 1) if the template stands near ``shift``.

        Coverage is the share of the template's words that are found in order; words
        of the match beyond the template's length count as if they were wanted too. A
        short template must be found with all its naming words and without those of
        others: four of five words would let one license pass for another.
        """
        template, band = self.words[t], self.band(t)
        near = frozenset(ids[max(0, shift - band) : max(0, shift + len(template) + band)].tolist())
        # No alignment has more equal words than the template has words nearby.
        if sum(w in near for w in template.tolist()) < self.how.coverage * len(template):
            return None
        n, first, last = aligned(template, ids, shift, band)
        if not n or n < self.how.coverage * max(len(template), last - first):
            return None
        held = frozenset(ids[first:last].tolist())
        if not self.naming[t] <= held or self.names_of_others[t] & held:
            return None
        return n / max(len(template), last - first), n, first, last


def aligned(template: np.ndarray, words: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """(equal words, first, last + 1) of the best local alignment within a band.

    ``shift`` is the place in the text at which the template would begin; an equal
    word scores 1, a substitution or gap -1.
    """
    width = 2 * band + 1
    score, equal, begin = [0] * width, [0] * width, [0] * width
    best = (0, 0, 0, 0)
    for i, wanted in enumerate(template.tolist()):
        row, row_equal, row_begin = [0] * width, [0] * width, [0] * width
        for k in range(width):
            j = i + shift + k - band
            if not 0 <= j < len(words):
                continue
            same = words[j] == wanted
            choices = [(score[k] + (1 if same else -1), equal[k] + same, begin[k] if score[k] > 0 else j)]
            if k + 1 < width:
                choices.append((score[k + 1] - 1, equal[k + 1], begin[k + 1]))
            if k:
                choices.append((row[k - 1] - 1, row_equal[k - 1], row_begin[k - 1]))
            s, e, b = max(choices, key=lambda c: (c[0], c[1]))
            if s > 0:
                row[k], row_equal[k], row_begin[k] = s, e, b
                if (s, e) > best[:2]:
                    best = (s, e, b, j + 1)
        score, equal, begin = row, row_equal, row_begin
    return int(best[1]), best[2], best[3]


@cache
def _index(templates: tuple[tuple[str, str], ...], how: Scan) -> Index:
    return Index(dict(templates), how)


def matches(text: str, index: Index) -> list[tuple[str, float, int, int, int]]:
    """(template, coverage, equal words, start, finish) of all matches in a text, in characters."""
    how, low = index.how, text.lower() if text.isascii() else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found = WORDS.findall(low)
    ids = np.fromiter((index.vocabulary.get(w, -1) for w in found), dtype=np.int64, count=len(found))
    groups = defaultdict(list)
    for t, p, k in index.hits(ids):
        groups[t].append(k - p)
    if not groups:
        return []
    spans = [m.span() for m in WORDS.finditer(low)]
    out = []
    for t, shifts in groups.items():
        shifts.sort()
        reach, taken = index.band(t) // 2, None
        for k, shift in enumerate(shifts):
            if taken is not None and shift - shifts[k - 1] <= reach and shift < taken:
                continue  # the same candidate
            taken = shift + reach
            found_at = index.match(t, ids, shift)
            if found_at is not None:
                coverage, n, first, last = found_at
                out.append((index.names[t], coverage, n, spans[first][0], spans[last - 1][1]))
    return _without_overlaps(out)


def _without_overlaps(found: list[tuple[str, float, int, int, int]]) -> list[tuple[str, float, int, int, int]]:
    """Of matches that overlap, the one with most equal words, then the greatest coverage."""
    kept: list[tuple[str, float, int, int, int]] = []
    starts: list[int] = []  # of the kept ones, which are disjoint and in order
    for match in sorted(found, key=lambda m: (-m[2], -m[1], m[3], m[0])):
        at = bisect_left(starts, match[3])
        if (at == 0 or kept[at - 1][4] <= match[3]) and (at == len(kept) or kept[at][3] >= match[4]):
            starts.insert(at, match[3])
            kept.insert(at, match)
    return kept


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, how: Scan = Scan(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Matches of license templates in whole texts.

    Returns one row per match: id, ``license``, ``coverage`` (share of the
    template's words that are found in order, lowered by further words inside the
    match), ``n_words`` (those words), ``start`` and ``finish`` (characters). Words
    are runs of Latin letters and digits in lower case. A match shares a fingerprint
    with its template (winnowed three-word grams; all grams of two and three words
    of templates below ``how.short`` words), has at least ``how.coverage`` within
    ``how.band`` words off the diagonal, for short templates half their length, and
    holds all words that name the license of a short template and none that name
    another. Of overlapping matches the longest is reported. Null and empty texts
    match nothing; equal rows are reported each; ids may be null. The index goes to
    every task: its size is limited to a million template words.
    """
    chosen = tuple(sorted((TEMPLATES if templates is None else templates).items()))
    _index(chosen, how)  # checks the size
    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(chosen, how)
        for batch in batches:
            at, rows = [], []
            for k, text in enumerate(batch["text"].to_pylist()):
                found = matches(text, index)
                at.extend([k] * len(found))
                rows.extend(found)
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([batch["id"].take(pa.array(at, pa.int64())), *map(pa.array, columns, types)], names=["id", "license", "coverage", "n_words", "start", "finish"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(scanned, f"id {kind}, license string, coverage double, n_words long, start long, finish long").withColumnRenamed("id", id_column)
