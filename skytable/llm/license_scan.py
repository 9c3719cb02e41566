"""Licence scans: normalised text against licence templates by the Dice coefficient of word bigrams.

A text is cut into lines, and every window of neighbouring lines that can reach the threshold is a unit, so wrapped
notices are found, with blank lines in them and beside others too. With t the threshold, a unit of a bigrams and a template of b can reach it
only if b lies between a * t / (2 - t) and a * (2 - t) / t: templates stand in order of size, and only
that stretch is compared. Units that share too few bigrams with all templates together are ruled out
for whole batches before.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytable.llm import units
from skytable.llm.common import bounded_batches

THRESHOLD = 0.8

# The wording of common licence notices.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
        "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ],
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def bigrams(text: bytes) -> Counter:
    """Normalised word pairs: A-Z lowered, words are ASCII letters and digits and all other characters beyond ASCII."""
    words = [w.lower() for w in _WORD.findall(text)]
    return Counter(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    """Twice the common bigrams, by all bigrams; 0 if there are none."""
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


class _Templates:
    def __init__(self, templates: dict[str, list[str]], threshold: float):
        self.threshold = threshold
        rows = sorted(((b.total(), name, b) for name, texts in templates.items() for t in texts if (b := bigrams(t.encode()))), key=lambda r: r[:2])
        self.sizes = [r[0] for r in rows]
        self.rows = rows
        self.reach = threshold / (2 - threshold)
        pairs = sorted({w for _, _, b in rows for w in b})
        flat = [x for pair in pairs for x in pair]
        data = np.frombuffer(b"".join(flat), np.uint8)
        ends = np.cumsum([len(x) for x in flat])
        hashes = units.span_hashes(units.BYTE_VALUES[data], np.concatenate([[0], ends[:-1]]), ends) if flat else np.zeros(0, np.uint64)
        self.known = np.unique(hashes[0::2] * np.uint64(3) + hashes[1::2])

    def best(self, text: bytes) -> tuple[str, float, float] | None:
        """Name, coefficient and common pairs of the nearest template at the threshold or above; of equals the first name."""
        own = bigrams(text)
        size = own.total()
        lo, hi = bisect_left(self.sizes, size * self.reach - 1e-9), bisect_right(self.sizes, size / self.reach + 1e-9)
        found = [(-dice(own, b), name, n) for n, name, b in self.rows[lo:hi]]
        found = [f for f in found if -f[0] >= self.threshold]
        if not found:
            return None
        value, name, n = min(found)
        return name, -value, -value * (size + n) / 2

    def lines(self, data: np.ndarray, starts: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each line: words, word pairs and known pairs in it, and the same with the pair that leads into it from its text."""
        inside = _INSIDE[data]
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        at, to = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        line = np.searchsorted(starts, at, "right") - 1
        words = np.bincount(line, minlength=len(starts))
        if len(at) < 2 or not len(self.known):
            return (words, *[np.zeros(len(starts), np.int64)] * 4)
        hashes = units.word_hashes(data, at, to, lower=True)
        pair = hashes[:-1] * np.uint64(3) + hashes[1:]
        hit = self.known[np.minimum(np.searchsorted(self.known, pair), len(self.known) - 1)] == pair
        near, same = row[line[1:]] == row[line[:-1]], line[1:] == line[:-1]
        return (words, *[np.bincount(line[1:][w], minlength=len(starts)) for w in (same, same & hit, near, near & hit)])

    def enough(self, hits, total):
        """Whether so many known pairs of all can reach the threshold. If a window has enough, so has a line of it."""
        return (hits > 0) & (hits >= self.threshold / 2 * (1 + self.reach) * total - 1e-9)


def _notices(known: _Templates, raw: bytes, starts: np.ndarray, stops: np.ndarray, row: np.ndarray, counted: tuple[np.ndarray, ...]):
    """(first line, lines, name, dice) of windows that do not overlap and together match the most: common pairs times dice."""
    words, *_ = counted
    filled = np.flatnonzero(words)
    total, hits, led, led_hits = (c[filled] for c in counted[1:])
    most = known.sizes[-1] / known.reach + 1e-9
    ends = np.concatenate([[0], np.cumsum(led)])
    seen = np.concatenate([[0], np.cumsum(led_hits)])
    tried: dict[bytes, tuple[str, float, float] | None] = {}
    # Windows that hold a line with enough known pairs begin so far before it.
    seeds = np.flatnonzero(known.enough(hits, total) | known.enough(led_hits, led))
    begins = np.zeros(len(filled) + 1, np.int64)
    np.add.at(begins, np.searchsorted(ends[1:], ends[seeds] - most, "left"), 1)
    np.add.at(begins, seeds + 1, -1)
    windows = []
    for i in np.flatnonzero(np.cumsum(begins[:-1])).tolist():
        stop = int(np.searchsorted(ends, ends[i + 1] - total[i] + most, "right"))
        sizes = ends[i + 1 : stop] - ends[i + 1] + total[i]
        good = known.enough(seen[i + 1 : stop] - seen[i + 1] + hits[i], sizes) & (row[filled[i : i + len(sizes)]] == row[filled[i]])
        for j in (i + np.flatnonzero(good)).tolist():
            text = raw[starts[filled[i]] : stops[filled[j]]]
            if text not in tried:
                tried[text] = known.best(text)
            if found := tried[text]:
                windows.append((j, i, found[:2], found[1] * found[2]))
    return _heaviest(windows, filled)


def _heaviest(windows: list[tuple], filled: np.ndarray):
    windows.sort(key=lambda w: w[:2])
    lasts = [w[0] for w in windows]
    best, taken = [0.0], []
    for k, (j, i, _, weight) in enumerate(windows):
        before = bisect_left(lasts, i, 0, k)
        taken.append(before if best[before] + weight > best[k] else -1)
        best.append(max(best[k], best[before] + weight))
    out, k = [], len(windows)
    while k:
        if taken[k - 1] < 0:
            k -= 1
            continue
        j, i, found, _ = windows[k - 1]
        out.append((int(filled[i]), int(filled[j] - filled[i] + 1), *found))
        k = taken[k - 1]
    return out[::-1]


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Licence notices in every whole text: (doc_id, line, lines, license, dice), one row for each notice.

    ``docs`` has doc_id and text; other columns are not used. ``line`` is the first line of the notice from 0,
    ``lines`` how many it takes, blank ones between too. Windows of lines are notices if they reach the threshold; of those that
    overlap, the ones are kept that together match the most. A notice that is a part of a longer line is not looked for. Null and empty texts have no notices, equal rows give equal rows, and an empty table
    or an empty set of templates gives none.
    """
    known = _Templates(TEMPLATES if templates is None else templates, threshold)
    shared = docs.sparkSession.sparkContext.broadcast(known)  # bounded by the set of templates

    def run(batches):
        known = shared.value
        for batch in batches:
            rows = []
            for lo, hi, data, offsets in units.text_chunks(batch.column(1)):
                if not len(data) or not known.rows:
                    continue
                start = np.zeros(len(data), bool)
                start[1:] = data[:-1] == 0x0A
                start[offsets[:-1][np.diff(offsets) > 0]] = True
                starts = np.flatnonzero(start)
                stops = np.append(starts[1:], len(data))
                row = np.searchsorted(offsets, starts, "right") - 1
                firsts = np.searchsorted(starts, offsets)
                counted = known.lines(data, starts, row)
                for i, n, name, value in _notices(known, data.tobytes(), starts, stops, row, counted):
                    r = int(row[i])
                    rows.append((batch.column(0)[lo + r].as_py(), i - int(firsts[r]), n, name, value))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "line", "lines", "license", "dice"])

    source = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, line long, lines long, license string, dice double")
