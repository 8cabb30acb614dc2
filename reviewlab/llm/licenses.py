"""Licence scans by Dice coefficient over word bigrams (operator 7).

Text is normalised to lower-cased words of letters and digits. Candidates are
every line, every sentence of a line, every paragraph (lines between blank
ones) and the whole text. A candidate of a bigrams and a template of b can
reach the coefficient t only if b is within a*t/(2-t) .. a*(2-t)/t; and it must
hold at least a*t/(2-t) bigrams that occur in some template. Both bounds are
counted on arrays for all candidates; what passes is compared exactly, as bags:
2 * common / (a + b). Templates are a fixed list, so they go to every task.

A licence that no candidate matches is looked for in all windows of words,
across lines and paragraphs. The best window starts and ends with a bigram of
its template, as others only lower the coefficient, and to reach t it must hold
b*t/(2-t) bigrams of the template within b*(2-t)/t. Only starts with as many
ahead are tried, each with every end within that size."""

from __future__ import annotations

from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlab.llm.common import Words, word_chunks
from reviewlab.llm.decontam import shingle_hashes

#: Notices by which texts name their licence, and short licences
#: in full, as their stewards publish them.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
        "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
        "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "All-rights-reserved": ["All rights reserved."],
}

_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution.")


def _gnu_notice(name: str, version: str, this: str = "This program") -> str:
    """The notice that the GNU licences tell to put into each file."""
    return (f"{this} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the "
            f"Free Software Foundation, either version {version} of the License, or (at your option) any later version. {this} is distributed "
            "in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
            f"FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.")


#: Notices and short licences beside ``TEMPLATES``
NOTICES: dict[str, list[str]] = {
    "BSD-3-Clause": [TEMPLATES["BSD-3-Clause"][0] + " " + _BSD_END],
    "BSD-2-Clause": [_BSD_2 + " " + _BSD_END],
    "GPL-2.0": [_gnu_notice("General Public License", "2")],
    "LGPL-2.1": [_gnu_notice("Lesser General Public License", "2.1", "This library")],
    "LGPL-3.0": [_gnu_notice("Lesser General Public License", "3")],
    "AGPL-3.0": [_gnu_notice("Affero General Public License", "3")],
}
#: Licences in full, by name
TEXTS = {"Apache-2.0": ["Apache-2.0"], "GPL-2.0": ["GPL-2"], "GPL-3.0": ["GPL-3"], "LGPL-2.1": ["LGPL-2.1"], "LGPL-3.0": ["LGPL-3"],
         "MPL-2.0": ["MPL-2.0"], "CC0-1.0": ["CC0-1.0"]}


def all_templates() -> dict[str, list[str]]:
    """``TEMPLATES`` with the full texts of ``TEXTS`` (read on the driver) and
    the notices of further licences."""
    out = {name: list(texts) for name, texts in TEMPLATES.items()}
    for more in ({name: [(Path(__file__).parent / "license_texts" / f).read_text("utf-8") for f in files] for name, files in TEXTS.items()}, NOTICES):
        for name, texts in more.items():
            out.setdefault(name, []).extend(texts)
    return out


SCANNED = "doc_id long, license string, dice double, first_byte long, last_byte long, n_places long"


class Templates:
    """Bigram bags of the templates, and which bigrams occur in any."""

    def __init__(self, templates: dict[str, list[str]]) -> None:
        names = [(name, text) for name, texts in templates.items() for text in texts]
        self.names = [n for n, _ in names]
        self.bags: list[Counter] = [Counter()] * len(names)
        for w in word_chunks(pa.array([t for _, t in names], pa.large_string()), letters_only=True):
            for i in range(len(w.bounds) - 1):
                self.bags[w.first + i] = Counter(shingle_hashes(w.hash[w.bounds[i]:w.bounds[i + 1]], 2).tolist())
        self.sizes = np.array([sum(b.values()) for b in self.bags])
        self.known = np.unique(np.array([h for b in self.bags for h in b], np.uint64))
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.known >> np.uint64(42)] = True
        #: how often each template (row) holds each known bigram (column)
        self.held = np.zeros((len(names), len(self.known)), np.int32)
        for row, bag in zip(self.held, self.bags):
            row[np.searchsorted(self.known, np.array(list(bag), np.uint64))] = list(bag.values())

    def numbers(self, bigrams: np.ndarray) -> np.ndarray:
        """Column of each bigram, -1 where no template holds it."""
        out = np.full(len(bigrams), -1)
        at = np.flatnonzero(self.maybe[bigrams >> np.uint64(42)])
        near = np.minimum(np.searchsorted(self.known, bigrams[at]), len(self.known) - 1)
        out[at] = np.where(self.known[near] == bigrams[at], near, -1)
        return out


def candidates(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, last word + 1) of every line, sentence, paragraph
    and whole text of a chunk, each once."""
    if not len(w.start):
        none = np.zeros(0, np.int64)
        return none, none, none
    text = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
    newlines = np.zeros(len(w.buf) + 1, np.int64)
    np.cumsum(w.buf == 10, out=newlines[1:])
    stops = np.zeros(len(w.buf) + 1, np.int64)
    ends = np.isin(w.buf[:-1], np.frombuffer(b".!?;", np.uint8)) & np.isin(w.buf[1:], np.frombuffer(b" \t\n\r", np.uint8)) if len(w.buf) else np.zeros(0, bool)
    np.cumsum(np.append(ends, False), out=stops[1:])
    between = newlines[w.start[1:]] - newlines[w.end[:-1]]
    other = text[1:] != text[:-1]
    spans = []
    for cut in (other, other | (between > 1), other | (between > 0), other | (between > 0) | (stops[w.start[1:]] > stops[w.end[:-1]])):
        first = np.append(0, np.flatnonzero(cut) + 1)
        spans.append(np.stack([first, np.append(first[1:], len(text))], 1))
    spans = np.unique(np.concatenate(spans), axis=0)
    return text[spans[:, 0]], spans[:, 0], spans[:, 1]


def scan_chunk(w: Words, t: Templates, threshold: float) -> dict[tuple[int, str], tuple[float, int, int, int]]:
    """For (text, licence): best coefficient, its first and last word, and how
    many candidates reach the threshold."""
    found: dict[tuple[int, str], tuple[float, int, int, int]] = {}
    text, first, last = candidates(w)
    n = last - first - 1
    bigrams = shingle_hashes(w.hash, 2)
    share = threshold / (2 - threshold)
    hits = np.zeros(len(bigrams) + 1, np.int64)
    number = t.numbers(bigrams)
    np.cumsum(number >= 0, out=hits[1:])
    sizes = np.sort(t.sizes)
    fits = (n >= np.ceil(sizes[0] * share)) & (n <= sizes[-1] / share)
    some = np.flatnonzero(fits & (n > 0))
    some = some[hits[last[some] - 1] - hits[first[some]] >= share * n[some] - 1e-9]
    for c in some.tolist():
        a = int(n[c])
        bag = Counter(bigrams[first[c]:last[c] - 1].tolist())
        for i in np.flatnonzero((t.sizes >= a * share - 1e-9) & (t.sizes <= a / share + 1e-9)).tolist():
            dice = 2 * sum((bag & t.bags[i]).values()) / (a + int(t.sizes[i]))
            if dice >= threshold:
                key = int(text[c]), t.names[i]
                old = found.get(key, (0.0, 0, 0, 0))
                new = (dice, int(first[c]), int(last[c]))
                found[key] = (*(new if (-dice, new[1], new[2]) < (-old[0], old[1], old[2]) else old[:3]), old[3] + 1)
    inside = np.ones(len(bigrams), bool)
    starts = w.bounds[1:-1] - 1  # a bigram of two texts is of none
    inside[starts[(starts >= 0) & (starts < len(bigrams))]] = False
    whole: dict[tuple[int, str], tuple[float, int, int, int]] = {}
    for key, place in windows(w, np.where(inside, number, -1), t, threshold):
        if key not in found:
            old = whole.get(key, (0.0, 0, 0, 0))
            best = min((place, old[:3]), key=lambda x: (-x[0], x[1], x[2]))
            whole[key] = (*best, old[3] + 1)
    return found | whole


def windows(w: Words, number: np.ndarray, t: Templates, threshold: float) -> Iterator[tuple[tuple[int, str], tuple[float, int, int]]]:
    """((text, licence), (coefficient, first word, last word + 1)) of windows
    that reach the threshold for a template: the best one, then the best of
    those that don't overlap it, and so on."""
    share = threshold / (2 - threshold)
    known = np.flatnonzero(number >= 0)
    text = np.searchsorted(w.bounds, known, "right") - 1
    for i in np.flatnonzero(t.sizes > 0).tolist():
        size = int(t.sizes[i])
        need, most = max(1, int(np.ceil(size * share - 1e-9))), int(size / share + 1e-9)
        if len(known) < need:
            continue
        mine = t.held[i][number[known]] > 0
        pos, of = known[mine], text[mine]
        if len(pos) < need:
            continue
        n = len(pos) - need + 1
        begins = np.flatnonzero((pos[need - 1:] - pos[:n] < most) & (of[need - 1:] == of[:n]))
        if not len(begins):
            continue
        name, limit = number[pos], t.held[i]
        # how often a bigram occurred before each position, and before a start
        order = np.argsort(name, kind="stable")
        group = np.flatnonzero(np.append(True, name[order][1:] != name[order][:-1]))
        rank = np.empty(len(pos), np.int64)
        rank[order] = np.arange(len(pos)) - np.repeat(group, np.diff(np.append(group, len(pos))))
        before, done = np.zeros(len(limit), np.int64), 0
        ends = np.minimum(np.searchsorted(pos, pos[begins] + most), np.searchsorted(of, of[begins], "right"))
        places: list[tuple[float, int, int]] = []
        for a, z in zip(begins.tolist(), ends.tolist()):
            np.add.at(before, name[done:a], 1)
            done = a
            common = np.cumsum(rank[a:z] - before[name[a:z]] < limit[name[a:z]])
            if common[-1] < need:
                continue
            dice = 2 * common / (pos[a:z] - pos[a] + 1 + size)
            best = int(np.argmax(dice))
            if dice[best] >= threshold:
                places.append((float(dice[best]), int(pos[a]), int(pos[a + best]) + 2))
        taken: list[tuple[int, int]] = []
        for dice, x, y in sorted(places, key=lambda p: (-p[0], p[1], p[2])):
            at = bisect(taken, (x, y))
            if (at and taken[at - 1][1] > x) or (at < len(taken) and taken[at][0] < y):
                continue
            taken.insert(at, (x, y))
            yield (int(np.searchsorted(w.bounds, x, "right") - 1), t.names[i]), (dice, x, y)


def license_scan(docs: DataFrame, threshold: float = 0.8, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, license, dice, first_byte, last_byte, n_places): for each row
    of ``docs`` (doc_id, text) and each licence that a candidate matches, the
    best coefficient with its place in the text (the first and shortest of
    equal ones; last byte not included), and how many pairs of candidate and
    template reach the threshold. A licence that only windows match has the
    best of all windows, and the count is of windows apart from each other.

    Null, empty and one-word texts match nothing. Repeated rows give repeated
    results; a null doc_id stays null. No rows: no result."""
    templates = all_templates() if templates is None else templates
    sent = docs.sparkSession.sparkContext.broadcast(templates)  # fixed texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Templates(sent.value)
        for b in batches:
            for w in word_chunks(b.column("text"), letters_only=True):
                out = []
                for (text, name), (dice, x, y, places) in sorted(scan_chunk(w, t, threshold).items()):
                    at = int(w.offsets[text])
                    out.append((b.column("doc_id")[w.first + text].as_py(), name, dice, int(w.start[x]) - at, int(w.end[y - 1]) - at, places))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.int64(), pa.string(), pa.float64()] + [pa.int64()] * 3)],
                                                     [f.split()[0] for f in SCANNED.split(", ")])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, SCANNED)
