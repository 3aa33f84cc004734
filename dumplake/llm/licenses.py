"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Texts and templates are runs of lower-cased words, compared by shingles of five words. For every power of two ``s`` there are
windows of ``2 s`` shingles, one every ``s``, so any stretch of ``s`` shingles lies whole in a window. A template with at
most ``s`` and more than ``s / 2`` shingles is looked up among these windows. The minima of a window are the smaller
of two neighbouring minima, so all window sizes together cost one pass. ``band_settings`` picks the bands so
that a window which contains ``CONTAINMENT`` of a template shares a band with it with a probability of at least
``CERTAINTY``. With one row a band, a window is only retrieved if it shares a shingle with the template. Whatever is
retrieved is compared exactly.

Defined results: null and empty texts and texts shorter than five words match nothing; templates shorter than five words are refused;
a template found several times in a text is one row with its best window, of equal ones the first; repeated rows are matched each. Of the
input only ``doc_id`` is kept.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dumplake.llm.frames import mix, shingle_hashes, text_or_empty, word_hashes

SHINGLE = 5
CONTAINMENT = 0.8
CERTAINTY = 0.999
#: Shingles of one step through a very long text.
STEP = 1 << 18

# Notices and licence texts that documents carry, by SPDX name where there is one.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0 notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "MIT text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
        "THE SOFTWARE."),
    "ISC text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."),
    "GPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
}


def band_settings(jaccard: float, certainty: float = CERTAINTY, rows: int = 1) -> int:
    """The fewest bands of ``rows`` hash functions that collide with ``certainty`` at similarity ``jaccard``."""
    return max(1, math.ceil(math.log(1 - certainty) / math.log(max(1e-12, 1 - jaccard**rows))))


class Templates:
    """Templates by window size, with the band keys to look for."""

    def __init__(self, templates: dict[str, str], containment: float = CONTAINMENT, certainty: float = CERTAINTY, rows: int = 1):
        self.containment = containment
        self.classes: dict[int, list[tuple[str, np.ndarray]]] = {}
        for name, text in sorted(templates.items()):
            words = word_hashes(text)
            if len(words) < SHINGLE:
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            own = np.unique(shingle_hashes(words, SHINGLE))
            # The window must hold the template whole, repeats included.
            self.classes.setdefault(1 << (len(words) - SHINGLE).bit_length(), []).append((name, own))
        self.bands = {}
        for size, members in self.classes.items():
            n = min(len(own) for _, own in members)
            # All of the window's other shingles may be foreign: the least similarity at the least containment.
            shared = np.ceil(containment * n)
            self.bands[size] = band_settings(shared / (2 * size + n - shared), certainty, rows)
        self.rows, self.hashes = rows, rows * max(self.bands.values())
        self.mul = np.random.default_rng(11).integers(0, 2**63, self.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.keys = {s: [self._keys(self._minima(own)[:, None], s)[:, 0] for _, own in m] for s, m in self.classes.items()}

    def _minima(self, shingles: np.ndarray) -> np.ndarray:
        return np.array([(shingles * m).min() for m in self.mul], np.uint64)

    def _keys(self, minima: np.ndarray, size: int) -> np.ndarray:
        """Band keys (bands by windows) of the minima (hash functions by windows)."""
        bands, rows = self.bands[size], self.rows
        if rows == 1:
            return minima[:bands]
        out = np.zeros((bands, minima.shape[1]), np.uint64)
        for r in range(rows):
            out = mix(out + minima[r : bands * rows : rows])
        return out

    def match(self, text: str) -> list[tuple[str, float, int, int]]:
        """Template, containment, first word and number of words of the best window, for every template that is found."""
        shingles = shingle_hashes(words, SHINGLE) if len(words := word_hashes(text)) >= SHINGLE else np.empty(0, np.uint64)
        best: dict[str, tuple[float, int, int]] = {}
        widest = 2 * max(self.classes)
        for at in range(0, len(shingles), STEP):
            self._step(shingles[at : at + STEP + widest], at, best)
        return [(name, *best[name]) for name in sorted(best)]

    def _step(self, shingles: np.ndarray, offset: int, best: dict) -> None:
        n, top = len(shingles), max(self.classes)
        padded = np.full(-(-n // top) * top, np.uint64(2**64 - 1))
        found: dict[int, list[np.ndarray]] = {s: [] for s in self.classes}
        minima = {s: [] for s in self.classes if self.rows > 1}
        for h in range(self.hashes):
            np.multiply(shingles, self.mul[h], out=padded[:n])
            low, s = padded, 1
            while True:
                if s in self.classes and h < self.bands[s] * self.rows:
                    window = np.minimum(low, np.append(low[1:], np.uint64(2**64 - 1)))
                    if s in minima:
                        minima[s].append(window)
                    else:  # one row a band: the minimum is the key
                        for t, keys in enumerate(self.keys[s]):
                            hit = np.flatnonzero(window == keys[h])
                            if len(hit):
                                found[s].append(hit * len(self.classes[s]) + t)
                if s == top:
                    break
                low, s = np.minimum(low[::2], low[1::2]), 2 * s
        for s, rows in minima.items():
            keys = self._keys(np.array(rows), s)
            for t, own in enumerate(self.keys[s]):
                found[s].append(np.flatnonzero((keys == own[:, None]).any(axis=0)) * len(self.classes[s]) + t)
        for s, hits in found.items():
            for code in np.unique(np.concatenate(hits)) if hits else ():
                w, (name, own) = int(code) // len(self.classes[s]), self.classes[s][int(code) % len(self.classes[s])]
                part = shingles[w * s : (w + 2) * s]
                inside = np.isin(part, own)
                share = len(np.unique(part[inside])) / len(own)
                if share >= self.containment:
                    places = np.flatnonzero(inside)
                    row = (share, offset + w * s + int(places[0]), int(places[-1] - places[0]) + SHINGLE)
                    if name not in best or (-row[0], row[1]) < (-best[name][0], best[name][1]):
                        best[name] = row


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """``doc_id, license, containment, first_word, n_words`` for every template that a text contains. No shuffle."""
    texts = TEMPLATES if templates is None else templates

    def run(batches):
        table = Templates(texts, containment)
        for pdf in batches:
            got = [(k, *m) for k, text in zip(pdf["k"], pdf["text"]) for m in table.match(text)]
            yield pd.DataFrame(got, columns=["k", "license", "containment", "first_word", "n_words"])

    null = -(2**63)
    found = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(null)).alias("k"), text_or_empty().alias("text")).mapInPandas(
        run, "k long, license string, containment double, first_word long, n_words long")
    return found.select(F.when(F.col("k") != null, F.col("k")).alias("doc_id"), "license", "containment", "first_word", "n_words")
