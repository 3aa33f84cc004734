"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over Hamming blocks, exact similarity.

A window has as many words as the benchmark item it may match. Windows without a shingle (five words) of any item have
similarity zero with every item, so fingerprints are made where a window shares one. A window and an item with fingerprints
at most ``RADIUS`` bits apart are at most ``RADIUS // 5`` bits apart in one of five bit blocks; each item is listed under all
block values that near, so looking up a window's five block values gives every item within the radius. Candidates are
then compared exactly, by the weighted Jaccard similarity of their shingles. The radius of 16 of 64 bits holds 99 % of pairs at the similarity of 0.8 if their shingles
are independent, and practically all that are closer.

Items are looked up in chunks of ``CHUNK_ITEMS``, one pass over the documents each, so the tables sent to the
executors have a fixed bound and no item is left out.

Defined results: null and empty texts and items without a word match nothing; an item shorter than a shingle is one shingle
of all its words; repeated rows are matched each; equal items with different ids are matched each. Of several windows with an equal best
similarity the first counts. Columns of the input stay in ``clean``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dumplake.llm.frames import keyed, mix, shingle_hashes, text_or_empty, word_hashes
from dumplake.session import stage

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 16
CHUNK_ITEMS = 5000
_BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
_FILTER_BITS = 22


def _votes(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 of every shingle for each of the 64 bits."""
    bits = np.unpackbits(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return 2 * bits.astype(np.int8) - 1


def _pack(votes: np.ndarray) -> np.ndarray:
    return np.packbits(votes > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity: a shingle weighs as often as it occurs."""
    keys, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = np.bincount(at[: len(a)], minlength=len(keys)), np.bincount(at[len(a) :], minlength=len(keys))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class Index:
    """Benchmark items: shingles, fingerprints, and the multi-index over bit blocks."""

    def __init__(self, ids: list[int], texts: list[str]):
        words = [word_hashes(t) for t in texts]
        keep = [i for i, w in enumerate(words) if len(w)]
        self.ids = np.array([ids[i] for i in keep], np.int64)
        self.lengths = np.array([len(words[i]) for i in keep], np.int64)
        self.shingles = [shingle_hashes(words[i], SHINGLE) for i in keep]
        self.prints = np.array([_pack(_votes(s).sum(axis=0, dtype=np.int64, keepdims=True))[0] for s in self.shingles], np.uint64)
        # Every (length, shingle): which windows to fingerprint.
        self.by_size = {int(n): np.unique(np.concatenate([s for s, m in zip(self.shingles, self.lengths) if m == n])) for n in np.unique(self.lengths)}
        self.filter = {k: self._filter([v for n, v in self.by_size.items() if min(SHINGLE, n) == k]) for k in {min(SHINGLE, n) for n in self.by_size}}
        self.lists = []
        for start, width in _BLOCKS:
            near = np.bitwise_count(np.arange(1 << width, dtype=np.uint16)[:, None] ^ self._block(self.prints, start, width)[None, :]) <= RADIUS // len(_BLOCKS)
            value, item = np.nonzero(near)
            self.lists.append((np.searchsorted(value, np.arange((1 << width) + 1)), item))

    @staticmethod
    def _block(prints: np.ndarray, start: int, width: int) -> np.ndarray:
        return ((prints >> np.uint64(start)) & np.uint64((1 << width) - 1)).astype(np.uint16)

    @staticmethod
    def _filter(parts: list[np.ndarray]) -> np.ndarray:
        table = np.zeros(1 << _FILTER_BITS, bool)
        for p in parts:
            table[p >> np.uint64(64 - _FILTER_BITS)] = True
        return table

    def near(self, prints: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, item) within the radius, for items of the windows' length."""
        pairs = []
        for (start, width), (starts, listed) in zip(_BLOCKS, self.lists):
            value = self._block(prints, start, width)
            count = starts[value.astype(np.int64) + 1] - starts[value]
            row = np.repeat(np.arange(len(prints)), count)
            item = listed[np.repeat(starts[value], count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)]
            ok = items[item] & (np.bitwise_count(prints[row] ^ self.prints[item]) <= RADIUS)
            pairs.append(row[ok] * len(self.ids) + item[ok])
        found = np.unique(np.concatenate(pairs))
        return found // len(self.ids), found % len(self.ids)

    def match(self, text: str, least: float) -> list[tuple[int, float, int]]:
        """Best window of the text for every item that reaches ``least``: id, similarity, first word."""
        words = word_hashes(text)
        made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        best: dict[int, tuple[float, int]] = {}
        for k, table in self.filter.items():
            if len(words) >= k:
                s = shingle_hashes(words, k)
                if (at := np.flatnonzero(table[s >> np.uint64(64 - _FILTER_BITS)])).size:
                    made[k] = s, at
        for n, own in self.by_size.items():
            k = min(SHINGLE, n)
            # A text shorter than the item is one window of all its words.
            if k not in made:
                continue
            s, hits = made[k]
            place = np.searchsorted(own, s[hits])
            hits = hits[own[np.minimum(place, len(own) - 1)] == s[hits]]
            if not len(hits):
                continue
            span = min(n, len(words)) - k + 1  # shingles of a window
            mark = np.zeros(len(s) + 1, np.int32)
            np.add.at(mark, np.maximum(hits - span + 1, 0), 1)
            np.add.at(mark, np.minimum(hits + 1, len(s)), -1)
            starts = np.flatnonzero(np.cumsum(mark)[: len(s) - span + 1] > 0)
            # Neighbouring windows share their running sums; at most 4096 of them at a time.
            for group in np.split(starts, np.flatnonzero((np.diff(starts) > 1) | (np.arange(1, len(starts)) % 4096 == 0)) + 1):
                lo, hi = group[0], group[-1] + span
                total = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(_votes(s[lo:hi]), axis=0, dtype=np.int32)))
                window, item = self.near(_pack(total[span:] - total[:-span]), self.lengths == n)
                for w, i in zip(window, item):
                    sim = similarity(s[lo + w : lo + w + span], self.shingles[i])
                    if sim >= least and (i not in best or (-sim, lo + w) < (-best[i][0], best[i][1])):
                        best[i] = (sim, int(lo + w))
        return [(int(self.ids[i]), *best[i]) for i in sorted(best)]


def _look_up(index, least: float):
    def run(batches):
        table = Index(*index.value)
        for pdf in batches:
            rows = zip(pdf["_k1"], pdf["_k2"], pdf["text"])
            got = [(a, b, *m) for a, b, t in rows for m in (table.match(t, least) if len(table.ids) else ())]
            yield pd.DataFrame(got, columns=["_k1", "_k2", "item_id", "similarity", "first_word"])

    return run


def matches(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``_k1, _k2, item_id, similarity, first_word``: every document with every item that a window of it reaches."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    chunks = max(1, -(-items.count() // CHUNK_ITEMS))
    texts = keyed(docs).select("_k1", "_k2", text_or_empty().alias("text"))
    parts = []
    for c in range(chunks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == c).collect()
        index = docs.sparkSession.sparkContext.broadcast(([r.item_id for r in rows], [r.text for r in rows]))
        parts.append(texts.mapInPandas(_look_up(index, least), "_k1 long, _k2 long, item_id long, similarity double, first_word long"))
    return reduce(DataFrame.union, parts)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``doc_id, item_id, similarity, first_word`` of the best window, for every pair that reaches ``least``."""
    found = matches(docs, benchmark, least)
    return found.select(F.when(F.col("_k1") != -(2**63), F.col("_k1")).alias("doc_id"), "item_id", "similarity", "first_word")


def clean(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``docs`` without those that hold an item of the benchmark. Texts are shuffled only if the list of leaks is long."""
    found = stage(matches(docs, benchmark, least).select("_k1", "_k2").distinct(), "leaks")
    return keyed(docs).join(found, ["_k1", "_k2"], "left_anti").select(*[f"`{c}`" for c in docs.columns])
