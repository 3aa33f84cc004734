"""Documents packed into sequences of bounded length by patterns fitted with non-negative least squares.

The histogram of lengths, at most as long as a sequence, is all the plan needs. Patterns are the ways to fill a sequence
exactly with a few documents; an active-set method fits how often each is used so that the patterns together come near the
histogram. Counts are rounded within what is there, and the rest is packed best fit, longest first, as counts of equal
sequences, so the plan does not grow with the number of documents. Each document then finds its place from its rank among
those of its length, and ranks are taken in slices, so no length is one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dumplake.llm.wordends import word_ends
from dumplake.session import broadcast_within, stage

#: Ids in a sequence.
CAPACITY = 2048
#: Documents in a fitted pattern, at most.
FEW = 3
#: Pieces of one length that are ranked together.
SLICE_ROWS = 200_000
#: Long documents weigh more in the fit by these powers of their length, and these shares of the fitted counts are tried: patterns that
#: use up the short documents can leave long ones without a partner. The plan with the fewest sequences is taken.
WEIGHTS = (0.5, 2.0)
SHARES = (1.0, 0.9, 0.7, 0.4, 0.2)

# The fit ends when the steepest descent is this share of the first one, after so many rounds, or so many without gain. Each round solves at
# most so many times, with so many steps of conjugate gradients. What the fit leaves over is packed best fit, so ending early loses nothing.
_TOLERANCE = 1e-3
_ROUNDS = 60
_PASSES = 4
_STEPS = 80
_STALE = 6


# --- patterns -----------------------------------------------------------------------------------

def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All ways to fill ``capacity`` exactly with two or three of the lengths (falling, 0 for none), one per row."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    lengths = np.sort(lengths[lengths < capacity])[::-1]
    out = []
    for a in lengths:
        rest = capacity - a
        b = lengths[(lengths <= min(a, rest)) & (2 * lengths >= rest)]
        c = rest - b
        ok = (c == 0) | there[c]
        out.append(np.column_stack([np.full(ok.sum(), a), b[ok], c[ok]]))
    return np.concatenate(out).astype(np.int64) if out else np.empty((0, FEW), np.int64)


class _Fit:
    """min |W (A x - h)| over x >= 0, with one column of A per pattern; length weights make long documents count more."""

    def __init__(self, found: np.ndarray, histogram: np.ndarray, power: float):
        self.found, self.size = found, len(histogram)
        self.weight = (np.arange(self.size) / self.size) ** power
        self.weight[0] = 0.0
        self.target = self.weight * histogram

    def times(self, which: np.ndarray, x: np.ndarray) -> np.ndarray:
        rows = self.found[which]
        return self.weight * np.bincount(rows.ravel(), np.repeat(x, rows.shape[1]), self.size)

    def gradient(self, rest: np.ndarray, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        return (self.weight * rest)[self.found[which]].sum(axis=1)

    def least_squares(self, which: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Unconstrained over the patterns ``which``, by conjugate gradients from ``x``."""
        x = x.copy()
        rest = self.target - self.times(which, x)
        g = self.gradient(rest, which)
        p, gg = g.copy(), g @ g
        stop = 1e-18 * max(gg, self.target @ self.target)
        for _ in range(_STEPS):
            if gg <= stop:
                break
            ap = self.times(which, p)
            step = gg / (ap @ ap)
            x += step * p
            rest -= step * ap
            g = self.gradient(rest, which)
            gg, old = g @ g, gg
            p = g + (gg / old) * p
        return x


def fit_counts(found: np.ndarray, histogram: np.ndarray, power: float = WEIGHTS[0]) -> np.ndarray:
    """How often to use each pattern, as real numbers of at least zero.

    An active-set method with blocks: the patterns with the steepest descent that share no length enter together, and the
    active ones are solved by conjugate gradients. The best solution met is returned.
    """
    x = np.zeros(len(found))
    if not len(found):
        return x
    fit = _Fit(found, histogram, power)
    norm = np.sqrt((fit.weight[found] ** 2).sum(axis=1))
    active = np.empty(0, np.int64)
    first, stale = None, 0
    best = (fit.target @ fit.target, x.copy())
    rest = fit.target
    for _ in range(_ROUNDS):
        g = fit.gradient(rest) / norm
        g[active] = 0.0
        first = first or g.max()
        steep = np.flatnonzero(g > _TOLERANCE * first)
        if not len(steep):
            break
        steep = steep[np.argsort(-g[steep], kind="stable")][: 8 * len(histogram)]
        used, entering = set(), []
        for i, row in zip(steep.tolist(), found[steep].tolist()):
            here = {v for v in row if v}
            if used.isdisjoint(here):
                used |= here
                entering.append(i)
        active = np.concatenate([active, entering])
        # Solved without bounds, those below zero leave together and the others are solved again.
        for _ in range(_PASSES):
            new = fit.least_squares(active, x[active])
            x[active] = np.maximum(new, 0.0)
            if new.min(initial=0.0) >= 0:
                break
            active = active[new > 0]
        rest = fit.target - fit.times(active, x[active])
        if rest @ rest < best[0]:
            best, stale = (rest @ rest, x.copy()), 0
        elif (stale := stale + 1) == _STALE:
            break
    return best[1]


# --- the plan -----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Slot:
    """``times`` documents of ``length`` from ``offset`` on, in each of ``bins`` sequences from ``first`` on."""

    length: int
    start: int
    times: int
    bins: int
    first: int
    offset: int


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit, longest first, on counts: groups of equal sequences as ((length, times) ..., how many)."""
    room: dict[int, list[tuple[tuple, int]]] = {capacity: [((), -1)]}
    open_rooms = np.zeros(capacity + 1, np.int64)
    open_rooms[capacity] = 1
    for length in np.flatnonzero(histogram)[::-1].tolist():
        left = int(histogram[length])
        while left:
            space = length + int(np.argmax(open_rooms[length:] > 0))
            content, bins = room[space][-1]
            times = min(space // length, left)
            full = left // times if bins < 0 else min(bins, left // times)
            if bins >= 0:
                room[space].pop()
                open_rooms[space] -= 1
                if bins > full:
                    room[space].append((content, bins - full))
                    open_rooms[space] += 1
            rest = space - times * length
            room.setdefault(rest, []).append(((content, (length, times)), full))
            open_rooms[rest] += 1
            left -= times * full
    out = []
    for groups in room.values():
        for content, bins in groups:
            items = []
            while content:
                content, item = content
                items.append(item)
            if items:
                out.append((items[::-1], bins))
    return out


def _rounded(found: np.ndarray, counts: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """The patterns as often as the rounded counts say and the histogram allows, and the rest by best fit."""
    left, counts, groups = left.copy(), np.rint(counts).astype(np.int64), []
    for i in np.argsort(-counts, kind="stable"):
        if counts[i] == 0:
            break
        lengths, times = np.unique(found[i][found[i] > 0], return_counts=True)
        bins = int(min(counts[i], (left[lengths] // times).min()))
        if bins:
            left[lengths] -= bins * times
            groups.append((list(zip(lengths.tolist()[::-1], times.tolist()[::-1])), bins))
    return groups + best_fit(left, capacity)


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[Slot]:
    """Slots for all documents of a histogram (index: length, up to ``capacity``)."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    groups: list[tuple[list[tuple[int, int]], int]] = []
    if left[capacity]:
        groups.append(([(capacity, 1)], int(left[capacity])))
        left[capacity] = 0
    found = patterns(np.flatnonzero(left), capacity)
    least, best = -(-int((left * np.arange(capacity + 1)).sum()) // capacity), None
    for power in WEIGHTS:
        counts = fit_counts(found, left.astype(np.float64), power)
        for share in SHARES:
            tried = _rounded(found, share * counts, left, capacity)
            if best is None or sum(b for _, b in tried) < sum(b for _, b in best):
                best = tried
        if sum(b for _, b in best) == least:
            break
    groups += best
    slots, first, taken = [], 0, np.zeros(capacity + 1, np.int64)
    for items, bins in groups:
        offset = 0
        for length, times in items:
            slots.append(Slot(length, int(taken[length]), times, bins, first, offset))
            taken[length] += times * bins
            offset += times * length
        first += bins
    return slots


# --- pieces and places --------------------------------------------------------------------------

_PIECES = "piece int, start long, length long, ids_crc32 long, ids binary"


def pieces(docs: DataFrame, encoder: Callable[[], Callable[[list[str]], list[bytes]]], capacity: int = CAPACITY, end_id: int = 0,
           keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if wanted, ids of all pieces of all documents.

    ``encoder`` gives, inside a task, the function from texts to ids as bytes (unsigned 32-bit, little-endian).
    """
    end = np.array([end_id], "<u4").tobytes()
    width = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in batches:
            at, piece, raw = [], [], []
            for i, ids in enumerate(encode(batch.column(1).to_pylist())):
                ids += end
                for k in range(0, len(ids), width):
                    at.append(i)
                    piece.append(k // width)
                    raw.append(ids[k : k + width])
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array([capacity * k for k in piece], pa.int64()),
                pa.array([len(r) // 4 for r in raw], pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                pa.array(raw if keep_ids else [None] * len(raw), pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    out = rows.mapInArrow(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_PIECES}")
    return out if keep_ids else out.drop("ids")


def place(found: DataFrame, capacity: int = CAPACITY, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``found`` (staged pieces with doc_id, piece, ids_crc32 and a length of 1 to ``capacity``) with sequence_id and offset.

    Only the histogram comes to the driver and only the plan, whose size the capacity bounds, is sent out.
    """
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    histogram = np.zeros(capacity + 1, np.int64)
    histogram[list(counts)] = list(counts.values())
    spark = found.sparkSession
    slots = spark.createDataFrame(
        [(s.length, s.start, s.start + s.times * s.bins, s.times, s.first, s.offset) for s in plan(histogram, capacity)],
        "length long, lo long, hi long, times long, first long, at long")
    many = [F.lit(v) for k, n in counts.items() if n > slice_rows for v in (k, -(-n // slice_rows))]
    slices = F.coalesce(F.try_element_at(F.create_map(*many), F.col("length")), F.lit(1)) if many else F.lit(1)
    sliced = found.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), slices).cast("int"))
    per = sliced.groupBy("length", "_slice").agg(F.count("*").alias("n"))
    along = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before, _ = broadcast_within(stage(per.select("length", "_slice", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("_before")), "slices"))
    rank = F.row_number().over(Window.partitionBy("length", "_slice").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = sliced.withColumn("_rank", rank).join(before, ["length", "_slice"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    slots = F.broadcast(slots.withColumnRenamed("length", "_length"))
    placed = ranked.join(slots, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi")))
    nth = F.col("_rank") - F.col("lo")
    return placed.select(
        *found.columns, (F.col("first") + F.floor(nth / F.col("times"))).alias("sequence_id"),
        (F.col("at") + (nth % F.col("times")) * F.col("length")).alias("offset"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    ``tokenizer`` is the path of a tokenizers file with word ends. Null texts are empty and, like empty ones, one piece with the end id
    alone. Documents over ``capacity`` ids are cut; nothing else is. Null ids, repeated ids and repeated rows are documents of their own.
    Texts of any length are encoded whole. An empty table gives no rows; other columns are ignored. Which of several pieces of one
    length takes which place follows slices of hashes and then ids, and is without effect on the number of sequences.
    """
    found = stage(pieces(docs, lambda: word_ends(tokenizer).ids, capacity, end_id, keep_ids), "pieces-to-pack")
    return place(found, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids of every sequence of ``pack(..., keep_ids=True)``; one gathers at most the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda s, p: F.concat(s, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
