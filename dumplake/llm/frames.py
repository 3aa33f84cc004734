"""What the corpus operators share: row keys, clashing columns, bounded Arrow batches, words as numbers, components."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dumplake.session import broadcast_within, ship_package, stage

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 500


def ready(spark: SparkSession) -> None:
    """Ship the package to the workers and keep Arrow batches of whole texts small."""
    ship_package(spark)
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an output of the same name replaces, whatever their case."""
    lower = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in lower])


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add ``_k1, _k2``: the id (null: the smallest long) and a hash of the text.

    Repeated rows share a key and so get the same result; the order of keys is the order of ids.
    """
    return df.withColumns({
        "_k1": F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))),
        "_k2": F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))),
    })


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


# --- words as numbers -------------------------------------------------------------------------

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_P), -1, 2**64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_word: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of an odd number and of its inverse, modulo two to the 64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        for i, base in enumerate((_P, _INV)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def _is_word() -> np.ndarray:
    """By code point: letters, digits and underscore."""
    if not _word:
        _word.append(np.fromiter((chr(c).isalnum() or c == 95 for c in range(0x110000)), bool, 0x110000))
    return _word[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the splitmix finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_CHUNK = 1 << 20
_GAP = re.compile(r"\W")


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit number for each word (letters, digits, underscores) of the lower-cased text.

    A very long text is read in chunks that end between words, so memory is bounded by the chunk.
    """
    parts, at = [], 0
    while len(text) - at > _CHUNK and (gap := _GAP.search(text, at + _CHUNK)):
        parts.append(_hashes(text[at : gap.start()]))
        at = gap.start()
    parts.append(_hashes(text[at:] if at else text))
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


def _hashes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.empty(0, np.uint64)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = _is_word()[codes]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, np.uint64)
    up, down = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """A number for every run of ``size`` words; fewer words: one for the whole sequence; none: none."""
    n = len(words)
    if not n:
        return words
    k = min(size, n)
    out = words[: n - k + 1].copy()
    for j in range(1, k):
        out = out * _P + words[j : n - k + 1 + j]
    return mix(out)


# --- hot keys ---------------------------------------------------------------------------------

#: Rows of one key that one task of ``join_hot`` reads.
ROWS_A_TASK = 20_000


def join_hot(left: DataFrame, right: DataFrame, key: str, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """Inner join of ``left`` with ``right``, a written table of one row per ``key`` whose ``n`` counts the rows of ``left``.

    Keys with more than ``rows_a_task`` rows are dealt to several tasks, their row of ``right`` repeated for each.
    """
    splits = F.ceil(F.col("n") / rows_a_task).cast("int")
    hot, _ = broadcast_within(right.where(F.col("n") > rows_a_task).select(key, splits.alias("_splits")))
    left = left.join(hot, key, "left").withColumn(
        "_split", F.pmod(F.xxhash64(*[c for c in left.columns if c != key]), F.coalesce("_splits", F.lit(1))).cast("int")).drop("_splits")
    right = right.withColumn("_split", F.explode(F.sequence(F.lit(0), splits - 1))).drop("n")
    return left.join(right, [key, "_split"]).drop("_split")


# --- components -------------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """``a, b`` links of longs to ``node, component`` (the smallest node that links reach), for linked nodes.

    Alternates large-star and small-star steps: each is one join of links with the minimum per node
    and one distinct, so a node with very many links is a skewed join side and never one gathered row.
    Every step is a table in the shared folder. Ends when every node hangs on one root.
    """
    links = stage(
        edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        ends = links.selectExpr("u AS n", "1 AS up", "0 AS down").union(links.selectExpr("v", "0", "1"))
        ends = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.where("up > 1 OR up = 1 AND down = 1").isEmpty():
            return links.toDF("node", "component").union(links.select("v", "v").distinct())
        both = links.union(links.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.distinct(), "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select("v", "m").union(low.select("u", "m")).toDF("u", "v")
        links = stage(small.distinct(), "links")
