"""SimHash near-dedup: vantage-point trees over fingerprints, boundary-overlapping shards, exact pairs.

Two 64-bit fingerprints within ``radius`` (at most 7) bits of each other are within ``radius // 4`` bits in one of their
four 16-bit quarters. Each quarter has a vantage-point tree over its values: a node splits values by their
Hamming distance to a vantage value, and by the triangle inequality a query only enters the branches that
its radius can reach, and of the leaves it gets to only those with a value that near. So the leaves are shards: each owns the fingerprints that fall into it and is visited by those that
may have a partner there, and every pair is compared on all 64 bits where its quarters meet. The trees
have at most 65,536 leaves, their depth follows the number of fingerprints, and a leaf with many is cut into blocks.
A shard hands on a spanning forest of its pairs instead of all pairs, which loses no connection.

Defined results: a null or empty text has no words and the fingerprint zero, which links like any other; equal
fingerprints link; repeated rows stay rows of ``cluster``, with equal results, and one of them stays in ``keep_one``; a null
id counts as smaller than all ids and is shown as null; an empty table gives no rows. ``keep_one`` keeps all columns.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dumplake.llm.frames import components, keyed
from dumplake.session import stage

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints a leaf should own, and the most that one block of a shard holds of each side.
LEAF, OWNED_BLOCK, VISITOR_BLOCK = 512, 4096, 65_536
_BITS = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    """SimHash of the 4-word shingles, as a signed long."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k, joined = min(SHINGLE, len(words)), b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_digest
    n = len(words) - k + 1
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        upto = min(n, at + (1 << 16))
        raw = b"".join([digest(joined[s : e - 1], SEED) for s, e in zip([ends[at - 1] if at else 0, *ends[at : upto - 1]], ends[at + k - 1 : upto + k - 1])])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(_BITS[2 * votes > n].sum(dtype=np.uint64).astype(np.int64))


def fingerprints(text: Column) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return of(text)


# --- the trees --------------------------------------------------------------------------------

def vantage_tree(sample: np.ndarray, leaves: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A vantage-point tree over all 16-bit values, cut to about ``leaves`` leaves by the values of ``sample``.

    Gives the leaf of each value, and in CSR form the leaves that a query around each value enters.
    """
    every = np.arange(1 << 16, dtype=np.uint16)
    own, routes, n = np.zeros(1 << 16, np.int32), [], 0
    weight = np.bincount(sample, minlength=1 << 16) + 1e-3  # empty values have a place, too
    limit = weight.sum() / max(1, leaves)
    todo = [(every, every)]  # values inside, values that may reach inside
    rng = np.random.default_rng(7)
    while todo:
        inside, near = todo.pop()
        total = weight[inside].sum()
        if total > limit and len(inside) > 1:
            vantage = inside[rng.integers(len(inside))]
            far = np.bitwise_count(inside ^ vantage)
            mass = np.cumsum(np.bincount(far, weights=weight[inside], minlength=17))
            cut = int(np.clip(np.searchsorted(mass, total / 2), far.min(), far.max() - 1))
            reach = np.bitwise_count(near ^ vantage).astype(np.int16)
            todo += [(inside[far <= cut], near[reach - radius <= cut]), (inside[far > cut], near[reach + radius > cut])]
            continue
        own[inside] = n
        # The bounds only tell which branches cannot be reached; a leaf is visited if a value in it is near enough.
        held = np.zeros(1 << 16, bool)
        held[inside] = True
        met = held[near]
        for flip in (1 << b for b in range(16 if radius else 0)):
            met |= held[near ^ np.uint16(flip)]
        routes.append(near[met])
        n += 1
    values = np.concatenate(routes)
    leaf = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in routes])
    order = np.argsort(values, kind="stable")
    starts = np.searchsorted(values[order], np.arange((1 << 16) + 1))
    return own, starts.astype(np.int32), leaf[order]


def _quarters(prints: np.ndarray) -> np.ndarray:
    return (prints.view(np.uint64)[None, :] >> (np.arange(4, dtype=np.uint64) * np.uint64(16))[:, None]).astype(np.uint16)


def _route(trees, blocks):
    """Rows ``shard, fp, mine`` for the shards that a fingerprint belongs to or visits."""

    def run(batches):
        for pdf in batches:
            prints = pdf["fp"].to_numpy(np.int64)
            for q, values in enumerate(_quarters(prints)):
                own, starts, leaves = trees[q]
                count = starts[values.astype(np.int64) + 1] - starts[values]
                row = np.repeat(np.arange(len(prints)), count)
                leaf = leaves[np.repeat(starts[values], count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)]
                mine = own[values][row] == leaf
                a, b = blocks[q][0][leaf], blocks[q][1][leaf]
                fp = prints[row]
                salt = (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                i, j = (salt % a.astype(np.uint64)).astype(np.int64), (salt % b.astype(np.uint64)).astype(np.int64)
                # Owned ones stand in their row of blocks, all ones in their column.
                for owned in (True, False):
                    pick = np.flatnonzero(mine) if owned else np.arange(len(row))
                    times = (b if owned else a)[pick]
                    at = np.repeat(pick, times)
                    other = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                    block = (i[at] * b[at] + other) if owned else (other * b[at] + j[at])
                    yield pd.DataFrame({"q": np.full(len(at), q, np.int8), "leaf": leaf[at], "block": block, "fp": fp[at], "mine": np.full(len(at), owned)})

    return run


def _forest(radius: int):
    """The pairs of a block within the radius, as one link of every node to the smallest of its tree."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = pdf["mine"].to_numpy(bool)
        fp = pdf["fp"].to_numpy(np.int64)
        owned, seen = np.unique(fp[mine]), np.unique(fp[~mine])
        nodes = np.union1d(owned, seen)
        to_node, up = np.searchsorted(nodes, seen), np.arange(len(nodes))
        for at in range(0, len(owned), 64):
            part = owned[at : at + 64].view(np.uint64)
            for start in range(0, len(seen), 1 << 14):
                near = np.bitwise_count(part[:, None] ^ seen[start : start + (1 << 14)].view(np.uint64)[None, :]) <= radius
                for a in np.flatnonzero(near.sum(axis=1)):
                    met = np.append(to_node[start + np.flatnonzero(near[a])], np.searchsorted(nodes, owned[at + a]))
                    if len(met) == 2 and met[0] == met[1]:
                        continue  # it only met itself
                    root = up[met]
                    while (up[root] != root).any():
                        root = up[root]
                    up[root] = up[met] = root.min()
        while (up[up] != up).any():
            up = up[up]
        linked = np.flatnonzero(up != np.arange(len(nodes)))
        return pd.DataFrame({"a": nodes[linked], "b": nodes[up[linked]]})

    return run


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp`` (distinct longs) to ``a, b``: links that connect exactly what pairs within ``radius`` bits connect."""
    if not 0 <= radius <= 7:
        raise ValueError("radius must be 0 to 7")
    n = prints.count()
    # A bounded sample decides only where the trees split; all values have a leaf.
    sample = np.array([r.fp for r in prints.orderBy(F.xxhash64("fp"), "fp").limit(4096).collect()], np.int64)
    inner = radius // 4
    trees = [vantage_tree(v.astype(np.int64), min(1 << 16, max(1, n // LEAF)), inner) for v in _quarters(sample)]
    shipped = prints.sparkSession.sparkContext.broadcast(trees)  # four tables over 65,536 values

    def sizes(batches):
        counts = [[np.zeros(len(t[0]), np.int64) for _ in range(2)] for t in shipped.value]
        for pdf in batches:
            for q, values in enumerate(_quarters(pdf["fp"].to_numpy(np.int64))):
                own, starts, leaves = shipped.value[q]
                counts[q][0] += np.bincount(own[values], minlength=len(own))
                per = np.bincount(values, minlength=1 << 16)
                counts[q][1] += np.bincount(leaves, weights=np.repeat(per, np.diff(starts)), minlength=len(own)).astype(np.int64)
        for q, (mine, seen) in enumerate(counts):
            at = np.flatnonzero(seen)
            yield pd.DataFrame({"q": np.full(len(at), q, np.int32), "leaf": at, "mine": mine[at], "seen": seen[at]})

    # One row for each leaf with more than a block: at most four times 65,536.
    large = prints.mapInPandas(sizes, "q int, leaf long, mine long, seen long").groupBy("q", "leaf").agg(
        F.sum("mine").alias("mine"), F.sum("seen").alias("seen")).where((F.col("mine") > OWNED_BLOCK) | (F.col("seen") > VISITOR_BLOCK)).collect()
    blocks = [(np.ones(1 << 16, np.int64), np.ones(1 << 16, np.int64)) for _ in range(4)]
    for r in large:
        blocks[r.q][0][r.leaf], blocks[r.q][1][r.leaf] = -(-r.mine // OWNED_BLOCK) or 1, -(-r.seen // VISITOR_BLOCK)
    cut = prints.sparkSession.sparkContext.broadcast(blocks)

    def route(batches):
        return _route(shipped.value, cut.value)(batches)

    rows = prints.mapInPandas(route, "q byte, leaf int, block long, fp long, mine boolean")
    return rows.groupBy("q", "leaf", "block").applyInPandas(_forest(radius), "a long, b long")


def _components(docs: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """``_k1, _k2, fp`` of every row, and ``fp, low``: the smallest key that links reach from a fingerprint."""
    prints = stage(keyed(docs).select("_k1", "_k2", fingerprints(F.col("text")).alias("fp")), "simhash")
    one = stage(prints.groupBy("fp").agg(F.min(F.struct("_k1", "_k2")).alias("rep")), "simhash-distinct")
    found = stage(components(links(one.select("fp"), radius)), "simhash-components")
    lowest = found.join(one, one.fp == found.node).groupBy("component").agg(F.min("rep").alias("low"))
    low = found.join(lowest, "component").select(F.col("node").alias("fp"), "low")
    return prints, one.join(low, "fp", "left").select("fp", F.coalesce("low", "rep").alias("low"))


def cluster(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id`` (the smallest id that links reach) for every row."""
    prints, low = _components(docs, radius)
    shown = lambda c: F.when(F.col(c) != -(2**63), F.col(c))
    return prints.join(low, "fp").select(
        shown("_k1").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), shown("low._k1").alias("component_id"))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component (and of equal ids the smallest text hash)."""
    prints, low = _components(docs, radius)
    kept = stage(prints.groupBy("_k1", "_k2").agg(F.count("*").alias("n"), F.first("fp").alias("fp")).join(low, "fp")
                 .where("low._k1 = _k1 AND low._k2 = _k2").select("_k1", "_k2", "n"), "simhash-kept")
    rows, key = keyed(docs), ["_k1", "_k2"]
    once = rows.join(kept.where("n = 1"), key, "left_semi").select(*[f"`{c}`" for c in docs.columns])
    # Rows that repeat as a whole: one of them. Their key is that of their text, so which one does not matter there.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = rows.join(kept.where("n > 1"), key, "left_semi").groupBy(*key).agg(F.first(whole).alias("_w")).select("_w.*")
    return once.union(again)
