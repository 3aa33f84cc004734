"""Embedding near-dedup by NN-descent: a neighbour graph refined through neighbours of neighbours.

Equal vectors of one label are one node with a weight. Random hyperplanes deal the nodes into small leaves, several times;
within a leaf every node finds its first neighbours. Then, round by round, the neighbours of a node (and those that have it
as theirs) are compared with each other if one of them is new, and every list keeps its best ``NEIGHBOURS``, until a round
finds no new link. Every comparison also hands on a spanning forest of the links it saw, so lists
that are full cannot hide a connection. A full list of links alone is saturated: it is enlarged to twice its places and the descent goes on
around it, its further places taking links alone, until no list is saturated or has ``WIDEST`` places. Only components with a list that is saturated even then are compared within
themselves, in blocks, and counted there. A bounded sample of nodes is compared with all rows; below ``RECALL`` the search goes on with more leaves,
and if it ends below that it warns, or below ``RECALL_LEAST`` fails, with the measured recall.

Similarities are cosines in double precision wherever they are computed. Nothing is compared between labels, no list
or group is gathered beyond a block, and oversized leaves are dealt again at random.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component, and rows with a null label, link with nothing and
are kept; components of any finite size count, also where their squares are too large or small for a double; vectors of different lengths do not link; rows that repeat an id count as rows; a null id counts as larger than all.
"""

from __future__ import annotations

import hashlib
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dumplake.llm.frames import components
from dumplake.session import stage

THRESHOLD = 0.93
NEIGHBOURS = 10
WIDEST = 40
TABLES = 8
LEAF, LEAF_MOST, BLOCK = 64, 512, 1024
ROUNDS = 12
RECALL, RECALL_LEAST, AUDITED, ATTEMPTS = 0.98, 0.9, 256, 3
_LAST = 2**63 - 1


def _vector(x) -> np.ndarray | None:
    """A valid vector as doubles; one whose squares might not be doubles is scaled by a power of two, which changes no cosine."""
    v = np.array([np.nan if c is None else c for c in x], np.float64) + 0.0
    most = np.abs(v).max() if len(v) else 0.0
    if not 0 < most < np.inf:
        return None
    return v if 1e-100 < most < 1e100 else np.ldexp(v, -int(np.frexp(most)[1]))


def _read(batches):
    """Valid vectors as bytes of doubles, with their length and a digest to find equal ones."""
    for pdf in batches:
        vec, digest, dim = [], [], []
        for x, label in zip(pdf["embedding"], pdf["label"]):
            v = None if x is None or pd.isna(label) else _vector(x)
            vec.append(None if v is None else v.tobytes())
            digest.append(None if v is None else hashlib.blake2b(vec[-1], digest_size=16).digest())
            dim.append(0 if v is None else len(v))
        yield pd.DataFrame({"vec_id": pdf["vec_id"], "label": pdf["label"], "dim": dim, "digest": digest, "vec": vec})


def _units(vecs) -> np.ndarray:
    x = np.frombuffer(b"".join(vecs), np.float64).reshape(len(vecs), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _groups(batches, key: str):
    """Frames of equal keys from partitions sorted by the key."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        k = pdf[key].to_numpy()
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        for a, b in zip([0, *cuts[:-1]], cuts):
            yield pdf.iloc[a:b]
        rest = pdf.iloc[cuts[-1] if len(cuts) else 0 :].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def _forest(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every linked node with the first of its tree, from a symmetric matrix of links."""
    up = np.arange(len(links))
    for a in np.flatnonzero(links.any(axis=1)):
        met = np.append(np.flatnonzero(links[a]), a)
        root = up[met]
        while (up[root] != root).any():
            root = up[root]
        up[root] = up[met] = root.min()
    while (up[up] != up).any():
        up = up[up]
    at = np.flatnonzero(up != np.arange(len(up)))
    return at, up[at]


def _buffered(frames, rows: int = 20_000):
    held, n = [], 0
    for f in frames:
        held.append(f)
        n += len(f)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


_EDGE = "u long, v long, sim double, bridge boolean"


def _edges(ids: np.ndarray, at: np.ndarray, to: np.ndarray, sim: np.ndarray, links: np.ndarray) -> pd.DataFrame:
    a, b = _forest(links)
    return pd.DataFrame({
        "u": np.concatenate((ids[at], ids[a])), "v": np.concatenate((ids[to], ids[b])),
        "sim": np.concatenate((sim, np.ones(len(a)))), "bridge": np.repeat([False, True], [len(at), len(a)])})


def _in_leaf(k: int, threshold: float):
    def run(batches):
        def each():
            for pdf in _groups(batches, "leaf"):
                for start in range(0, len(pdf), LEAF_MOST):
                    part = pdf.iloc[start : start + LEAF_MOST]
                    if len(part) < 2:
                        continue
                    x, ids = _units(part["vec"]), part["id"].to_numpy()
                    sim = x @ x.T
                    np.fill_diagonal(sim, -2)
                    n = min(k, len(part) - 1)
                    to = np.argpartition(-sim, n - 1, axis=1)[:, :n].ravel()
                    at = np.repeat(np.arange(len(part)), n)
                    yield _edges(ids, at, to, sim[at, to], sim >= threshold)

        yield from _buffered(each())

    return run


def _local_join(threshold: float):
    """Pairs of the neighbours of one node, one of them new, that are better than the end of a list."""

    def run(batches):
        def each():
            for pdf in _groups(batches, "p"):
                new = pdf["new"].to_numpy(bool)
                if len(pdf) < 2 or not new.any():
                    continue
                x, ids, low = _units(pdf["vec"]), pdf["m"].to_numpy(), pdf["low"].to_numpy()
                sim = np.where(new[:, None] | new[None, :], x @ x.T, -2)
                np.fill_diagonal(sim, -2)
                at, to = np.nonzero(sim > low[:, None])
                yield _edges(ids, at, to, sim[at, to], sim >= threshold)

        yield from _buffered(each())

    return run


def _leaves(nodes: DataFrame, first: int, tables: int) -> DataFrame:
    """``leaf, id, vec``: each node once for every table."""

    def deal(batches):
        planes: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            for (part, dim, bits), some in pdf.groupby(["part", "dim", "bits"]):
                x = _units(some["vec"])
                for t in range(first, first + tables):
                    if (t, dim) not in planes:
                        planes[t, dim] = np.random.default_rng((t, int(dim))).standard_normal((48, int(dim)))
                    side = (x @ planes[t, dim][: int(bits)].T > 0).astype(np.uint64)
                    code = (side << np.arange(int(bits), dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
                    yield pd.DataFrame({"part": part, "t": t, "code": code.astype(np.int64), "id": some["id"].to_numpy(), "vec": some["vec"].to_numpy()})

    rows = nodes.select("id", "part", "dim", "bits", "vec").mapInPandas(deal, "part long, t int, code long, id long, vec binary")
    rows = rows.withColumn("leaf", F.xxhash64("part", "t", "code"))
    large = rows.groupBy("leaf").count().where(F.col("count") > LEAF_MOST)
    salt = F.pmod(F.xxhash64("id", "t"), F.coalesce(F.ceil(F.col("count") / LEAF_MOST), F.lit(1)))
    return rows.join(large, "leaf", "left").select(F.xxhash64("leaf", salt).alias("leaf"), "id", "vec")


def _best(rows: DataFrame, key: str, other: str, k: int, times: int, wide: DataFrame | None) -> DataFrame:
    """The best ``times`` * ``k`` rows of each key, more of those in ``wide``; Spark limits the groups before it shuffles them."""
    most = times * (k if wide is None else WIDEST)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("sim"), other))
    rows = rows.withColumn("_rank", rank).where(F.col("_rank") <= most)
    if wide is not None:
        rows = rows.join(wide.withColumnRenamed("id", key), key, "left").where(F.col("_rank") <= times * F.coalesce("places", F.lit(k))).drop("places")
    return rows.drop("_rank")


def _top(edges: DataFrame, k: int, wide: DataFrame | None) -> DataFrame:
    """The best of each list, as many as it has places. Equal pairs are one."""
    best = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    return _best(best, "u", "v", k, 1, wide)


def _places(lists: DataFrame, k: int, wide: DataFrame | None) -> DataFrame:
    """``id, low, n, places`` of every list: its last similarity, its entries and its places."""
    ends = lists.groupBy(F.col("u").alias("id")).agg(F.min("sim").alias("low"), F.count("*").alias("n"))
    if wide is None:
        return ends.withColumn("places", F.lit(k))
    return ends.join(wide, "id", "left").fillna(k, ["places"])


def _enlarged(lists: DataFrame, k: int, wide: DataFrame | None, threshold: float) -> DataFrame:
    """``id, places`` of all lists that have more than ``k`` places, the saturated ones with twice as many as before."""
    ends = _places(lists, k, wide)
    full = (F.col("n") >= F.col("places")) & (F.col("low") >= threshold)
    return ends.select("id", F.when(full, F.least(F.lit(WIDEST), F.col("places") * 2)).otherwise(F.col("places")).cast("int").alias("places"),
                       (full & (F.col("places") < WIDEST)).alias("grown")).where(F.col("places") > k)


def _round(nodes: DataFrame, lists: DataFrame, k: int, threshold: float, wide: DataFrame | None) -> DataFrame:
    """Edges that the neighbours of all nodes with something new in their lists find among themselves."""
    low = _places(lists, k, wide).select(F.col("id").alias("m"), F.when(F.col("n") >= F.col("places"), F.col("low"))
                                           .when(F.col("places") > k, F.lit(float(np.nextafter(threshold, -2)))).otherwise(-1.5).alias("low"))
    both = lists.selectExpr("u AS p", "v AS m", "sim", "new").union(lists.selectExpr("v", "u", "sim", "new"))
    both = both.groupBy("p", "m").agg(F.max("sim").alias("sim"), F.max("new").alias("new"))
    members = _best(both, "p", "m", k, 2, wide).select("p", "m", "new")
    members = members.join(members.where("new").select("p").distinct(), "p", "left_semi")
    rows = members.join(nodes.select(F.col("id").alias("m"), "vec"), "m").join(low, "m", "left").fillna(-1.5, ["low"])
    return rows.repartition("p").sortWithinPartitions("p").mapInPandas(_local_join(threshold), _EDGE)


def _count_blocks(members: DataFrame, threshold: float) -> DataFrame:
    """``id, links``: weights linked to each node within its component, block by block."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("b"))
    rows = members.join(sizes, "component").withColumn("i", F.pmod(F.xxhash64("id"), F.col("b")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("b") - 1))
    mine = rows.withColumn("j", every).select("component", "i", "j", "id", "w", "vec", F.lit(True).alias("mine"))
    other = rows.withColumn("j", every).select("component", F.col("j").alias("i"), F.col("i").alias("j"), "id", "w", "vec", F.lit(False).alias("mine"))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["mine"]], pdf[~pdf["mine"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "links": []})
        near = _units(a["vec"]) @ _units(b["vec"]).T >= threshold
        near &= a["id"].to_numpy()[:, None] != b["id"].to_numpy()[None, :]
        return pd.DataFrame({"id": a["id"].to_numpy(), "links": near @ b["w"].to_numpy(np.int64)})

    return mine.union(other).groupBy("component", "i", "j").applyInPandas(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def _resolve(nodes: DataFrame, lists: DataFrame, bridges: DataFrame, k: int, threshold: float, wide: DataFrame | None) -> DataFrame:
    """``id, component, links`` of all linked nodes."""
    near = lists.where(F.col("sim") >= threshold)
    pairs = stage(near.select("u", "v").union(near.select("v", "u")).union(bridges).union(bridges.select("v", "u")).distinct(), "nn-links")
    found = stage(components(pairs.toDF("a", "b")), "nn-components")
    # A list of links alone is saturated, and so is a node with more links than its list has places.
    many = pairs.groupBy(F.col("u").alias("id")).count().where(F.col("count") >= k)
    many = many.withColumn("places", F.lit(k)) if wide is None else many.join(wide, "id", "left").fillna(k, ["places"])
    full = many.where(F.col("count") >= F.col("places")).select(F.col("id").alias("node"))
    large = stage(found.join(full, "node", "left_semi").select("component").distinct(), "nn-large")
    inside = found.join(large, "component", "left_semi").select(F.col("node").alias("id"), "component")
    blocks = _count_blocks(inside.join(nodes.select("id", "w", "vec"), "id"), threshold)
    # Bridges are real links; in components without a saturated list all links stand in the lists.
    small = found.join(large, "component", "left_anti").select(F.col("node").alias("u"), "component")
    listed = pairs.join(small, "u").join(nodes.select(F.col("id").alias("v"), "w"), "v").groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("links"))
    return stage(found.select(F.col("node").alias("id"), "component").join(blocks.union(listed), "id"), "nn-found")


def _audit(nodes: DataFrame, found: DataFrame, threshold: float) -> float:
    """Share of the links of a bounded sample of nodes that were counted; the sample is compared with all rows."""
    sample = nodes.orderBy(F.xxhash64("id"), "id").limit(AUDITED).select("id", "part", "dim", "vec").collect()
    sent = nodes.sparkSession.sparkContext.broadcast([(r.id, r.part, r.dim, bytes(r.vec)) for r in sample])

    def brute(batches):
        parts: dict[tuple[int, int], list] = {}
        for i, part, dim, vec in sent.value:
            parts.setdefault((part, dim), []).append((i, vec))
        known = {key: (np.array([i for i, _ in some]), _units([v for _, v in some])) for key, some in parts.items()}
        for pdf in batches:
            for key, some in pdf.groupby(["part", "dim"]):
                if key in known:
                    ids, x = known[key]
                    near = (x @ _units(some["vec"]).T >= threshold) & (ids[:, None] != some["id"].to_numpy()[None, :])
                    yield pd.DataFrame({"id": ids, "true": near @ some["w"].to_numpy(np.int64)})

    true = nodes.select("id", "part", "dim", "w", "vec").mapInPandas(brute, "id long, true long").groupBy("id").agg(F.sum("true").alias("true"))
    sums = true.join(found, "id", "left").agg(F.sum("true").alias("true"), F.sum(F.least("true", F.coalesce("links", F.lit(0)))).alias("got")).first()
    return 1.0 if not sums.true else sums.got / sums.true


def link_vectors(rows: DataFrame, threshold: float = THRESHOLD, k: int = NEIGHBOURS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vec_id, embedding, label``."""
    return search_links(rows, threshold, k)[0]


def search_links(rows: DataFrame, threshold: float = THRESHOLD, k: int = NEIGHBOURS) -> tuple[DataFrame, float]:
    """The rows of ``link_vectors``, and the measured share of the links of a sample that were found."""
    read = stage(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label")).mapInPandas(
        _read, "vec_id long, label string, dim int, digest binary, vec binary").withColumn("part", F.xxhash64("label", "dim")), "nn-rows")
    valid = read.where("vec IS NOT NULL")
    one = valid.groupBy("part", "dim", "digest").agg(F.min(F.coalesce("vec_id", F.lit(_LAST))).alias("id"), F.count("*").alias("w"), F.first("vec").alias("vec"))
    per = valid.groupBy("part").agg(F.count("*").alias("n")).select("part", F.greatest(F.lit(0), F.least(F.lit(40), F.ceil(F.log2(F.col("n") / LEAF)))).cast("int").alias("bits"))
    nodes = stage(one.join(per, "part"), "nn-nodes")
    lists = bridges = wide = None
    recall = 1.0
    for attempt in range(ATTEMPTS):
        edges = stage(_leaves(nodes, attempt * TABLES, TABLES).repartition("leaf").sortWithinPartitions("leaf").mapInPandas(_in_leaf(k, threshold), _EDGE), "nn-edges")
        # A search of so many rounds for the lists as they are, and for each enlargement.
        left = ROUNDS
        while True:
            fresh = edges.where("NOT bridge").select("u", "v", "sim", F.lit(True).alias("new"))
            seen = edges.where("bridge").select("u", "v")
            bridges = seen if bridges is None else bridges.union(seen)
            old = fresh.limit(0) if lists is None else lists.withColumn("new", F.lit(False))
            lists = stage(_top(old.union(fresh), k, wide), "nn-lists")
            left -= 1
            if not left or lists.where(F.col("new") & (F.col("sim") >= threshold)).isEmpty():
                more = stage(_enlarged(lists, k, wide, threshold), "nn-places")
                if more.where("grown").isEmpty():
                    break
                # What stands in an enlarged list counts as new once more, so its members meet with room for what they find.
                wide, left = more.select("id", "places"), ROUNDS
                grown = more.where("grown").select(F.col("id").alias("u"), F.lit(True).alias("_grown"))
                lists = lists.join(grown, "u", "left").withColumn("new", F.coalesce("_grown", F.lit(False))).drop("_grown")
            edges = stage(_round(nodes, lists, k, threshold, wide), "nn-edges")
        found = _resolve(nodes, lists, bridges, k, threshold, wide)
        recall = _audit(nodes, found, threshold)
        if recall >= RECALL:
            break
    if recall < RECALL_LEAST:
        raise RuntimeError(f"of the links of a sample {recall:.3f} were found, {RECALL_LEAST} are needed: use more leaves or neighbours")
    if recall < RECALL:
        warnings.warn(f"of the links of a sample {recall:.3f} were found", stacklevel=2)
    of = one.select("part", "dim", "digest", "id", "w").join(found, "id", "left")
    joined = read.drop("vec", "label").join(of, ["part", "dim", "digest"], "left")
    component = F.coalesce("component", "id", "vec_id")
    component = F.when(component != _LAST, component)
    return joined.select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("w") - 1, F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")), recall
