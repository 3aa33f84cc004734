"""Whitening of embeddings: blockwise QR, bidiagonal form, dqds singular values, twisted factorisations.

Tasks reduce their centred rows to a triangle by QR, triangles are stacked and reduced again in rounds until one is left, so no
covariance is ever formed and the number of rows does not matter to the last step. That triangle, as wide as the vectors, is brought to
bidiagonal form by Householder reflections. Its squared singular values come from dqds, which keeps small ones accurate
relative to themselves; the directions from twisted factorisations of the bidiagonal's own product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dumplake.session import stage

#: Components given for each row.
COMPONENTS = 8
#: Rows stacked under a triangle at a time, and triangles that one task of a later round stacks.
BLOCK_ROWS = 4096
FAN_IN = 16
#: Scaled entries are floor(1024 c) + 100000.
SCALE = 1024
SHIFT = 100_000
#: A row with an entry beyond this after scaling counts as not finite: doubles there are no longer exact.
LARGEST = 2.0**52

_EPS = np.finfo(np.float64).eps


# --- vectors of Arrow batches -------------------------------------------------------------------

def scaled(column: pa.Array, dim: int | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the positions of usable rows and their scaled entries, as a matrix of longs."""
    column = column.cast(pa.list_(pa.float64()))
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(sizes[sizes > 0]) if dim is None else [dim]:
        at = np.flatnonzero(sizes == d)
        values = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        with np.errstate(invalid="ignore", over="ignore"):
            values = SCALE * values
            good = (np.abs(values) < LARGEST).all(axis=1)  # false for NaN, which nulls become
        if good.any():
            out[int(d)] = at[good], np.floor(values[good]).astype(np.int64) + SHIFT
    return out


@dataclass(frozen=True)
class Sums:
    """Rows and exact sums of each dimension over the fit list."""

    n: int
    totals: tuple[int, ...]

    @property
    def dim(self) -> int:
        return len(self.totals)

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole part q and rest r of the mean: totals = n * q + r with 0 <= r < n."""
        q, r = zip(*(divmod(t, self.n) for t in self.totals))
        return np.array(q, np.int64), np.array(r, np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, rounded once."""
        q, r = self.parts()
        return (x - q) - r / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - total) squared, exact; null where it is no long."""
        q, r = self.parts()
        y = x - q
        if ((np.abs(y).astype(np.float64) + 1) ** 2).sum(axis=1).max(initial=0) * float(self.n) ** 2 < 2.0**62:
            return ((self.n * y - r) ** 2).sum(axis=1).tolist()
        exact = ((self.n * y.astype(object) - r.astype(object)) ** 2).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in exact]


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list] = {}
    for batch in batches:
        for d, (_, x) in scaled(batch.column(0)).items():
            n, high, low = found.get(d, (0, 0, 0))
            found[d] = [n + len(x), high + (x >> 26).sum(axis=0), low + (x & ((1 << 26) - 1)).sum(axis=0)]
    if found:
        yield pa.RecordBatch.from_pydict({
            "dim": pa.array(list(found), pa.int32()), "n": pa.array([v[0] for v in found.values()], pa.int64()),
            "high": pa.array([v[1].tolist() for v in found.values()], pa.list_(pa.int64())),
            "low": pa.array([v[2].tolist() for v in found.values()], pa.list_(pa.int64()))})


def sums(vectors: DataFrame) -> Sums | None:
    """Count and sums of the usable rows of the most frequent length (of equally frequent ones the longest)."""
    parts = stage(vectors.mapInArrow(_sum_rows, "dim int, n long, high array<long>, low array<long>"), "vector-sums")
    most = parts.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if most is None:
        return None
    spread = parts.where(F.col("dim") == most["dim"]).select(F.posexplode(F.arrays_zip("high", "low")).alias("i", "v"))
    rows = spread.groupBy("i").agg(*[F.sum(F.col(f"v.{c}").cast("decimal(38,0)")).alias(c) for c in ("high", "low")]).orderBy("i").collect()
    return Sums(most["n"], tuple((int(r["high"]) << 26) + int(r["low"]) for r in rows))


# --- blockwise QR -------------------------------------------------------------------------------

_TRIANGLE = "triangle binary"


def _one(triangle: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if triangle is not None:
        yield pa.RecordBatch.from_pydict({"triangle": pa.array([triangle.tobytes()], pa.binary())})


def _stack(triangle: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows if triangle is None else np.vstack([triangle, rows]), mode="r")


def triangle_of(vectors: DataFrame, fit: Sums) -> np.ndarray:
    """R of the QR factorisation of all centred rows; its rows may be fewer than its columns."""

    def reduce_rows(batches):
        triangle = None
        for batch in batches:
            for _, x in scaled(batch.column(0), fit.dim).values():
                rows = fit.centred(x)
                for lo in range(0, len(rows), BLOCK_ROWS):
                    triangle = _stack(triangle, rows[lo : lo + BLOCK_ROWS])
        yield from _one(triangle)

    def reduce_triangles(batches):
        triangle = None
        for batch in batches:
            for raw in batch.column(0):
                triangle = _stack(triangle, np.frombuffer(raw.as_py()).reshape(-1, fit.dim))
        yield from _one(triangle)

    found = stage(vectors.mapInArrow(reduce_rows, _TRIANGLE), "triangles")
    while (left := found.count()) > 1:
        found = stage(found.repartition(-(-left // FAN_IN)).mapInArrow(reduce_triangles, _TRIANGLE), "triangles")
    return np.frombuffer(found.first()["triangle"]).reshape(-1, fit.dim)


# --- the bidiagonal problem ---------------------------------------------------------------------

def _reflector(x: np.ndarray) -> np.ndarray:
    """Unit u such that x - 2 u (u . x) has zeros after its first entry; zeros if x has them already."""
    u = x.astype(np.float64, copy=True)
    if not np.any(u[1:]):
        return np.zeros_like(u)
    u[0] += np.copysign(np.linalg.norm(u), u[0])
    return u / np.linalg.norm(u)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of B, and P, of a square matrix r = Q B P^T with Q and P orthogonal."""
    b, d = r.copy(), len(r)
    p = np.eye(d)
    for i in range(d):
        u = _reflector(b[i:, i])
        b[i:, i:] -= np.outer(2 * u, u @ b[i:, i:])
        if i < d - 2:
            u = _reflector(b[i, i + 1 :])
            b[i:, i + 1 :] -= np.outer(b[i:, i + 1 :] @ u, 2 * u)
            p[:, i + 1 :] -= np.outer(p[:, i + 1 :] @ u, 2 * u)
    return np.diag(b).copy(), np.diag(b, 1).copy(), p


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float]:
    """One dqds transform; the smallest d is negative if the shift was too large."""
    n = len(q)
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    d = low = q[0] - shift
    for i in range(n - 1):
        new_q[i] = d + e[i]
        if low < 0 or new_q[i] <= 0:
            return q, e, min(low, -shift)
        ratio = q[i + 1] / new_q[i]
        new_e[i] = e[i] * ratio
        d = d * ratio - shift
        low = min(low, d)
    new_q[-1] = d
    return new_q, new_e, low


def _smaller_of_two(q1: float, e1: float, q2: float) -> float:
    """The smaller eigenvalue of the last two rows' product."""
    mean, product = (q1 + e1 + q2) / 2, q1 * q2
    root = np.sqrt(max(mean * mean - product, 0.0))
    return product / (mean + root) if mean + root > 0 else 0.0


def dqds(q: list[float], e: list[float]) -> list[float]:
    """Squares of the singular values of a bidiagonal with squared diagonal ``q`` (positive) and superdiagonal ``e``, falling."""
    found, todo = [], [(list(q), list(e), 0.0)]
    while todo:
        q, e, base = todo.pop()
        while True:
            n = len(q)
            if n == 1:
                found.append(base + q[0])
                break
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= _EPS**2 * (base + min(q[i], q[i + 1]))), None)
            if cut is not None:
                todo += [(q[: cut + 1], e[:cut], base), (q[cut + 1 :], e[cut + 1 :], base)]
                break
            if q[0] < q[-1] / 1.5:
                q, e = q[::-1], e[::-1]
            shift = _smaller_of_two(q[-2], e[-1], q[-1]) * (1 - 4 * _EPS)
            for attempt in range(8):
                new_q, new_e, low = _step(q, e, shift)
                if low >= 0:
                    break
                shift = shift / 4 if attempt < 6 else 0.0
            else:
                raise ArithmeticError("qd transform without a shift failed")
            q, e, base = new_q, new_e, base + shift
    return sorted(found, reverse=True)


def twisted_vector(a: np.ndarray, b: np.ndarray, value: float, against: list[np.ndarray]) -> np.ndarray:
    """Unit eigenvector of B^T B for ``value``, B with diagonal ``a`` and superdiagonal ``b``.

    L D L^T = B^T B is factored less the value from the top (stationary) and from the bottom (progressive). Where both
    meet with the least rest the twist starts, and the vector follows by products alone. ``against`` holds vectors of
    values that agree with this one in most digits: there the vector is made orthogonal by steps of inverse iteration.
    """
    n = len(a)
    if n == 1:
        return np.ones(1)
    d, l = a * a, b / a[:-1]
    tiny = _EPS * _EPS * max(float(d.max()), value, np.finfo(float).tiny)
    upper, lower = np.zeros(n - 1), np.zeros(n - 1)
    top, s = np.zeros(n), np.full(n, -value)
    for i in range(n - 1):
        top[i] = s[i] + d[i] or tiny
        lower[i] = d[i] * l[i] / top[i]
        s[i + 1] = lower[i] * l[i] * s[i] - value
    top[-1] = s[-1] + d[-1] or tiny
    p = np.zeros(n)
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        ratio = d[i] / (d[i] * l[i] * l[i] + p[i + 1] or tiny)
        upper[i] = l[i] * ratio
        p[i] = p[i + 1] * ratio - value
    k = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -lower[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -upper[i] * z[i]
    z /= np.linalg.norm(z)
    if not against:
        return z
    rng = np.random.default_rng(len(against))
    for _ in range(4):
        for _ in range(2):
            for v in against:
                z = z - v * (v @ z)
        size = np.linalg.norm(z)
        z = z / size if size > 1e-8 else rng.standard_normal(n)
        for i in range(n - 1):  # solve with the stationary factors
            z[i + 1] -= lower[i] * z[i]
        z = z / top
        for i in range(n - 2, -1, -1):
            z[i] -= lower[i] * z[i + 1]
        z /= np.linalg.norm(z)
    for _ in range(2):
        for v in against:
            z = z - v * (v @ z)
        z /= np.linalg.norm(z)
    return z


def directions(r: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest squared singular values of ``r``, falling, and their right vectors as columns."""
    dim = r.shape[1]
    square = np.zeros((dim, dim))
    square[: len(r)] = r
    scale = np.abs(square).max()
    if scale == 0:
        return np.zeros(min(wanted, dim)), np.eye(dim)[:, :wanted]
    a, b, p = bidiagonal(square / scale)
    norm = max(np.abs(a).max(), np.abs(b).max(initial=0.0))
    # Changes within the rounding of the reflections: no diagonal entry is zero, and negligible ones split the problem.
    a = np.where(np.abs(a) < _EPS * norm, _EPS * norm, a)
    bounds = [0, *(np.flatnonzero(np.abs(b) < _EPS * norm) + 1).tolist(), dim]
    found = []
    for lo, hi in zip(bounds, bounds[1:]):
        values = dqds((a[lo:hi] ** 2).tolist(), (b[lo : hi - 1] ** 2).tolist())[:wanted]
        found += [(v, lo, hi) for v in values]
    found = sorted(found, key=lambda f: -f[0])[:wanted]
    vectors: list[tuple[float, int, np.ndarray]] = []
    for value, lo, hi in found:
        close = [z for v, at, z in vectors if at == lo and v - value < 1e-5 * v]
        vectors.append((value, lo, twisted_vector(a[lo:hi], b[lo : hi - 1], value, close)))
    columns = np.zeros((dim, len(found)))
    for j, (_, lo, z) in enumerate(vectors):
        columns[:, j] = p[:, lo : lo + len(z)] @ z
    return np.array([v for v, _, _ in vectors]) * scale**2, columns


# --- the operator -------------------------------------------------------------------------------

@dataclass(frozen=True)
class Whitening:
    """Mean, eigenvalues of the covariance (falling), directions as columns, and the share of each in the trace."""

    fit: Sums
    values: np.ndarray
    columns: np.ndarray
    explained: tuple[float | None, ...]

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of scaled rows; NaN along a direction without variance."""
        flat = self.values <= self.fit.dim * _EPS * self.values.max(initial=0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(flat, np.nan, self.fit.centred(x) @ self.columns / np.sqrt(self.values))


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on all usable rows of a frame with one column of arrays; None if there are none."""
    fit = sums(vectors)
    if fit is None:
        return None
    r = triangle_of(vectors, fit)
    squares, columns = directions(r, components)
    trace = float((r * r).sum())
    return Whitening(fit, squares / fit.n, columns, tuple(float(s) / trace if trace > 0 else None for s in squares))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of whitened rows less the identity, over directions with variance."""
    k = len(model.values)

    def products(batches):
        total = np.zeros(k + k * k)
        for batch in batches:
            for _, x in scaled(batch.column(0), model.fit.dim).values():
                w = np.nan_to_num(model.project(x))
                total += np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
        yield pa.RecordBatch.from_pydict({"v": pa.array([total.tolist()], pa.list_(pa.float64()))})

    row = vectors.mapInArrow(products, "v array<double>").agg(*[F.sum(F.col("v")[i]) for i in range(k + k * k)]).first()
    mean = np.array(row[:k]) / model.fit.n
    cov = np.array(row[k:]).reshape(k, k) / model.fit.n - np.outer(mean, mean)
    varied = np.flatnonzero(np.diag(cov) > 0)
    return float(np.abs(cov - np.eye(k))[np.ix_(varied, varied)].max(initial=0.0))


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened components of every usable row: id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty or holds null, non-finite or (beyond 2**42 or so) no longer exact entries are dropped. Vectors of
    another length than the most frequent one (ties: the longer) have no covariance with the rest and are dropped too. Null ids, repeated ids
    and repeated rows are rows like any other. Directions without variance (one row, equal rows, fewer rows than dimensions) have a null
    ``whitened``; without any variance ``explained`` is null. Equal eigenvalues give some orthonormal basis of their space, the same for
    all rows. A ``deviation`` beyond the largest long is null. Vectors of some thousand entries are meant: the last step is cubic in their length.
    An empty table gives no rows. Other columns are ignored.
    """
    id_type = table.schema[id_col].dataType.simpleString()
    vectors = table.select(F.col(vector_col))
    schema = f"`{id_col}` {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit_whitening(vectors, components)
    if model is None:
        return table.sparkSession.createDataFrame([], schema)
    error = identity_error(vectors, model)
    k = len(model.values)

    def rows(batches):
        for batch in batches:
            for at, x in scaled(batch.column(1), model.fit.dim).values():
                n = len(x)
                whitened = model.project(x).ravel()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * k, model.fit.n)), pa.array(model.fit.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(n), k))),
                    pa.array(whitened, mask=np.isnan(whitened)), pa.array(list(model.explained) * n, pa.float64()), pa.array(np.full(n * k, error)),
                ], names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return table.select(id_col, vector_col).mapInArrow(rows, schema)
