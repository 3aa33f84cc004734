import numpy as np
import pytest

from dumplake.llm import whitening as W
from dumplake.llm.registry import table

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component string"


def plain(vectors):
    """Usable rows scaled, their exact sums, and the eigenvectors of their covariance by numpy."""
    x = np.array([np.floor(1024 * np.array(v, np.float32).astype(np.float64)) + 100000 for v in vectors])
    mean = x.mean(axis=0)
    c = x - mean
    values, columns = np.linalg.eigh(c.T @ c / len(x))
    return x.astype(np.int64), values[::-1], columns[:, ::-1]


def check(got, ids, vectors, k=8):
    x, values, columns = plain(vectors)
    n, s = len(x), [int(t) for t in x.sum(axis=0)]
    k = min(k, x.shape[1])
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    assert set(by_id) == set(ids) and all(set(c) == set(range(1, k + 1)) for c in by_id.values())
    white = np.array([[by_id[i][j].whitened for j in range(1, k + 1)] for i in ids])
    cov = white.T @ white / n
    assert np.abs(cov - np.eye(k)).max() < 1e-9 and abs(got[0].identity_error) < 1e-9
    for i, v in zip(ids, x):
        r = by_id[i][1]
        assert r.n == n and r.deviation == sum((n * int(a) - b) ** 2 for a, b in zip(v, s))
    c = x - x.mean(axis=0)
    for j in range(k):
        assert by_id[ids[0]][j + 1].explained == pytest.approx(values[j] / values.sum(), rel=1e-10)
        gap = min(abs(values[j] - values[m]) for m in range(len(values)) if m != j) / values[j]
        if gap > 1e-6:
            want = c @ columns[:, j] / np.sqrt(values[j])
            assert min(np.abs(white[:, j] - want).max(), np.abs(white[:, j] + want).max()) < 1e-12 / gap * 100


def test_given_vectors_like_eigh(spark, texts):
    from conftest_paths import SF
    t = table(spark, SF, "embeddings")
    rows = t.collect()
    check(W.whiten(t).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_many_small_blocks_give_one_triangle(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = (rng.standard_normal((700, 12)) @ rng.standard_normal((12, 12))).astype(np.float32)
    frame = spark.createDataFrame([(i, a.tolist(), 1, 2, "x") for i, a in enumerate(v)], SCHEMA).repartition(40)
    monkeypatch.setattr(W, "BLOCK_ROWS", 5)
    check(W.whiten(frame).collect(), list(range(700)), v)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0, 4.0], [0.5, -2.0, 1.0], [3.0, 1.0, -1.0], [3.0, 1.0, -1.0], [0.25, 0.0, 9.0]]
    bad = [None, [], [1.0, None, 2.0], [nan, 1.0, 1.0], [1.0, inf, 1.0], [1e30, 1.0, 1.0], [1.0, 2.0]]
    frame = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in enumerate(good + bad)], SCHEMA)
    check(W.whiten(frame).collect(), [0, 1, 2, 3, 4], good)
    assert W.whiten(frame.where("vec_id >= 5 AND vec_id < 11")).count() == 0 and W.whiten(frame.limit(0)).count() == 0
    one = W.whiten(frame.where("vec_id = 0")).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained) for r in one] == [(1, 0, None, None)] * 3
    null_id = spark.createDataFrame([(None, v, 1, 2, "x") for v in good], SCHEMA)
    assert [r.vec_id for r in W.whiten(null_id).collect()] == [None] * 15


def test_too_few_rows_and_wide_rows(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((4, 10)).astype(np.float32)
    rows = W.whiten(spark.createDataFrame([(i, a.tolist(), 1, 2, "x") for i, a in enumerate(v)], SCHEMA)).collect()
    assert len(rows) == 32 and all((r.whitened is None) == (r.component > 3) for r in rows) and rows[0].identity_error < 1e-9


def test_deviation_beyond_a_long_is_null():
    fit = W.Sums(10**7, (10**12, 10**12))
    assert fit.deviations(np.array([[2**40, 5], [100000, 100001]])) == [None, 10**14]


@pytest.mark.parametrize("dim", [1, 2, 3, 17, 64])
def test_directions_like_svd(dim):
    rng = np.random.default_rng(dim)
    kinds = [rng.standard_normal((dim, dim)), np.eye(dim), np.zeros((dim, dim)), np.ones((dim, dim)), np.diag(10.0 ** -np.arange(dim)),
             np.diag(np.repeat([3.0, 2.0], [dim // 2, dim - dim // 2])), rng.standard_normal((dim, dim)) * (10.0 ** -rng.uniform(0, 6, dim)),
             np.diag(np.abs(np.arange(dim) - dim // 2) + 1.0) + np.diag(np.ones(dim - 1), 1), np.linalg.qr(rng.standard_normal((dim, dim)))[0]]
    kinds += [rng.standard_normal((dim, dim)) for _ in range(30)]
    for r in kinds:
        values, columns = W.directions(r, dim)
        want = np.linalg.svd(r, compute_uv=False) ** 2
        top = want[0] or 1.0
        assert np.abs(values - want).max() <= 1e-13 * top * dim
        assert np.abs(columns.T @ columns - np.eye(dim)).max() < 1e-9
        assert np.abs(r.T @ (r @ columns) - columns * values).max() <= 1e-12 * top * dim


