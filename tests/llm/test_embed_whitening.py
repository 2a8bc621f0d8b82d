import numpy as np
import pytest

from quadlens.llm import embed_whitening, qd


def spectrum(values, seed=0):
    """A square matrix with these singular values."""
    rng = np.random.default_rng(seed)
    n = len(values)
    u, v = (np.linalg.qr(rng.standard_normal((n, n)))[0] for _ in range(2))
    return u @ np.diag(values) @ v.T


@pytest.mark.parametrize("values", [[3.0], [3, 2], [5, 4, 3, 2, 1], np.geomspace(1, 1e-8, 30), np.linspace(9, 1, 64), [4, 4, 4, 1], [7, 7, 7 - 1e-9, 2, 2, 1e-3],
                                    [3, 2, 0, 0], [1] * 6, np.r_[100, np.full(20, 1.0)], np.linspace(1, 1 + 1e-6, 12)])
def test_singular_values_and_vectors(values):
    values = np.array(values, float)
    r = spectrum(values)
    squares, vectors = qd.right_singular(r, 16)
    s = np.linalg.svd(r, compute_uv=False)
    np.testing.assert_allclose(np.sqrt(np.maximum(squares, 0)), s, rtol=1e-12, atol=3e-15 * s[0] * len(s))
    k = vectors.shape[1]
    assert k == min(16, int((s > len(s) * 2.3e-16 * s[0]).sum()))
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(k), atol=1e-12)
    np.testing.assert_allclose(np.linalg.norm(r @ vectors, axis=0), s[:k], rtol=1e-9)
    away = r.T @ (r @ vectors) - vectors * s[:k] ** 2
    assert np.abs(away).max() < 1e-12 * s[0] ** 2


@pytest.mark.parametrize("seed", range(5))
def test_small_values_of_a_bidiagonal_matrix_are_accurate(seed):
    # the product of all singular values is that of the diagonal, also where they differ by many powers of ten
    rng = np.random.default_rng(seed)
    a, b = 10 ** rng.uniform(-6, 2, 40), 10 ** rng.uniform(-6, 2, 39)
    squares = qd.dqds(a, b)
    assert abs(np.log(squares).sum() / 2 - np.log(a).sum()) < 1e-12
    np.testing.assert_allclose(np.sqrt(squares[:5]), np.linalg.svd(np.diag(a) + np.diag(b, 1), compute_uv=False)[:5], rtol=1e-12)


def by_eigh(vectors, components=16):
    x = np.floor(np.array(vectors, float) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ v[:, :components] / np.sqrt(e[:components]), e[:components] / e.sum()


def test_rows_as_by_an_eigenvalue_solver(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.standard_normal((700, 24)) * np.geomspace(1, 0.1, 24)) @ np.linalg.qr(rng.standard_normal((24, 24)))[0]
    vectors = np.r_[vectors, np.repeat(vectors[:1], 300, axis=0)].astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows + [(5000, None), (5001, [float("nan")] * 24), (5002, [None] * 24), (5003, [1.0])], "vec_id long, embedding array<float>").repartition(9)
    n, deviation, white, explained = by_eigh(vectors)
    got = sorted(embed_whitening.whiten(df).collect())
    assert len(got) == 16 * len(vectors)
    found = np.array([r["whitened"] for r in got]).reshape(-1, 16)
    assert {r["n"] for r in got} == {n} and [r["deviation"] for r in got[::16]] == deviation.tolist()
    np.testing.assert_allclose([r["explained"] for r in got[:16]], explained, rtol=1e-9)
    np.testing.assert_allclose(found * np.sign(found[0] * white[0]), white, atol=1e-8)
    assert got[0]["identity_error"] < 1e-9


def test_degenerate_and_empty_tables_clashing_columns_and_null_keys(spark):
    schema = "vec_id long, embedding array<double>, x int, component string"
    assert embed_whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert embed_whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0, ""), (2, [1.0, 2.0], 0, "")], schema)).count() == 0
    rows = [(None, [0.0, 1.0, 2.0], 0, ""), (None, [0.0, 1.0, 2.0], 0, ""), (3, [1.0, 1.0, 2.0], 1, "a"), (4, [0.5, 3.0, 2.0], 1, "a")]
    got = embed_whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r["component"] for r in got) == [1] * 4 + [2] * 4 and {r["n"] for r in got} == {3}
    assert sum(r["vec_id"] is None for r in got) == 4


def test_large_numbers_stay_exact():
    x, sums = np.array([[1 << 45, 3], [2, 5]], dtype=np.int64), np.array([7, 1 << 50], dtype=object)
    n = 1 << 20
    want = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    assert embed_whitening.deviations(x, n, sums) == [w if w < 1 << 63 else None for w in want]
    np.testing.assert_allclose(embed_whitening.centred(x, n, sums), [[int(v) - int(s) / n for v, s in zip(row, sums)] for row in x])
