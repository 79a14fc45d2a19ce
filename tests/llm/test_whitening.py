"""Whitening against numpy's eigenvectors and exact sums."""

import numpy as np
import pytest

from feedtriage.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int, component string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(5)


def wanted(vectors):
    x = np.floor(64 * np.array(vectors, np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(0)
    centred = np.array([[float(int(a) * n - int(s)) / n for a, s in zip(row, total)] for row in x])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total)) for row in x]
    return x, centred, e[::-1], u[:, ::-1], deviation


def test_whitened_rows(spark):
    rng = np.random.default_rng(1)
    good = (rng.normal(size=(400, 40)) @ rng.normal(size=(40, 40)) * np.geomspace(1, 1e-2, 40)).astype(np.float32).tolist()
    rows = list(enumerate(good)) + [(None, good[0]), (3, good[5])]
    bad = [(900, None), (901, [None] + good[1][1:]), (902, [float("nan")] + good[1][1:]), (903, [float("inf")] + good[1][1:]),
           (904, []), (905, [1.0, 2.0]), (906, [3e38] + good[1][1:])]
    out = whitening.whitened_rows(table(spark, rows + bad)).toPandas()
    vectors = [v for _, v in rows]
    x, centred, e, u, deviation = wanted(vectors)
    assert len(out) == len(rows) * 32 and set(out.component) == set(range(1, 33)) and set(out.n) == {len(rows)}
    assert sorted(out[out.component == 1].deviation) == sorted(deviation)
    explained = out.groupby("component").explained.first().to_numpy()
    assert np.allclose(explained, e[:32] / e.sum(), rtol=1e-9)
    assert out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-9
    want = centred @ u[:, :32] / np.sqrt(e[:32])
    unique = out[out.vec_id.isin(range(10, 400))].pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = want[10:400] * np.sign((unique * want[10:400]).sum(0))
    assert np.abs(unique - want).max() < 1e-6


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    assert whitening.whitened_rows(table(spark, rows)).count() == 0


def test_fewer_dimensions_than_asked_for(spark):
    rng = np.random.default_rng(2)
    flat = rng.normal(size=(300, 3)) @ rng.integers(-2, 3, size=(3, 6)) / 2
    out = whitening.whitened_rows(table(spark, [(i, [float(round(c * 64) / 64) for c in v]) for i, v in enumerate(flat)])).toPandas()
    assert out.component.max() <= 6 and out.identity_error[0] < 1e-4


def test_factor_and_rotations_are_accurate():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(64, 64)))
    wanted = np.geomspace(1e6, 1e-2, 64)
    a = (q * wanted) @ q.T
    a = (a + a.T) / 2
    factor, order = whitening.pivoted_cholesky(a)
    assert np.allclose(factor @ factor.T, a[order][:, order], rtol=0, atol=1e-9)
    assert np.allclose(np.triu(factor, 1), 0)
    e, u = whitening.one_sided_jacobi(factor)
    assert np.allclose(e, wanted, rtol=1e-6) and np.abs(u.T @ u - np.eye(64)).max() < 1e-12
    assert np.abs(a[order][:, order] @ u - u * e).max() < 1e-8
    low = rng.normal(size=(9, 4))
    factor, _ = whitening.pivoted_cholesky(low @ low.T)
    assert factor.shape == (9, 4)


def test_deviations_beyond_a_long_are_null():
    fitted = whitening.Whitening(10 ** 9, [10 ** 15], np.ones(1), np.ones((1, 1)), 1.0)
    assert fitted.deviations(np.array([[10 ** 6], [10 ** 6 + 2], [10 ** 6 + 2 ** 40]])) == [0, 4 * 10 ** 18, None]
