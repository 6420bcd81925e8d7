import numpy as np
import pytest

from lexgrove.llm import whitening

ROWS = "vec_id long, embedding array<float>"


def plain(vectors, k=8):
    """(n, deviations, whitened, explained) by eigenvectors of the covariance."""
    x = np.floor(1024 * np.asarray(vectors, np.float32).astype(np.float64)).astype(np.int64) + 100000
    n, s = len(x), x.sum(0)
    centred = (n * x - s) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    return n, ((n * x - s) ** 2).sum(1), centred @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def check(frame, ids, vectors, k=8):
    got = whitening.whitened(frame).toPandas()
    n, deviation, want, explained = plain(vectors, k)
    assert set(got.n) == {n} and len(got) == n * k and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    table = table * np.sign((table * want).sum(0))
    assert np.abs(table - want).max() < 1e-8
    assert (got.groupby("vec_id").deviation.first().loc[ids].to_numpy() == deviation).all()
    assert np.abs(got.groupby("component").explained.first().to_numpy() - explained).max() < 1e-12


def test_against_eigenvectors(spark):
    r = np.random.default_rng(1)
    v = (r.normal(size=(700, 12)) * np.geomspace(1, 1e-2, 12)).astype(np.float32) @ np.linalg.qr(r.normal(size=(12, 12)))[0].astype(np.float32)
    check(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], ROWS).repartition(5), list(range(700)), v)


def test_many_factors_are_merged(spark):
    v = np.random.default_rng(2).normal(size=(900, 9)).astype(np.float32)
    check(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], ROWS).repartition(40), list(range(900)), v)


def test_rows_that_take_no_part(spark):
    v = np.random.default_rng(3).normal(size=(50, 9)).astype(np.float32)
    odd = [(100, None), (101, []), (102, [1.0] * 8), (103, [None] + [1.0] * 8), (104, [float("nan")] * 9), (105, [float("inf")] * 9), (106, [3e38] * 9)]
    frame = spark.createDataFrame([(i, x.tolist(), 5) for i, x in enumerate(v)] + [(*x, 5) for x in odd], ROWS + ", vec long").repartition(3)
    check(frame, list(range(50)), v)


def test_null_and_repeated_ids_are_rows(spark):
    v = np.random.default_rng(4).normal(size=(20, 9)).astype(np.float32).tolist()
    got = whitening.whitened(spark.createDataFrame([(None if i < 2 else 7, x) for i, x in enumerate(v)], ROWS)).toPandas()
    assert len(got) == 160 and got.vec_id.isna().sum() == 16 and set(got.n) == {20}


@pytest.mark.parametrize(("rows", "components"), [([[1.0] * 9] * 5, 0), ([[1.0, 2.0]], 0), ([[float(i), 0.0, 0.0] for i in range(4)], 1), ([], 0)])
def test_components_without_variance_are_left_out(spark, rows, components):
    got = whitening.whitened(spark.createDataFrame([(i, x) for i, x in enumerate(rows)], ROWS)).toPandas()
    assert len(got) == len(rows) * components and np.isfinite(got.whitened.astype(float)).all()


def test_large_entries_stay_exact(spark):
    v = [[float(2**i * (1 if j % 2 else -1) + j) for j in range(9)] for i in range(30)]
    got = whitening.whitened(spark.createDataFrame([(i, x) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).toPandas().groupby("vec_id").deviation.first()
    x = (np.floor(1024 * np.array(v)).astype(np.int64) + 100000).astype(object)
    want = ((30 * x - x.sum(0)) ** 2).sum(1)
    assert all((a is None or np.isnan(a)) if b >= 2**63 else abs(int(a) - int(b)) <= b >> 50 for a, b in zip(got.tolist(), want, strict=True))


def test_jacobi_keeps_small_values_accurate():
    """Columns of very different lengths: each value is right to its own size, which the covariance could not give."""
    r = np.random.default_rng(5)
    q = np.linalg.qr(r.normal(size=(16, 16)))[0]
    size = np.geomspace(1, 1e-12, 16)
    sigma, v = whitening.jacobi(np.linalg.qr(q * size, mode="r"))
    assert np.abs(sigma / size - 1).max() < 1e-10 and np.abs(v.T @ v - np.eye(16)).max() < 1e-12
    odd = r.normal(size=(7, 7))
    assert np.abs(whitening.jacobi(odd)[0] - np.linalg.svd(odd)[1]).max() < 1e-12
