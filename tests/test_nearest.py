import tracemalloc

import numpy as np
import pytest

from facetta.operators import simplex, smap
from facetta.operators.nearest import distances, nearest
from facetta.operators.predictors import simplex_loo


def by_all_distances(x, q, k, place, at=None, apart=None):
    order = np.argsort(place)
    d = distances(x, q)
    if apart is not None:
        d[np.abs(at[:, None] - place[None]) <= apart] = np.inf
    row = order[np.argsort(d[:, order], axis=1, kind="stable")[:, :k]]
    return np.take_along_axis(d, row, axis=1), row


@pytest.mark.parametrize("kind", ["plain", "ties", "copies", "nan"])
@pytest.mark.parametrize("d", [1, 2, 3, 5])
def test_nearest_is_exact(kind, d):
    rng = np.random.default_rng(d)
    x, q = rng.normal(size=(900, d)), rng.normal(size=(300, d))
    if kind == "ties":
        x, q = np.round(x, 1), np.round(q, 1)
    if kind == "copies":
        x[rng.random(900) < 0.7] = q[:50] = x[0]
    if kind == "nan":
        x[1, 0] = q[0, 0] = np.nan
        x[2] = np.inf
    place = rng.permutation(900)
    for k in (1, 4):
        for a, b in ((nearest(x, q, k, place=place), by_all_distances(x, q, k, place)), *((nearest(x, x, k, place=place, at=place, apart=w), by_all_distances(x, x, k, place, place, w)) for w in (0, 3))):
            np.testing.assert_array_equal(a[0], b[0])
            known = np.isfinite(b[0])
            np.testing.assert_array_equal(a[1][known], b[1][known])


def peak_mb(f) -> float:
    tracemalloc.start()
    f()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak


def test_predictors_hold_no_matrix_of_all_distances():
    """F2, F3, F5 to F8, F12, F13, F15, F16: 20,000 rows would be 800 MB for 5,000 queries, 3.2 GB for all."""
    rng = np.random.default_rng(0)
    x, y, q = rng.normal(size=(20_000, 2)), rng.normal(size=(20_000, 1)), rng.normal(size=(5_000, 2))
    assert peak_mb(lambda: simplex(x, y, q)) < 100
    assert peak_mb(lambda: simplex_loo(x, y, theiler_window=1)) < 100
    assert peak_mb(lambda: smap(1.0)(x, y, q[:1000])) < 100


def test_smap_is_least_squares():
    rng = np.random.default_rng(1)
    x, y, q = rng.normal(size=(60, 3)) * [1, 100, 1e-3] + 5, rng.normal(size=(60, 2)), rng.normal(size=(40, 3)) * [1, 100, 1e-3] + 5
    for own in (x, np.column_stack([x[:, :2], x[:, 1]])):  # the second has a column twice: the least map of many
        dist = distances(own, q)
        w = np.exp(-2 * dist / dist.mean(axis=1, keepdims=True))
        a = np.column_stack([np.ones(60), own])
        want = [np.append(1, q[i]) @ np.linalg.lstsq(w[i][:, None] * a, w[i][:, None] * y, rcond=None)[0] for i in range(40)]
        np.testing.assert_allclose(smap(2.0)(own, y, q), want, rtol=1e-7, atol=1e-9)


def test_columns_makes_no_row_for_each_pair(spark):
    """F4, F9 to F11, F14, F17: what is sorted grows with queries and neighbours, not with pairs of rows."""
    from pyspark.sql import functions as F

    from facetta.operators.kernel import candidates

    n = 2000
    own = spark.range(n).select(F.lit(0).alias("fold_id"), F.col("id").alias("pos"), F.array(F.rand(1), F.rand(2)).alias("x"), F.array(F.rand(3)).alias("y"))
    states = spark.createDataFrame([(0, [0, 1]), (1, [1, 0])], "sid long, state array<bigint>")
    assert candidates(states, own, own, 2, rows=n, width=3, count=2, theiler=0).count() == 2 * n * 3
