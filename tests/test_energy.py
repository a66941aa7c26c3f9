import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from facetta.functions import CORR, MAE, MEAN_RHO, RMSE, softmax
from facetta.operators import cross, simplex, smap, within
from facetta.operators.predictors import simplex_loo
from facetta.sources import Dataset, Fold

from pyspark.sql import functions as F  # isort: skip


def dataset(spark, x, y):
    rows = [(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))]
    return Dataset.from_frame(spark.createDataFrame(rows, "t long, x array<float>, y array<float>"))


def frame(spark, states, contexts):
    return spark.createDataFrame([(i, list(s), list(c)) for i, (s, c) in enumerate(zip(states, contexts))], "sid long, state array<bigint>, context array<double>")


def colsum(X, Y, Q, *, mask=None):  # noqa: N803
    return np.repeat(Q.sum(axis=-1, keepdims=True), Y.shape[-1], axis=-1)


def problem(seed, n=14, d=3):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=(2, n, d)).astype(np.float32).astype(float)
    order = rng.permutation(n)
    folds = [Fold(order[k : k + 6].tolist(), order[k + 6 : k + 11].tolist()) for k in range(2)]
    return x, y, folds


def scores(out):
    return {r["sid"]: (r["energy"], r["context"]) for r in out.collect()}


@pytest.mark.parametrize("batch", [1, 2, 10_000])
@pytest.mark.parametrize("kind", ["cross", "within"])
def test_folds_of_colsum(spark, kind, batch):
    x, y, folds = problem(3)
    states, contexts = [[0, 1], [2, 0], [1, 2]], [[0.1, 0.5], [0.0, 0.0], [1.0, -1.0]]
    initial, e = (cross if kind == "cross" else within).folds(data=dataset(spark, x, y), folds=folds, predict=colsum, metric=MAE, weight=softmax(0.7), batch_size=batch)
    assert initial == [0.0, 0.0]
    got = scores(e(frame(spark, states, contexts)))
    for i, s in enumerate(states):
        t = y if kind == "cross" else y[:, s]
        m = np.array([np.abs(x[f.validation][:, s].sum(1, keepdims=True) - t[f.validation]).mean() for f in folds])
        w = np.exp(np.array(contexts[i]) / 0.7)
        np.testing.assert_allclose(got[i][0], (w / w.sum() * (m - contexts[i])).sum(), rtol=1e-9)
        np.testing.assert_allclose(got[i][1], m, rtol=1e-9)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000), theiler=st.integers(0, 2))
def test_columns_and_arrow_agree(spark, seed, theiler):
    x, y, folds = problem(seed)
    data, states = dataset(spark, x, y), [[0, 2], [1, 0]]
    for kind in (cross, within):
        for metric in (MAE, RMSE, CORR):
            both = [kind.loo(data=data, metric=metric, theiler_window=theiler, engine=g)[1](frame(spark, states, [[]] * 2)) for g in ("columns", "arrow")]
            a, b = map(scores, both)
            np.testing.assert_allclose([a[i][0] for i in range(2)], [b[i][0] for i in range(2)], atol=1e-9)
    both = [cross.folds(data=data, folds=folds, predict=simplex, metric=MAE, weight=softmax(), engine=g)[1](frame(spark, states, [[0.3, 0.1]] * 2)) for g in ("columns", "arrow")]
    a, b = map(scores, both)
    np.testing.assert_allclose([a[i][0] for i in range(2)], [b[i][0] for i in range(2)], atol=1e-9)


def test_blocks_agree_with_broadcast(spark, monkeypatch):
    from facetta.operators import kernel

    x, y, folds = problem(5)
    own = [[0, 1], [2, 0], [1, 2]]

    def run():
        got = scores(cross.holdout(data=dataset(spark, x, y), fold=folds[0], predict=simplex, metric=MAE, engine="columns")[1](frame(spark, own, [[]] * 3)))
        return [got[i][0] for i in range(3)]

    whole = run()
    for size in (300, 64):  # three blocks of rows; eleven, and two of states
        monkeypatch.setattr(kernel, "BROADCAST_BYTES", size)
        np.testing.assert_allclose(run(), whole, atol=1e-12)


@pytest.mark.parametrize("n, theiler", [(5, 2), (6, 2), (3, 1), (4, 0), (1, 0)])
@pytest.mark.parametrize("kind", [cross, within])
def test_queries_without_neighbours(spark, kind, n, theiler):
    """A row without any neighbour has no prediction, and then the state no metric, in both engines."""
    rng = np.random.default_rng(n)
    data = dataset(spark, *rng.normal(size=(2, n, 3)))
    for metric in (MAE, RMSE, CORR):
        a, b = (scores(kind.loo(data=data, metric=metric, theiler_window=theiler, engine=g)[1](frame(spark, [[0], [2]], [[]] * 2))) for g in ("columns", "arrow"))
        np.testing.assert_allclose([a[i][0] for i in range(2)], [b[i][0] for i in range(2)], atol=1e-9)
        assert np.isnan(a[0][0]) == (n - 1 <= 2 * theiler)


@pytest.mark.parametrize("engine", ["columns", "arrow"])
def test_states_of_several_lengths(spark, engine):
    x, y, folds = problem(8)
    for kind in (cross, within):
        _, e = kind.holdout(data=dataset(spark, x, y), fold=folds[0], predict=simplex, metric=MAE, engine=engine)
        got = scores(e(frame(spark, [[1], [0, 2], [2, 1, 0]], [[]] * 3), mixed=True))
        for i, s in enumerate([[1], [0, 2], [2, 1, 0]]):
            np.testing.assert_allclose(got[i][0], scores(e(frame(spark, [s], [[]])))[0][0], atol=1e-12)


def test_scan_engines_agree(spark):
    from facetta.operators import scan

    rng = np.random.default_rng(3)
    data = dataset(spark, rng.normal(size=(40, 2)), rng.normal(size=(40, 1)))
    fold = lambda n: Fold(list(range(n - 1, 5, -1)), [0, 2, 4])
    for own in (None, fold):
        a, b = ({(r["col"], r["E"], r["tau"]): r["score"] for r in scan(data.frame, E=(1, 3, 20), tau=(1, 2), columns=(0, 1), fold=own, engine=g).collect()} for g in ("columns", "arrow"))
        assert a.keys() == b.keys() and len(a) == 8 + 2 * (40 - 19 >= 3) + 2 * (40 - 38 >= 3)
        np.testing.assert_allclose(list(a.values()), [b[k] for k in a], atol=1e-9)


def test_smap_by_hand():
    """Weighted least squares by the normal equations, one query at a time."""
    rng = np.random.default_rng(7)
    X, Y, Q, theta = rng.normal(size=(25, 2)), rng.normal(size=(25, 1)), rng.normal(size=(4, 2)), 1.5  # noqa: N806
    for got, q in zip(smap(theta)(X, Y, Q), Q):
        dist = np.array([math.dist(q, p) for p in X])
        w = np.diag(np.exp(-theta * dist / dist.mean()) ** 2)
        a = np.column_stack([np.ones(25), X])
        np.testing.assert_allclose(got, np.array([1, *q]) @ np.linalg.solve(a.T @ w @ a, a.T @ w @ Y), rtol=1e-8)


def test_mask_of_predictors():
    rng = np.random.default_rng(9)
    X, Y, Q = rng.normal(size=(12, 2)), rng.normal(size=(12, 1)), rng.normal(size=(3, 2))  # noqa: N806
    keep = np.arange(12) % 3 > 0
    for f in (simplex, smap(0.5)):
        np.testing.assert_allclose(f(X, Y, Q, mask=keep), f(X[keep], Y[keep], Q))


def test_simplex_by_hand():
    X, Y, Q = np.array([[0.0], [1.0], [3.0]]), np.array([[1.0], [2.0], [9.0]]), np.array([[0.25]])  # noqa: N806
    w = np.exp([-1, -3])
    np.testing.assert_allclose(simplex(X, Y, Q), [[(w @ [1.0, 2.0]) / w.sum()]])
    np.testing.assert_allclose(simplex(X[None], Y[None], Q[None])[0], simplex(X, Y, Q))
    np.testing.assert_allclose(simplex(X, Y, Q, mask=np.array([False, True, True])), simplex(X[1:], Y[1:], Q))


def test_loo_batch_of_one():
    x, y, _ = problem(1)
    np.testing.assert_allclose(simplex_loo(x[None], y[None], theiler_window=1)[0], simplex_loo(x, y, theiler_window=1))


def test_smap_is_linear_for_theta_zero():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 2))
    y = x @ [[2.0], [-1.0]] + 3
    np.testing.assert_allclose(smap(0.0)(x, y, x[:5]), y[:5], atol=1e-9)


@pytest.mark.parametrize("t", [0.1, 1.0, 10.0])
def test_softmax(spark, t):
    rows = [[0.0, 0.0, 0.0], [1e6, -1e6, 0.0], [3.0, -2.0, 0.5]]
    want = softmax(t)(np.array(rows))
    np.testing.assert_allclose(want.sum(axis=1), 1)
    got = [r[0] for r in spark.createDataFrame(list(enumerate(rows)), "k long, c array<double>").orderBy("k").select(softmax(t)(F.col("c"))).collect()]
    np.testing.assert_allclose(got, want, rtol=1e-12)


def test_metric_of_constant_is_nan():
    assert np.isnan(MEAN_RHO(np.ones((1, 4, 1)), np.arange(4.0).reshape(1, 4, 1))[0])


def test_constant_target_gives_nan_energy(spark):
    x, _, folds = problem(2)
    data = dataset(spark, x, np.ones((14, 1)))
    for engine in ("columns", "arrow"):
        got = scores(cross.holdout(data=data, fold=folds[0], predict=simplex, metric=CORR, engine=engine)[1](frame(spark, [[0]], [[]])))
        assert np.isnan(got[0][0])


@pytest.mark.parametrize(
    "build, words",
    [
        (lambda d: cross.folds(data=d, folds=[], predict=simplex, metric=MAE, weight=softmax()), "folds must be non-empty"),
        (lambda d: within.folds(data=d, folds=[], predict=simplex, metric=MAE, weight=softmax()), "folds must be non-empty"),
        (lambda d: cross.loo(data=d, metric=MAE, theiler_window=-1), "theiler_window"),
        (lambda d: within.loo(data=d, metric=MAE, theiler_window=-1), "theiler_window"),
        (lambda d: cross.loo(data=d, metric=MAE, batch_size=0), "batch_size"),
        (lambda d: cross.holdout(data=d, fold=Fold([0], [1]), predict=colsum, metric=MAE, engine="columns"), "built-in"),
        (lambda d: softmax(0), "temperature"),
    ],
)
def test_errors_come_early(build, words):
    with pytest.raises(ValueError, match=words):
        build(None)


@pytest.mark.parametrize("states", [[[0, 0]], [[0, 3]], [[-1, 0]], [[]], [[0], [1, 2]]])
def test_bad_states(spark, states):
    x, y, folds = problem(4)
    _, e = cross.holdout(data=dataset(spark, x, y), fold=folds[0], predict=simplex, metric=MAE)
    with pytest.raises(ValueError, match="states must"):
        e(frame(spark, states, [[]] * len(states)))


def test_no_states(spark):
    x, y, folds = problem(4)
    _, e = cross.holdout(data=dataset(spark, x, y), fold=folds[0], predict=simplex, metric=MAE)
    assert e(frame(spark, [], [])).collect() == []
