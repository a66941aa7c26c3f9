import numpy as np
import pytest
from pyspark.sql import functions as F

from facetta.functions import compose, gaussian_noise, zscore_normalize
from facetta.sources import Dataset, Fold, Subset, expanding_folds, ar1_columns, fold_frame, horizon_shift, lorenz96, lorenz96_dataset, sliding_folds, temporal_fold


def frames(spark, x, y):
    kx = "array<double>" if not x or np.ndim(x[0]) == 1 else "double" if np.ndim(x[0]) == 0 else "array<array<double>>"
    ky = {0: "double", 1: "array<double>", 2: "array<array<double>>"}[np.ndim(y[0])]
    return spark.createDataFrame(list(enumerate(x)), f"t long, x {kx}"), spark.createDataFrame(list(enumerate(y)), f"t long, y {ky}")


X5 = np.arange(15.0).reshape(5, 3).tolist()


def test_dataset_stores_float32_and_promotes_y(spark):
    d = Dataset(*frames(spark, X5, [0.1, 1.0, 2.0, 3.0, 4.0]))
    assert dict(d.frame.dtypes) == {"t": "bigint", "x": "array<float>", "y": "array<float>"}
    assert len(d) == 5 and d.widths == (3, 1)
    assert d[0] == ([0.0, 1.0, 2.0], [float(np.float32(0.1))])


@pytest.mark.parametrize(
    "x, y, words",
    [
        ([1.0, 2.0], [1.0, 2.0], "X must be 2-D"),
        ([[[1.0]], [[2.0]]], [1.0, 2.0], "X must be 2-D"),
        (X5[:2], [[[1.0]], [[2.0]]], "Y must be 1-D or 2-D"),
        (X5, [1.0, 2.0, 3.0, 4.0], "same length, got 5 and 4"),
    ],
)
def test_dataset_invalid(spark, x, y, words):
    with pytest.raises(ValueError, match=words):
        Dataset(*frames(spark, x, y))


def test_transform_applies_on_access_only(spark):
    double = lambda f: f.withColumn("x", F.transform("x", lambda v: v * 2)).withColumn("y", F.transform("y", lambda v: v + 1))
    d = Dataset(*frames(spark, X5, [0.0] * 5), transform=double)
    assert d[1] == ([6.0, 8.0, 10.0], [1.0])
    assert d.X.where("t = 1").first()["x"] == [3.0, 4.0, 5.0]
    assert Subset(d, [4, 1])[1] == d[1]
    with pytest.raises(IndexError):
        d[7]


@pytest.mark.parametrize("indices", [[4, 1, 3], [2], [], [2, 2], range(1, 4)])
def test_subset(spark, indices):
    d = Dataset(*frames(spark, X5, [0.0] * 5))
    s = Subset(d, indices)
    assert len(s) == len(indices)
    assert [(r["t"], r["x"]) for r in s.X.orderBy("t").collect()] == [(k, X5[i]) for k, i in enumerate(indices)]


def test_horizon_shift(spark):
    x, y = frames(spark, X5, [[float(i)] for i in range(5)])
    out = horizon_shift(x.join(y, "t"), 2).orderBy("t").collect()
    assert [(r["t"], r["y"]) for r in out] == [(0, [2.0]), (1, [3.0]), (2, [4.0])]


@pytest.mark.parametrize("target", ["x", "y", "both"])
def test_zscore(spark, target):
    rng = np.random.default_rng(1)
    data = rng.normal(3, 5, (12, 3)).astype(np.float32).astype(float)
    f = spark.createDataFrame([(i, r, r) for i, r in enumerate(data.tolist())], "t long, x array<float>, y array<float>")
    out = zscore_normalize(f, target=target)(f).orderBy("t").collect()
    want = (data - data.mean(0)) / data.std(0)
    for name in "xy":
        np.testing.assert_allclose([r[name] for r in out], want if target in (name, "both") else data, rtol=1e-4, atol=1e-6)


def test_zscore_flattens_leading_axes(spark):
    f = spark.createDataFrame([(0, [[1.0, 2.0], [3.0, 6.0]]), (1, [[5.0, 1.0]])], "t long, x array<array<double>>")
    g = spark.createDataFrame([(0, [3.0, 3.0])], "t long, x array<double>")
    assert zscore_normalize(f, target="x")(g).first()["x"] == [0.0, 0.0]


def test_zscore_rejects_target(spark):
    with pytest.raises(ValueError, match="target"):
        zscore_normalize(spark.range(1), target="z")


def test_noise_is_seeded_and_fresh(spark):
    f = spark.createDataFrame([(i, [0.0] * 3, [1.0]) for i in range(200)], "t long, x array<float>, y array<float>")
    a, b = gaussian_noise(0.5, 3), gaussian_noise(0.5, 3)
    first, second = (np.array([r["x"] for r in a(f).orderBy("t").collect()]) for _ in range(2))
    again = np.array([r["x"] for r in b(f.repartition(3)).orderBy("t").collect()])
    assert (first == again).all() and (first != second).any()
    assert abs(first.mean()) < 0.1 and abs(first.std() - 0.5) < 0.05
    assert a(f).where("y[0] != 1.0").count() == 0


def test_compose(spark):
    f = spark.createDataFrame([(0, [1.0])], "t long, x array<double>")
    step = lambda g: lambda h: h.withColumn("x", F.transform("x", g))
    assert compose(step(lambda v: v + 1), step(lambda v: v * 2))(f).first()["x"] == [4.0]
    assert compose()(f) is f


def test_folds():
    assert temporal_fold(2000, 0.8) == Fold(range(1600), range(1600, 2000))
    assert len(sliding_folds(1000, 400, 200, 200)) == 3
    assert expanding_folds(10, 4, 2, 2) == [Fold(range(4), range(4, 6)), Fold(range(6), range(6, 8)), Fold(range(8), range(8, 10))]
    for bad in (lambda: temporal_fold(5, 1.5), lambda: sliding_folds(5, 0, 1, 1), lambda: expanding_folds(5, 1, 1, 0)):
        with pytest.raises(ValueError):
            bad()


def test_fold_frame_of_shuffled_rows(spark):
    rows = fold_frame(spark, [Fold([3, 1], [0])]).orderBy("arm", "pos").collect()
    assert [(r["arm"], r["pos"], r["t"]) for r in rows] == [("train", 0, 3), ("train", 1, 1), ("validation", 0, 0)]
    with pytest.raises(ValueError, match="non-empty"):
        fold_frame(spark, [])


def test_lorenz96_follows_its_equation():
    """Small steps change by the equation's right side; half a step errs by a sixteenth (fourth order)."""
    x = lorenz96(400, 6, 0, interval=0.001)
    rate = (np.roll(x, -1, axis=1) - np.roll(x, 2, axis=1)) * np.roll(x, 1, axis=1) - x + 8
    np.testing.assert_allclose((x[2:] - x[:-2]) / 0.002, rate[1:-1], atol=1e-3)
    ends = [lorenz96(20 << k, 6, 1, interval=0.02 / (1 << k))[-1] for k in range(3)]
    assert 12 < np.abs(ends[0] - ends[1]).max() / np.abs(ends[1] - ends[2]).max() < 20
    assert (lorenz96(30, 6, 5) == lorenz96(30, 6, 5)).all() and lorenz96(500, 6, 0).std() > 1


def test_ar1_columns():
    x = ar1_columns(20_000, 3, 4)
    slope = [np.corrcoef(c[:-1], c[1:])[0, 1] for c in x.T]
    assert all(0.17 < s < 0.83 for s in slope) and abs(np.std(x[1:, 0] - slope[0] * x[:-1, 0]) - 1) < 0.05


def test_columns_are_shuffled_and_found_again(spark):
    data, informative = lorenz96_dataset(spark, T=60, signal=3, noise=4, seed=2)
    rows = data.frame.orderBy("t").collect()
    x, y = (np.array([r[c] for r in rows]) for c in "xy")
    assert len(informative) == 3 and x.shape == (60, 7) and min(x[:, informative].mean(axis=0)) > np.delete(x, informative, axis=1).mean() + 1
    assert any(np.allclose(x[1:, j], y[:-1, 0]) for j in informative)


def test_time_steps_must_be_the_same(spark):
    X = spark.createDataFrame([(t, [1.0]) for t in range(5)], "t long, x array<double>")  # noqa: N806
    for steps in (range(1, 6), [0, 1, 2, 3, 3]):
        with pytest.raises(ValueError, match="same time steps"):
            Dataset(X, spark.createDataFrame([(t, 1.0) for t in steps], "t long, y double"))


@pytest.mark.parametrize("indices", [[0, 99, -1], [5], [-1], range(2, 9)])
def test_subset_indices_must_exist(spark, indices):
    d = Dataset.from_frame(spark.createDataFrame([(t, [1.0], [2.0]) for t in range(5)], "t long, x array<double>, y array<double>"))
    with pytest.raises(IndexError, match="between 0 and 4"):
        Subset(d, indices)
    assert len(Subset(d, [])) == 0 and len(Subset(d, range(5))) == 5


def test_zscore_of_other_width_fails(spark):
    f = spark.createDataFrame([(0, [1.0, 2.0], [1.0])], "t long, x array<double>, y array<double>")
    with pytest.raises(Exception, match="y must have 2 features, got 1"):
        zscore_normalize(f, target="both")(f).collect()
