"""Metrics of predictions, as aggregates over (state, fold, time, target) rows and as numpy functions of (B, T, D) arrays.

rmse pools over targets; mean_rho averages the targets' correlations. A target without variance has no correlation, and
then neither has the state.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    name: str
    aggregate: Callable[[DataFrame, list[str]], DataFrame]
    compute: Callable[[np.ndarray, np.ndarray], np.ndarray]

    def __call__(self, pred: np.ndarray, obs: np.ndarray) -> np.ndarray:
        return self.compute(pred, obs)


def _pooled(column) -> Callable[[DataFrame, list[str]], DataFrame]:
    return lambda rows, keys: rows.groupBy(*keys).agg(column().alias("value"))


def _rho(loss: bool) -> Callable[[DataFrame, list[str]], DataFrame]:
    def aggregate(rows: DataFrame, keys: list[str]) -> DataFrame:
        spread = F.stddev_pop("pred") * F.stddev_pop("obs")
        each = rows.groupBy(*keys, "target").agg(F.try_divide(F.covar_pop("pred", "obs"), spread).alias("rho"))
        mean = F.when(F.count("rho") == F.count(F.lit(1)), F.avg("rho"))
        return each.groupBy(*keys).agg((1 - mean if loss else mean).alias("value"))

    return aggregate


def _np_rho(pred: np.ndarray, obs: np.ndarray) -> np.ndarray:
    a, b = pred - pred.mean(axis=-2, keepdims=True), obs - obs.mean(axis=-2, keepdims=True)
    spread = np.sqrt((a * a).sum(axis=-2) * (b * b).sum(axis=-2))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(spread > 0, (a * b).sum(axis=-2) / spread, np.nan).mean(axis=-1)


MAE = Metric("mae", _pooled(lambda: F.avg(F.abs(F.col("pred") - F.col("obs")))), lambda p, o: np.abs(p - o).mean(axis=(-2, -1)))
RMSE = Metric("rmse", _pooled(lambda: F.sqrt(F.avg((F.col("pred") - F.col("obs")) ** 2))), lambda p, o: np.sqrt(((p - o) ** 2).mean(axis=(-2, -1))))
MEAN_RHO = Metric("mean_rho", _rho(False), _np_rho)
#: The loss that goes with mean_rho.
CORR = Metric("corr", _rho(True), lambda p, o: 1 - _np_rho(p, o))
