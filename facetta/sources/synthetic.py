"""Generated series with a known answer: a Lorenz-96 system among autoregressive noise."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .series import Dataset


#: Classical fourth-order Runge-Kutta: where each stage looks ahead from the one before, and how much it counts.
STAGES = ((0.0, 1 / 6), (0.5, 1 / 3), (0.5, 1 / 3), (1.0, 1 / 6))


def lorenz96(steps: int, sites: int, seed: int | np.random.Generator, *, forcing: float = 8.0, interval: float = 0.05, jitter: float = 0.01) -> np.ndarray:
    """(steps, sites) states of the Lorenz (1996) ring, the first one an ``interval`` after a jittered rest state.

    On the ring a site is driven by the product of its left neighbour and the difference of its right neighbour and the
    one two to the left; it decays, and is forced evenly.
    """
    site = np.arange(sites)
    left, far_left, right = (site - 1) % sites, (site - 2) % sites, (site + 1) % sites
    out = np.empty((steps + 1, sites))
    out[0] = forcing + jitter * np.random.default_rng(seed).standard_normal(sites)
    for now, then in pairwise(out):
        then[:], rate = now, np.zeros(sites)
        for ahead, share in STAGES:
            at = now + ahead * interval * rate
            rate = at[left] * (at[right] - at[far_left]) + (forcing - at)
            then += share * interval * rate
    return out[1:]


def ar1_columns(steps: int, columns: int, seed: int | np.random.Generator, *, least: float = 0.2, most: float = 0.8) -> np.ndarray:
    """(steps, columns) independent first-order autoregressions with unit noise, coefficients drawn evenly."""
    rng = np.random.default_rng(seed)
    memory, out = rng.uniform(least, most, columns), rng.standard_normal((steps, columns))
    for before, now in pairwise(out):
        now += memory * before
    return out


def lorenz96_dataset(spark: SparkSession, *, T: int = 2000, signal: int = 6, noise: int = 18, seed: int = 0) -> tuple[Dataset, list[int]]:  # noqa: N803
    """Signal and noise columns in shuffled order, target: the next value of signal 0; and where the signal columns are.

    The recurrence is sequential, so it runs on the driver; the shuffle of columns is a DataFrame expression.
    """
    rng = np.random.default_rng(seed)
    s = lorenz96(T + 1, signal, rng)
    full = np.concatenate([s[:T], ar1_columns(T, noise, rng)], axis=1)
    order = rng.permutation(signal + noise).tolist()
    rows = [(i, full[i].tolist(), [float(s[i + 1, 0])]) for i in range(T)]
    frame = spark.createDataFrame(rows, "t long, x array<double>, y array<double>")
    shuffled = frame.withColumn("x", F.array(*[F.col("x")[k] for k in order]))
    return Dataset.from_frame(shuffled), sorted(order.index(k) for k in range(signal))
