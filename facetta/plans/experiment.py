"""Experiments: search on the training rows, validation of each step on rows held out, sweeps."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import CORR, Metric
from ..operators import cross
from ..operators.neighborhood import forward
from ..operators.predictors import simplex
from ..sources.folds import Fold, temporal_fold
from ..sources.series import Dataset, Subset
from .strategy import Frontier, beam, greedy, initial_frontier, trace_frame


def validate_trace(trace: DataFrame, data: Dataset, fold: Fold, *, predict: Callable = simplex, metric=CORR, engine: str = "auto") -> DataFrame:
    """``trace`` (depth, state, energy) with ``validation``: each state fitted on all of the fold's training rows, all
    depths in one pass."""
    states = trace.select(F.col("depth").cast("long").alias("sid"), "state", F.array().cast("array<double>").alias("context"))
    _, energy = cross.holdout(data=data, fold=fold, predict=predict, metric=metric, engine=engine)
    scored = energy(states, mixed=True).select(F.col("sid").cast("int").alias("depth"), F.col("energy").cast("double").alias("validation"))
    return trace.join(F.broadcast(scored), "depth")  # a row a depth


def best_step(validated: DataFrame) -> DataFrame:
    """The depth of least validation loss, the first on ties."""
    return validated.agg(F.min_by("depth", F.struct("validation", "depth")).alias("best_step"), F.min("validation").alias("validation"))


def recovery_count(validated: DataFrame, informative: Sequence[int]) -> DataFrame:
    """How many of the ``informative`` columns each step has selected."""
    known = F.array(*[F.lit(int(i)).cast("long") for i in informative]).cast("array<bigint>")
    return validated.select("depth", F.size(F.array_intersect("state", known)).alias("recovered"))


def subset_search(
    data: Dataset, *, depth: int, outer: float = 0.8, inner: float = 0.75, width: int = 1, beams: int = 1, seed: int = 0, metric: Metric = CORR, engine: str = "auto"
) -> DataFrame:
    """Two-level search: folds of the training rows steer it, the rows held out validate it.

    ``depth``, ``state``, ``context``, ``energy``, ``validation``.
    """
    spark = data.frame.sparkSession
    outside = temporal_fold(len(data), outer)
    train = Subset(data, outside.train)
    context, energy = cross.holdout(data=train, fold=temporal_fold(len(train), inner), predict=simplex, metric=metric, engine=engine)
    strategy = beam(energy, forward(data.widths[0]), width=width, depth=depth, beams=beams)
    trace = trace_frame(list(strategy(initial_frontier(spark, context), seed)), spark)
    return validate_trace(trace, data, outside, metric=metric, engine=engine)


def sweep(
    data: Dataset, *, metrics: Sequence[Metric], energies: dict[str, Callable[[Dataset, Metric], tuple]], strategies: dict[str, Callable], outer: float = 0.8, seed: int = 0,
    threads: int = 8,
) -> DataFrame:
    """Every metric with every energy and strategy on the same outer fold and seed, ``threads`` searches at a time.

    ``energies`` map a name to (training data, metric) -> (context, energy), ``strategies`` a name to (energy,
    neighborhood) -> strategy. Rows: metric, energy, strategy, step, selected, train, validation.
    """
    spark = data.frame.sparkSession
    outside = temporal_fold(len(data), outer)
    train = Subset(data, outside.train)
    sizes = len(train), train.widths  # known before threads ask for them

    def run(trial) -> DataFrame:
        metric, (energy_name, build), (strategy_name, make) = trial
        context, energy = build(train, metric)
        found: list[Frontier] = list(make(energy, forward(sizes[1][0]))(initial_frontier(spark, context), seed))
        checked = validate_trace(trace_frame(found, spark), data, outside, metric=metric)
        return checked.select(
            F.lit(metric.name).alias("metric"), F.lit(energy_name).alias("energy"), F.lit(strategy_name).alias("strategy"), F.col("depth").alias("step"),
            F.col("state").alias("selected"), F.col("energy").alias("train"), "validation",
        )

    trials = list(product(metrics, energies.items(), strategies.items()))
    with ThreadPoolExecutor(threads) as pool:
        return reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(spark)(run), trials))


__all__ = ["best_step", "greedy", "recovery_count", "subset_search", "sweep", "validate_trace"]
