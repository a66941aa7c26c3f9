"""Lag embedding and the scan over its dimension and lag.

The scan's inner split isn't shown in the reference: ours is the first 80 % of rows against the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import MEAN_RHO, Metric
from ..sources.folds import Fold, fold_frame, temporal_fold
from ..sources.series import Dataset
from ..work import BROADCAST_BYTES
from .kernel import simplex_predictions
from .predictors import simplex

SCAN_RATIO = 0.8


def lag_embed(frame: DataFrame, *, E: int, tau: int, column: str = "v") -> DataFrame:  # noqa: N803
    """``t`` and ``x`` = [v(t), v(t - tau), ..., v(t - (E - 1) tau)]; rows without a full past go.

    Each row sends its value to the E times that need it, and these are gathered by time: one shuffle, whatever E.
    """
    if E < 1 or tau < 1:
        raise ValueError(f"E and tau must be >= 1, got {E} and {tau}")
    sent = frame.select("t", F.col(column).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(E - 1))).alias("k"))
    met = sent.groupBy((F.col("t") + F.col("k") * tau).alias("t")).agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("all"))
    return met.where(F.size("all") == E).select("t", F.transform("all", lambda s: s.v.cast("float")).alias("x"))


def lag_history(frame: DataFrame, longest: int) -> DataFrame:
    """``t``, ``y`` and ``past``: the ``x`` of up to ``longest`` steps back, the own one first."""
    sent = frame.select("t", "x", F.explode(F.sequence(F.lit(0), F.lit(longest))).alias("k"))
    met = sent.groupBy((F.col("t") + F.col("k")).alias("t")).agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("past"))
    own = frame.select(F.col("t").alias("__t"), "y")
    return met.join(own, F.col("t") == F.col("__t")).select("t", "y", F.transform("past", lambda s: s.x).alias("past"))


def scan(
    frame: DataFrame, *, E: Sequence[int], tau: Sequence[int], columns: Sequence[int], metric: Metric = MEAN_RHO, fold: Callable[[int], Fold] | None = None, engine: str = "auto"  # noqa: N803
) -> DataFrame:
    """``col``, ``E``, ``tau``, ``score`` of single-column lag embeddings as predictors of ``y``.

    ``frame`` has ``t`` (0 to n - 1), ``x``, ``y``. Rows are numbered anew after embedding, then split by ``fold``. Grids
    of any size are one plan. With engine ``arrow``, the default for a series that may be broadcast, cells are dealt to
    tasks that embed and predict in numpy; ``columns`` embeds all cells in one table and takes one top-k over it.
    """
    spark, n = frame.sparkSession, frame.count()
    shape = frame.select(F.size("x"), F.size("y")).first()
    width = sum(shape) if shape else 0
    cells = [(int(c), int(e), int(lag)) for e in E for lag in tau for c in columns if n - (e - 1) * lag >= 3]
    if engine not in ("auto", "arrow", "columns"):
        raise ValueError(f"engine must be auto, arrow or columns, got {engine!r}")
    if not cells:
        return spark.createDataFrame([], "col int, E int, tau int, score double")
    grid = spark.createDataFrame([(i, *cell) for i, cell in enumerate(cells)], "cell long, col int, E int, tau int")
    split = fold or (lambda rows: temporal_fold(rows, SCAN_RATIO))
    if engine == "arrow" or (engine == "auto" and n * width * 8 <= BROADCAST_BYTES):
        return _scan_arrays(frame, grid, metric, split, len(cells))
    return _scan_rows(frame, grid, metric, {n - (e - 1) * lag: split(n - (e - 1) * lag) for _, e, lag in cells}, n, max(e for _, e, _ in cells), max((e - 1) * lag for _, e, lag in cells), len(cells))


def _scan_arrays(frame: DataFrame, grid: DataFrame, metric: Metric, split: Callable[[int], Fold], cells: int) -> DataFrame:
    spark = frame.sparkSession
    got = frame.orderBy("t").select(F.col("x").cast("array<float>"), F.col("y").cast("array<float>")).toArrow()  # at most BROADCAST_BYTES
    shared = spark.sparkContext.broadcast(tuple(np.stack(got.column(c).combine_chunks().to_numpy(zero_copy_only=False)).astype(float) for c in (0, 1)))

    def apply(batches):
        x, y = shared.value
        for b in batches:
            scores = []
            for col, e, lag in zip(*(b.column(k).to_pylist() for k in (1, 2, 3))):
                first = (e - 1) * lag
                past = np.stack([x[first - k * lag : len(x) - k * lag, col] for k in range(e)], axis=1)
                arms = split(len(past))
                train, held = (np.asarray(a, int) for a in (arms.train, arms.validation))
                pred = simplex(past[None, train], y[None, first:][:, train], past[None, held])
                score = float(metric(pred, y[None, first:][:, held])[0])
                scores.append(None if np.isnan(score) else score)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in (1, 2, 3)), pa.array(scores, pa.float64())], names=["col", "E", "tau", "score"])

    tasks = min(cells, 4 * spark.sparkContext.defaultParallelism)
    return grid.repartition(tasks, "cell").mapInArrow(apply, "col int, E int, tau int, score double")


def _scan_rows(frame: DataFrame, grid: DataFrame, metric: Metric, folds: dict[int, Fold], n: int, widest: int, longest: int, cells: int) -> DataFrame:
    spark = frame.sparkSession
    lengths = list(folds)
    arms = fold_frame(spark, [folds[r] for r in lengths]).withColumnRenamed("t", "at")
    number = F.create_map(*[F.lit(v) for i, r in enumerate(lengths) for v in (r, i)])
    first = (F.col("E") - 1) * F.col("tau")
    cell = grid.select("cell", "col", "E", "tau", first.cast("long").alias("first"), F.element_at(number, F.lit(n) - first).alias("fold_id"))
    lags = F.transform(F.sequence(F.lit(0), F.col("E") - 1), lambda k: F.get(F.get("past", k * F.col("tau")), F.col("col")).cast("float"))
    each = lag_history(frame, longest).crossJoin(F.broadcast(cell)).where(F.col("t") >= F.col("first"))
    rows = each.select("cell", "fold_id", (F.col("t") - F.col("first")).alias("at"), lags.alias("x"), "y").join(F.broadcast(arms), ["fold_id", "at"])
    rows = rows.select(F.col("cell").cast("int").alias("fold_id"), "arm", "pos", "x", "y")
    sides = [rows.where(F.col("arm") == a).drop("arm") for a in ("validation", "train")]
    states = grid.select(F.col("cell").alias("sid"), F.col("cell").cast("int").alias("fold_id"), F.sequence(F.lit(0).cast("long"), (F.col("E") - 1).cast("long")).alias("state"))
    scored = metric.aggregate(simplex_predictions(states, *sides, widest, rows=n * cells, width=widest + 1, count=cells), ["sid"])
    out = grid.join(F.broadcast(scored), F.col("cell") == F.col("sid"))
    return out.select("col", "E", "tau", F.when(~F.isnan("value"), F.col("value")).alias("score"))


def select_best(scores: DataFrame) -> DataFrame:
    """Each column's best score; ties go to the smaller E, then the smaller tau."""
    order = F.struct(-F.col("score"), "E", "tau")
    known = scores.where(F.col("score").isNotNull())
    return known.groupBy("col").agg(F.min_by(F.struct("E", "tau", "score"), order).alias("b")).select("col", "b.*")


def prefilter(scores: DataFrame, threshold: float = 0.1) -> DataFrame:
    """The columns whose best score is over ``threshold``."""
    return select_best(scores).where(F.col("score") > threshold)


def embedded_dataset(frame: DataFrame, *, column: int, E: int, tau: int) -> Dataset:  # noqa: N803
    """A dataset whose columns are one column's lags."""
    own = lag_embed(frame.select("t", F.get("x", F.lit(column)).alias("v")), E=E, tau=tau)
    return Dataset.from_frame(own.join(frame.select("t", "y"), "t").withColumn("t", F.col("t") - (E - 1) * tau))
