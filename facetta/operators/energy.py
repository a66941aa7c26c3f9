"""Energies: the score of a state, lower is better.

An energy maps a frame with ``sid``, ``state`` and ``context`` to the same frame with ``energy`` and the new ``context``.
There are two engines. ``columns`` writes prediction and metric as DataFrame operations, over rows of any number.
``arrow`` sends batches of states to numpy functions on the executors, with the series broadcast; user predictors and
metrics need it, and it is used by default where the series is small enough to broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import Metric
from ..sources.folds import Fold, fold_frame
from ..sources.series import Dataset
from ..work import BROADCAST_BYTES
from .kernel import loo_predictions, simplex_predictions
from .predictors import simplex, simplex_loo

ENGINES = ("auto", "columns", "arrow")


class Energy:
    """Scores frames of states; ``initial_context`` is the context of a search's first state."""

    def __init__(
        self,
        data: Dataset,
        metric: Metric | Callable,
        *,
        folds: Sequence[Fold] | None,
        predict: Callable | None = None,
        weight: Callable | None = None,
        theiler: int = 0,
        within: bool = False,
        batch_size: int = 10_000,
        engine: str = "auto",
    ):
        if batch_size < 1:
            raise ValueError(f"batch_size must be >= 1, got {batch_size}")
        if engine not in ENGINES:
            raise ValueError(f"engine must be one of {ENGINES}, got {engine!r}")
        self.data, self.metric, self.folds, self.predict, self.weight = data, metric, folds, predict, weight
        self.theiler, self.within, self.batch_size = theiler, within, batch_size
        columnar = isinstance(metric, Metric) and (predict is None or predict is simplex)
        if engine == "columns" and not columnar:
            raise ValueError("engine 'columns' needs a built-in predictor and metric")
        self.engine = engine
        self._columnar = columnar
        self._arms = self._places = None
        self.initial_context = [0.0] * len(folds) if weight is not None else []

    def _fits(self) -> bool:
        """Whether the series is small enough to broadcast to Python workers."""
        return len(self.data) * sum(self.data.widths) * 8 <= BROADCAST_BYTES

    def __call__(self, states: DataFrame, *, size: int | None = None, count: int | None = None, mixed: bool = False) -> DataFrame:
        """``states`` with ``energy`` and the new ``context``.

        States must be valid and of one length, or with ``mixed`` of any. A search that made them itself gives their
        ``size``, and how many there are at most: then they aren't looked at.
        """
        engine = self.engine
        if engine == "auto":
            engine = "arrow" if self._fits() or not self._columnar else "columns"
        if engine == "arrow" and not self._fits():
            raise ValueError(f"the series is too large for engine 'arrow': over {BROADCAST_BYTES} bytes")
        dx, dy = self.data.widths
        if self.within and dy < dx:
            raise ValueError(f"within-energies need a target column per series column, got {dy} for {dx}")
        score = self._columns if engine == "columns" else self._arrow
        if size is not None and count is not None:
            return score(states, size, count)
        shape = states.agg(
            F.min(F.size("state")).alias("d"),
            F.max(F.size("state")).alias("most"),
            F.min(F.array_min("state")).alias("low"),
            F.max(F.array_max("state")).alias("high"),
            F.count(F.when(F.size("state") != F.size(F.array_distinct("state")), 1)).alias("twice"),
            F.count(F.lit(1)).alias("n"),
        ).first()
        if shape["d"] is None:
            return states.withColumn("energy", F.lit(0.0)).select(*states.columns, "energy")
        if shape["d"] != shape["most"] and not mixed:
            raise ValueError(f"states must have the same length, got {shape['d']} and {shape['most']}")
        if shape["d"] < 1 or shape["low"] < 0 or shape["high"] >= dx or shape["twice"]:
            raise ValueError(f"states must hold different column numbers from 0 to {dx - 1}, at least one")
        return score(states, shape["most"], shape["n"])

    # DataFrame engine

    def _fold_rows(self) -> tuple[DataFrame, DataFrame]:
        if self._arms is None:
            rows = fold_frame(self.data.frame.sparkSession, self.folds)
            joined = rows.join(self.data.frame, "t").select("fold_id", "arm", "pos", "x", "y")
            self._arms = tuple(joined.where(F.col("arm") == arm).drop("arm") for arm in ("validation", "train"))
        return self._arms

    def _columns(self, states: DataFrame, d: int, count: int) -> DataFrame:
        size = {"rows": len(self.data), "width": sum(self.data.widths), "count": count, "within": self.within}
        if self.folds is None:
            rows = loo_predictions(states, self.data.frame, d, theiler=self.theiler, **size)
        else:
            rows = simplex_predictions(states, *self._fold_rows(), d, folds=len(self.folds), **size)
        scores = self.metric.aggregate(rows, ["sid", "fold_id"])
        nan = F.lit(float("nan"))
        if self.weight is None:
            own = scores.select(F.col("sid").alias("__sid"), F.coalesce("value", nan).alias("energy"))
            out = states.join(own, F.col("sid") == F.col("__sid"), "left").drop("__sid")
            return out.withColumn("energy", F.coalesce("energy", nan)).withColumn("context", F.array().cast("array<double>"))
        listed = F.array_sort(F.collect_list(F.struct("fold_id", F.coalesce("value", nan).alias("m"))))
        own = scores.groupBy(F.col("sid").alias("__sid")).agg(F.transform(listed, lambda s: s.m).alias("__m"))
        out = states.join(own, F.col("sid") == F.col("__sid"), "left")
        change = F.zip_with(self.weight(F.col("context")), F.zip_with("__m", "context", lambda m, c: m - c), lambda w, x: w * x)
        total = F.coalesce(F.aggregate(change, F.lit(0.0), lambda a, v: a + v), nan)
        return out.withColumn("energy", total).withColumn("context", F.col("__m")).drop("__sid", "__m")

    # Arrow engine

    def _fold_places(self):
        """The folds' rows by their places in the broadcast series."""
        if self._places is None and self.folds is not None:
            at = {int(v): i for i, v in enumerate(self.data.matrices().value[2])}
            arms = [tuple(np.array([at[int(i)] for i in rows], int) for rows in (f.train, f.validation)) for f in self.folds]
            self._places = self.data.frame.sparkSession.sparkContext.broadcast(arms)
        return self._places

    def _arrow(self, states: DataFrame, d: int, count: int) -> DataFrame:
        shared, places, predict, metric, weight = self.data.matrices(), self._fold_places(), self.predict or simplex, self.metric, self.weight
        theiler, within = self.theiler, self.within
        # A batch's states hold their columns and targets, however long the series.
        batch = max(1, min(self.batch_size, BROADCAST_BYTES // max(1, len(self.data) * (d + self.data.widths[1]) * 8)))

        def score(idx: np.ndarray, context: np.ndarray):
            x, y, _ = shared.value
            arms = places.value if places else None
            X = x[:, idx].transpose(1, 0, 2)  # noqa: N806
            Y = y[:, idx].transpose(1, 0, 2) if within else np.broadcast_to(y, (len(idx), *y.shape))  # noqa: N806
            if arms is None:
                m = np.asarray(metric(simplex_loo(X, Y, theiler_window=theiler), Y))[:, None]
            else:
                m = np.stack([np.asarray(metric(predict(X[:, tr], Y[:, tr], X[:, va]), Y[:, va])) for tr, va in arms], axis=1)
            if weight is None:
                return m[:, 0], np.zeros((len(idx), 0))
            return (weight(context) * (m - context)).sum(axis=1), m

        names = states.columns
        at_state, at_context = names.index("state"), names.index("context")

        def by_length(b: pa.RecordBatch):
            sizes = np.diff(b.column(at_state).offsets.to_numpy())
            return (b.take(pa.array(np.flatnonzero(sizes == n))) for n in np.unique(sizes))

        def apply(batches):
            for whole in (part for b in batches for part in by_length(b)):
                for start in range(0, whole.num_rows, batch):
                    b = whole.slice(start, batch)
                    idx = np.array(b.column(at_state).to_pylist(), int).reshape(b.num_rows, -1)
                    context = np.array(b.column(at_context).to_pylist(), float).reshape(b.num_rows, -1)
                    energy, after = score(idx, context)
                    columns = list(b.columns)
                    columns[at_context] = pa.array(list(after), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.asarray(energy, float), from_pandas=False)], names=[*names, "energy"])

        kinds = dict(states.dtypes)
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", energy double"
        tasks = max(1, min(count, states.sparkSession.sparkContext.defaultParallelism))
        return states.repartition(tasks, "sid").mapInArrow(apply, schema)
