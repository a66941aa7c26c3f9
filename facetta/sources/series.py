"""A series is a DataFrame ``t BIGINT, x ARRAY<FLOAT>, y ARRAY<FLOAT>``: candidate columns and targets by time step."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from threading import Lock

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Transform = Callable[[DataFrame], DataFrame]


def _depth(kind: T.DataType) -> int:
    n = 0
    while isinstance(kind, T.ArrayType):
        kind, n = kind.elementType, n + 1
    if not isinstance(kind, T.NumericType):
        raise ValueError(f"series must be numeric, got {kind.simpleString()}")
    return n


class Dataset:
    """A series with an optional transform that applies to single samples only.

    ``X`` has ``t`` and ``x`` (an array: one value per column), ``Y`` has ``t`` and ``y`` (an array, or a number, which
    becomes an array of one). Both have the same time steps; values are stored as float32. Bad shapes raise ValueError.
    """

    def __init__(self, X: DataFrame, Y: DataFrame, *, transform: Transform | None = None):
        nx, ny = _depth(X.schema["x"].dataType), _depth(Y.schema["y"].dataType)
        if nx != 1:
            raise ValueError(f"X must be 2-D (an array per row), got {nx + 1}-D")
        if ny > 1:
            raise ValueError(f"Y must be 1-D or 2-D (a number or an array per row), got {ny + 1}-D")
        y = F.col("y") if ny else F.array("y")
        a = X.select(F.col("t").cast("long").alias("t"), F.col("x").cast("array<float>").alias("x"))
        b = Y.select(F.col("t").cast("long").alias("t"), y.cast("array<float>").alias("y"))
        na, nb, both = a.count(), b.count(), a.join(b, "t")
        if na != nb:
            raise ValueError(f"X and Y must have the same length, got {na} and {nb}")
        met, steps = both.agg(F.count(F.lit(1)), F.count_distinct("t")).first()
        if met != na or steps != na:
            raise ValueError(f"X and Y must have the same time steps, each once, but {na} rows of each meet in {met}, at {steps} steps")
        self._open(both, transform, na)

    def _open(self, frame: DataFrame, transform: Transform | None, rows: int | None = None) -> None:
        self.frame, self.transform, self._rows, self._widths = frame, transform, rows, None
        self._matrices, self._lock = None, Lock()

    @classmethod
    def from_frame(cls, frame: DataFrame, *, transform: Transform | None = None) -> Dataset:
        """From one frame with ``t``, ``x`` and ``y``: nothing has to be joined or counted."""
        nx, ny = _depth(frame.schema["x"].dataType), _depth(frame.schema["y"].dataType)
        if nx != 1:
            raise ValueError(f"X must be 2-D (an array per row), got {nx + 1}-D")
        if ny > 1:
            raise ValueError(f"Y must be 1-D or 2-D (a number or an array per row), got {ny + 1}-D")
        y = F.col("y") if ny else F.array("y")
        own = cls.__new__(cls)
        own._open(
            frame.select(F.col("t").cast("long").alias("t"), F.col("x").cast("array<float>").alias("x"), y.cast("array<float>").alias("y")), transform
        )
        return own

    @property
    def X(self) -> DataFrame:
        return self.frame.select("t", "x")

    @property
    def Y(self) -> DataFrame:
        return self.frame.select("t", "y")

    @property
    def widths(self) -> tuple[int, int]:
        """Number of columns of X and of Y."""
        if self._widths is None:
            row = self.frame.select(F.size("x"), F.size("y")).first()
            self._widths = (row[0], row[1]) if row else (0, 0)
        return self._widths

    def __len__(self) -> int:
        if self._rows is None:
            self._rows = self.frame.count()
        return self._rows

    def matrices(self) -> Broadcast:
        """``x``, ``y`` and ``t`` in order of ``t`` as arrays on every executor, fetched once: for a series that may be broadcast."""
        with self._lock:
            if self._matrices is None:
                got = self.frame.orderBy("t").toArrow()
                x, y = (np.stack(got.column(c).combine_chunks().to_numpy(zero_copy_only=False)).astype(float) if got.num_rows else np.zeros((0, 0)) for c in ("x", "y"))
                self._matrices = self.frame.sparkSession.sparkContext.broadcast((x, y, got.column("t").to_numpy()))
        return self._matrices

    def sample(self, index: int) -> DataFrame:
        """One row, transformed."""
        row = self.frame.where(F.col("t") == index)
        return self.transform(row) if self.transform else row

    def __getitem__(self, index: int):
        row = self.sample(index).first()
        if row is None:
            raise IndexError(index)
        return row["x"], row["y"]


class Subset(Dataset):
    """The rows of a dataset at ``indices``, in that order; a row's time becomes its place among the indices.

    An index may come twice; one outside the dataset is an IndexError at once. A ``range`` of step 1 is a filter; other
    indices are a join on time.
    """

    def __init__(self, dataset: Dataset, indices: Sequence[int]):
        self.dataset, self.indices = dataset, indices
        if len(indices):
            low, high, n = min(indices), max(indices), len(dataset)
            if low < 0 or high >= n:
                raise IndexError(f"indices must be between 0 and {n - 1}, got {low} to {high}")
        parent = dataset.frame
        if isinstance(indices, range) and indices.step == 1:
            inside = parent.where((F.col("t") >= indices.start) & (F.col("t") < indices.stop))
            frame = inside.withColumn("t", F.col("t") - F.lit(indices.start))
        else:
            rows = [(int(t), pos) for pos, t in enumerate(indices)]
            place = parent.sparkSession.createDataFrame(rows, "t long, pos long")
            frame = parent.join(place, "t").select(F.col("pos").alias("t"), "x", "y")
        self._open(frame, dataset.transform, len(indices))

    def sample(self, index: int) -> DataFrame:
        if not 0 <= index < len(self.indices):
            raise IndexError(index)
        return self.dataset.sample(int(self.indices[index])).withColumn("t", F.lit(index).cast("long"))


def horizon_shift(frame: DataFrame, steps: int) -> DataFrame:
    """``t``, ``x`` and the ``y`` of ``steps`` later; the last ``steps`` rows go. Do this before splitting into folds.

    A join on time, not a window over all rows: the series may have any length.
    """
    if steps < 0:
        raise ValueError(f"steps must be non-negative, got {steps}")
    later = frame.select((F.col("t") - steps).alias("t"), "y")
    return frame.select("t", "x").join(later, "t")
