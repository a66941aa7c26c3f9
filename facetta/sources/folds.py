"""Splits of a series into training and validation rows.

The kernel that the reference imports its folds from isn't part of it: rounding and signatures here are our choice.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import floor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fold:
    """Row numbers of the two arms; they may be shuffled, have gaps, and need not cover all rows."""

    train: Sequence[int]
    validation: Sequence[int]


def temporal_fold(n: int, ratio: float) -> Fold:
    """The first floor(n * ratio) rows for training, the rest for validation."""
    if not 0 < ratio < 1:
        raise ValueError(f"ratio must be between 0 and 1, got {ratio}")
    cut = floor(n * ratio + 1e-9)
    return Fold(range(cut), range(cut, n))


def sliding_folds(n: int, train_size: int, validation_size: int, stride: int) -> list[Fold]:
    """Windows of fixed size, each validated on the rows right after it."""
    _positive(train_size=train_size, validation_size=validation_size, stride=stride)
    starts = range(0, n - train_size - validation_size + 1, stride)
    return [Fold(range(s, s + train_size), range(s + train_size, s + train_size + validation_size)) for s in starts]


def expanding_folds(n: int, initial_size: int, validation_size: int, stride: int) -> list[Fold]:
    """A training window that grows by ``stride``, each time validated on the rows right after it."""
    _positive(initial_size=initial_size, validation_size=validation_size, stride=stride)
    ends = range(initial_size, n - validation_size + 1, stride)
    return [Fold(range(e), range(e, e + validation_size)) for e in ends]


def _positive(**sizes: int) -> None:
    for name, value in sizes.items():
        if value < 1:
            raise ValueError(f"{name} must be >= 1, got {value}")


def fold_frame(spark: SparkSession, folds: Sequence[Fold]) -> DataFrame:
    """``fold_id INT, arm STRING, pos BIGINT, t BIGINT``; a contiguous arm is a generated range, not a list."""
    out = None
    for k, fold in enumerate(folds):
        for arm in ("train", "validation"):
            rows = getattr(fold, arm)
            if isinstance(rows, range) and rows.step == 1:
                part = spark.range(len(rows)).select(F.col("id").alias("pos"), (F.col("id") + rows.start).alias("t"))
            else:
                part = spark.createDataFrame([(i, int(t)) for i, t in enumerate(rows)], "pos long, t long")
            part = part.select(F.lit(k).alias("fold_id"), F.lit(arm).alias("arm"), "pos", "t")
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("folds must be non-empty")
    return out
