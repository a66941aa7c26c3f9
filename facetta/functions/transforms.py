"""Transforms of samples: functions of a frame with ``x`` and ``y`` arrays."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keyed import normal

Transform = Callable[[DataFrame], DataFrame]
LEAST_STD = 1e-8


def zscore_normalize(data: DataFrame, *, target: str, column: str = "x") -> Transform:
    """Standardise ``x``, ``y`` or ``both`` by the mean and population standard deviation of each feature of ``data``.

    ``data`` holds an array a row in ``column``, or arrays of arrays, whose leading axes all count as rows. The statistics
    are taken once, now, and kept as float32; a standard deviation is 1e-8 at least.
    """
    if target not in ("x", "y", "both"):
        raise ValueError(f"target must be 'x', 'y' or 'both', got {target!r}")
    rows, kind = data.select(F.col(column).alias("v")), data.schema[column].dataType
    while isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
        rows, kind = rows.select(F.explode("v").alias("v")), kind.elementType
    each = rows.select(F.posexplode(F.col("v").cast("array<double>")).alias("k", "v"))
    stats = each.groupBy("k").agg(F.avg("v").cast("float").alias("mean"), F.stddev_pop("v").cast("float").alias("std")).collect()  # a row a feature
    mean = [float(r["mean"]) for r in sorted(stats, key=lambda r: r["k"])]
    std = [max(float(r["std"]), LEAST_STD) for r in sorted(stats, key=lambda r: r["k"])]

    def apply(frame: DataFrame) -> DataFrame:
        for name in ("x", "y") if target == "both" else (target,):
            scale = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(s).alias("s")) for m, s in zip(mean, std)])
            scaled = F.zip_with(F.col(name), scale, lambda v, c: ((v.cast("double") - c.m) / c.s).cast("float"))
            wrong = F.raise_error(F.concat(F.lit(f"{name} must have {len(mean)} features, got "), F.size(name).cast("string")))
            frame = frame.withColumn(name, F.when(F.size(name) == len(mean), scaled).otherwise(wrong))
        return frame

    return apply


def gaussian_noise(sigma: float = 0.1, seed: int | None = None) -> Transform:
    """Add normal noise to ``x``; ``y`` stays. Each use draws anew; a seed makes the sequence of draws repeatable."""
    if seed is None:
        import secrets

        seed = secrets.randbits(62)
    draws = count()

    def apply(frame: DataFrame) -> DataFrame:
        draw = next(draws)
        noisy = F.transform("x", lambda v, k: (v.cast("double") + sigma * normal(seed, draw, F.col("t"), k)).cast("float"))
        return frame.withColumn("x", noisy)

    return apply


def compose(*transforms: Transform) -> Transform:
    """One after the other, from left to right; none at all changes nothing."""

    def apply(frame: DataFrame) -> DataFrame:
        for t in transforms:
            frame = t(frame)
        return frame

    return apply


def mask_columns(mask: Sequence[bool]) -> Transform:
    """Keep the columns of ``x`` whose mask is true, renumbered."""
    kept = [i for i, keep in enumerate(mask) if keep]
    return lambda frame: frame.withColumn("x", F.array(*[F.get("x", F.lit(i)) for i in kept]).cast("array<float>"))
