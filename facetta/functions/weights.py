"""Weights of folds from a state's context."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Softmax:
    """Attention to the folds of greater loss: as a Column function of an array, or of an (N, K) numpy array."""

    def __init__(self, temperature: float = 1.0):
        if not temperature > 0:
            raise ValueError(f"temperature must be positive, got {temperature}")
        self.temperature = temperature

    def __call__(self, context):
        if isinstance(context, Column):
            raised = F.transform(context, lambda v: F.exp((v - F.array_max(context)) / self.temperature))
            total = F.aggregate(raised, F.lit(0.0), lambda a, v: a + v)
            return F.transform(raised, lambda v: v / total)
        z = np.asarray(context, float) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def softmax(temperature: float = 1.0) -> Callable:
    return Softmax(temperature)
