"""Energies whose target is the fixed targets Y. Each builder gives the first state's context and the energy."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from ..sources.folds import Fold
from ..sources.series import Dataset
from .energy import Energy


def holdout(*, data: Dataset, fold: Fold, predict: Callable, metric: Callable, batch_size: int = 10_000, engine: str = "auto"):
    """The metric on one fold's validation rows."""
    own = Energy(data, metric, folds=[fold], predict=predict, within=False, batch_size=batch_size, engine=engine)
    return own.initial_context, own


def folds(
    *, data: Dataset, folds: Sequence[Fold], predict: Callable, metric: Callable, weight: Callable, batch_size: int = 10_000, engine: str = "auto"
):
    """The weighted change of the folds' metrics against the parent's; the metrics are the new context."""
    if len(folds) == 0:
        raise ValueError("folds must be non-empty")
    own = Energy(data, metric, folds=list(folds), predict=predict, weight=weight, within=False, batch_size=batch_size, engine=engine)
    return own.initial_context, own


def loo(*, data: Dataset, metric: Callable, theiler_window: int = 0, batch_size: int = 10_000, engine: str = "auto"):
    """The metric of predicting each row from all others over ``theiler_window`` rows away."""
    if theiler_window < 0:
        raise ValueError(f"theiler_window must be non-negative, got {theiler_window}")
    own = Energy(data, metric, folds=None, theiler=theiler_window, within=False, batch_size=batch_size, engine=engine)
    return own.initial_context, own
