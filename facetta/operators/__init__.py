"""Nearest-neighbour prediction, energies, expansion of states, lag embedding."""

from . import cross, within
from .embedding import lag_embed, scan, select_best
from .energy import Energy
from .kernel import loo_predictions, simplex_predictions
from .neighborhood import enumerate_states, expand, forward
from .predictors import simplex, smap

__all__ = [
    "Energy", "cross", "enumerate_states", "expand", "forward", "lag_embed", "loo_predictions", "scan", "select_best", "simplex",
    "simplex_predictions", "smap", "within",
]
