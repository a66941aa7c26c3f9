"""Column functions: keyed random numbers, transforms, metrics, weights."""

from .keyed import hash48, normal, uniform
from .metrics import CORR, MAE, MEAN_RHO, RMSE, Metric
from .transforms import compose, gaussian_noise, mask_columns, zscore_normalize
from .weights import softmax

__all__ = [
    "CORR", "MAE", "MEAN_RHO", "RMSE", "Metric", "compose", "gaussian_noise", "hash48", "mask_columns", "normal", "softmax", "uniform",
    "zscore_normalize",
]
