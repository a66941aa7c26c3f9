"""Series, row views over them, folds and generated data."""

from .folds import Fold, expanding_folds, fold_frame, sliding_folds, temporal_fold
from .series import Dataset, Subset, horizon_shift
from .synthetic import ar1_columns, lorenz96, lorenz96_dataset

__all__ = [
    "Dataset", "Fold", "Subset", "ar1_columns", "expanding_folds", "fold_frame", "horizon_shift", "lorenz96", "lorenz96_dataset",
    "sliding_folds", "temporal_fold",
]
