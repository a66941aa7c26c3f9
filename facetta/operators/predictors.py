"""Predictors over batches of states as numpy functions: (B, L, d), (B, L, D), (B, M, d) arrays to (B, M, D)."""

from __future__ import annotations

import numpy as np

from .kernel import LEAST_DISTANCE, LEAST_WEIGHT
from .nearest import distances, nearest

#: Weights of an S-map that are held at once, and the least ratio of eigenvalues at which the normal equations are precise enough.
CELLS, SOUND = 1 << 20, 1e-6


def _project(dist: np.ndarray, row: np.ndarray, Y: np.ndarray) -> np.ndarray:  # noqa: N803
    if not len(Y):
        return np.full((len(dist), Y.shape[1]), np.nan)
    with np.errstate(invalid="ignore"):  # a query without neighbours has no prediction
        w = np.maximum(np.exp(-dist / np.maximum(dist[:, :1], LEAST_DISTANCE)), LEAST_WEIGHT)
        none = ~np.isfinite(dist)  # excluded rows
        w[none], y = 0, Y[row]
        y[none] = 0
        return np.einsum("mk,mkd->md", w, y) / w.sum(axis=1, keepdims=True)


def _batched(one, *arrays):
    """Apply to each state; 2-D input is a batch of one."""
    if arrays[0].ndim == 2:
        return one(*arrays)
    return np.stack([one(*a) for a in zip(*arrays)]) if len(arrays[0]) else np.zeros((0, arrays[-1].shape[1], arrays[1].shape[2]))


def simplex(X, Y, Q, *, mask=None):  # noqa: N803
    """Simplex projection. ``mask`` (L,) keeps the library rows where it's true."""
    X, Y, Q = (np.asarray(a, float) for a in (X, Y, Q))
    if mask is not None:
        X, Y = X[..., mask, :], Y[..., mask, :]
    return _batched(lambda x, y, q: _project(*nearest(x, q, x.shape[1] + 1), y), X, Y, Q)


def simplex_loo(X, Y, *, theiler_window: int = 0):  # noqa: N803
    """Simplex projection of every row from those over ``theiler_window`` rows away."""
    X, Y = (np.asarray(a, float) for a in (X, Y))
    t = np.arange(X.shape[-2])
    return _batched(lambda x, y: _project(*nearest(x, x, x.shape[1] + 1, at=t, apart=theiler_window), y), X, Y)


def smap(theta: float = 1.0):
    """Locally weighted linear prediction (Sugihara 1994): weights exp(-theta * dist / mean dist)."""

    def predict(X, Y, Q, *, mask=None):  # noqa: N803
        X, Y, Q = (np.asarray(a, float) for a in (X, Y, Q))
        if mask is not None:
            X, Y = X[..., mask, :], Y[..., mask, :]

        def one(x, y, q):
            a, b = (np.column_stack([np.ones(len(v)), v]) for v in (x, q))
            # Standardised columns give the same maps by well-conditioned normal equations.
            mean, spread = (x.mean(axis=0), x.std(axis=0)) if len(x) else (0.0, 1.0)
            spread = np.where(spread > 0, spread, 1.0)
            za, zb = (np.column_stack([np.ones(len(v)), (v - mean) / spread]) for v in (x, q))
            n, targets = za.shape[1], y.shape[1]
            products = np.column_stack([(za[:, :, None] * za[:, None, :]).reshape(len(x), -1), (za[:, :, None] * y[:, None, :]).reshape(len(x), -1)])
            out, step = np.empty((len(q), targets)), max(1, CELLS // max(len(x), 1))
            for lo in range(0, len(q), step):
                dist = distances(x, q[lo : lo + step])
                w = np.exp(-theta * dist / np.maximum(dist.mean(axis=1, keepdims=True), LEAST_DISTANCE))
                sums = (w * w) @ products
                left, right = sums[:, : n * n].reshape(-1, n, n), sums[:, n * n :].reshape(-1, n, targets)
                usable = np.isfinite(sums).all(axis=1)
                own = np.linalg.eigvalsh(np.where(usable[:, None, None], left, np.eye(n)))
                usable &= own[:, 0] > SOUND * own[:, -1]
                fit = np.linalg.solve(np.where(usable[:, None, None], left, np.eye(n)), np.where(usable[:, None, None], right, 0.0))
                out[lo : lo + step] = np.einsum("mn,mnd->md", zb[lo : lo + step], fit)
                for i in np.flatnonzero(~usable):
                    out[lo + i] = b[lo + i] @ np.linalg.lstsq(w[i][:, None] * a, w[i][:, None] * y, rcond=None)[0]
            return out

        return _batched(one, X, Y, Q)

    return predict


simplex.columnar = True  # has a DataFrame form
