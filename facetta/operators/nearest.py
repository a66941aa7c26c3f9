"""Exact nearest neighbours without all distances: blocks of near queries look only into near blocks of the library.

Both sides are halved along their widest column until LEAF rows are left. For the queries of a leaf the rows of one part of
the library bound how far the k-th neighbour is at most; the parts whose boxes are within it hold all neighbours. In a few
columns that are some leaves, however many rows there are; in many columns it may be all of them. Memory is bounded by CELLS
either way.
"""

from __future__ import annotations

import numpy as np

#: Rows of a leaf, at least half of it; distances held at once; leaves of queries taken at once.
LEAF, CELLS, GROUPS = 64, 1 << 20, 256
#: Bounds are widened by this, for their rounding.
SLACK = 1 + 1e-9


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(M, L), columns added up in order."""
    total = np.zeros((len(q), len(x)))
    with np.errstate(invalid="ignore"):  # infinite values
        for j in range(x.shape[1]):
            part = q[:, j, None] - x[None, :, j]
            part *= part
            total += part
    return np.sqrt(total, out=total)


class _Tree:
    """Rows halved along the widest column of each part; ``bounds[l]`` are the ends of the parts of level ``l`` in ``order``."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        levels = max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))
        order, self.bounds = np.arange(n), [(np.arange((1 << k) + 1) * n) >> k for k in range(levels + 1)]
        for b in self.bounds[:-1]:
            own = x[order]
            widest = np.argmax(np.maximum.reduceat(own, b[:-1]) - np.minimum.reduceat(own, b[:-1]), axis=1)
            part = np.repeat(np.arange(len(b) - 1), np.diff(b))
            order = order[np.lexsort([own[np.arange(n), widest[part]], part])]
        self.order, own = order, x[order]
        self.low = [np.minimum.reduceat(own, b[:-1]) for b in self.bounds]
        self.high = [np.maximum.reduceat(own, b[:-1]) for b in self.bounds]

    def gap(self, level: int, part: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least squared distance of parts and boxes."""
        out = np.maximum(np.maximum(self.low[level][part] - high, low - self.high[level][part]), 0.0)
        return (out * out).sum(axis=1)

    def leaves(self, low: np.ndarray, high: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a box and a leaf that are at most ``most`` (squared) apart, by box."""
        box, part = np.arange(len(low)), np.zeros(len(low), np.int64)
        for level in range(len(self.bounds)):
            near = self.gap(level, part, low[box], high[box]) <= most[box]
            box, part = box[near], part[near]
            if level < len(self.bounds) - 1:
                box, part = np.repeat(box, 2), np.stack([2 * part, 2 * part + 1], axis=1).ravel()
        return box, part

    def nearest(self, low: np.ndarray, high: np.ndarray, rows: int) -> tuple[int, np.ndarray]:
        """A level whose parts have at least ``rows`` rows, and for each box a part of it that is near."""
        level = max(k for k, b in enumerate(self.bounds) if not k or np.diff(b).min() >= rows)
        part = np.zeros(len(low), np.int64)
        middle = (low + high) / 2
        for k in range(1, level + 1):
            left, right = 2 * part, 2 * part + 1
            part = np.where(self.gap(k, left, middle, middle) <= self.gap(k, right, middle, middle), left, right)
        return level, part


def _firsts(x: np.ndarray, place: np.ndarray, most: int) -> np.ndarray:
    """Of rows alike the ``most`` of least place: no others can be among the neighbours. Rows by their number."""
    order = np.lexsort([place, *x.T])
    new = np.ones(len(x), bool)
    new[1:] = (x[order[1:]] != x[order[:-1]]).any(axis=1)
    start = np.flatnonzero(new)
    return order[np.arange(len(x)) - start[np.cumsum(new) - 1] < most]


def _least(dist: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` columns of each row that are first by distance, then place, NaN last; ``place`` ascends. Columns and distances."""
    n = dist.shape[1]
    if n > 4 * k:
        last = np.partition(dist, k - 1, axis=1)[:, k - 1]
        if not np.isnan(last).any():
            r, c = np.nonzero(dist <= last[:, None])
            d = dist[r, c]
            by = np.lexsort([c, d, r])
            first = np.searchsorted(r, np.arange(len(dist)))
            at = by[first[:, None] + np.arange(k)]
            return c[at], d[at]
    c = np.argsort(dist, axis=1, kind="stable")[:, :k]
    return c, np.take_along_axis(dist, c, axis=1)


def nearest(x: np.ndarray, q: np.ndarray, k: int, *, place=None, at=None, apart: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``dist`` and ``row`` (M, k): the rows of ``x`` nearest to each of ``q``, by distance, then ``place``.

    ``place`` numbers the library's rows, by default from 0; with ``apart`` those at most that far from a query's own place
    ``at`` don't count: they are infinitely far, as are missing ones where there are fewer than ``k``. Distances that aren't
    numbers come last.
    """
    x, q = np.asarray(x, float), np.asarray(q, float)
    place = np.arange(len(x)) if place is None else np.asarray(place)
    at = None if apart is None else np.asarray(at)
    dist, row = np.full((len(q), k), np.inf), np.zeros((len(q), k), np.int64)
    if not len(x) or not len(q):
        return dist, row
    barred = 0 if apart is None else 2 * apart + 1
    by_place = np.argsort(place, kind="stable")

    def look(queries: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``rows`` in order of place."""
        d = distances(x[rows], q[queries])
        if apart is not None:
            d[np.abs(at[queries, None] - place[None, rows]) <= apart] = np.inf
        c, d = _least(d, place[rows], min(k, len(rows)))
        return d, rows[c]

    def settle(queries: np.ndarray, rows: np.ndarray) -> None:
        step = max(1, CELLS // len(rows))
        for i in range(0, len(queries), step):
            own = queries[i : i + step]
            d, r = look(own, rows)
            dist[own, : d.shape[1]], row[own, : d.shape[1]] = d, r

    sound = np.flatnonzero(np.isfinite(x).all(axis=1))
    sound = sound[_firsts(x[sound], place[sound], k + barred)]
    plain = np.isfinite(q).all(axis=1)
    if len(sound) < max(2 * LEAF, k + barred):
        settle(np.arange(len(q)), by_place)
        return dist, row
    settle(np.flatnonzero(~plain), by_place)
    asked = np.flatnonzero(plain)
    if not len(asked):
        return dist, row
    tree, own = _Tree(x[sound]), _Tree(q[asked])
    ranks = np.empty(len(x), np.int64)
    ranks[by_place] = np.arange(len(x))
    inside, cuts = sound[tree.order], own.bounds[-1]
    low, high = own.low[-1], own.high[-1]
    for g in range(0, len(low), GROUPS):
        lo, hi = low[g : g + GROUPS], high[g : g + GROUPS]
        members = [asked[own.order[i:j]] for i, j in zip(cuts[g : g + GROUPS], cuts[g + 1 : g + GROUPS + 1])]
        level, part = tree.nearest(lo, hi, k + barred)
        b, most = tree.bounds[level], np.zeros(len(lo))
        for i, queries in enumerate(members):
            rows = inside[b[part[i]] : b[part[i] + 1]]
            for s in range(0, len(queries), step := max(1, CELLS // len(rows))):
                d = distances(x[rows], q[queries[s : s + step]])
                if apart is not None:
                    d[np.abs(at[queries[s : s + step], None] - place[None, rows]) <= apart] = np.inf
                most[i] = max(most[i], np.partition(d, k - 1, axis=1)[:, k - 1].max())
        box, leaf = tree.leaves(lo, hi, most * most * SLACK)
        ends, b = np.searchsorted(box, np.arange(len(lo) + 1)), tree.bounds[-1]
        for i, queries in enumerate(members):
            parts = leaf[ends[i] : ends[i + 1]]
            size = b[parts + 1] - b[parts]
            rows = inside[np.repeat(b[parts] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())]
            settle(queries, rows[np.argsort(ranks[rows])])
    return dist, row
