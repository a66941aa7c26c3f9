"""Simplex projection of series of any length: blocks of rows meet in tasks that search them, the rest is DataFrame operations.

The kernel isn't part of the reference; this is the published method (Sugihara and May 1990) with our guards: k = d + 1
neighbours, ties by position in the library, weights exp(-dist / least dist), floors below.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..work import BROADCAST_BYTES
from .nearest import nearest

#: Floors of the least distance and of a weight.
LEAST_DISTANCE = LEAST_WEIGHT = 1e-6
#: A row's distance to itself where it may not be its own neighbour: behind all others, without weight.
NOWHERE = float("inf")
#: Rows for which a task more is taken, at least; queries whose neighbours leave a task at once; tasks at most.
QUERY_ROWS, OUT_ROWS, MOST_TASKS = 8192, 100_000, 20_000


def gathered(y: str, d: int) -> Column:
    """The columns of ``y`` that ``state`` names."""
    return F.array(*[F.get(y, F.get("state", F.lit(j)).cast("int")) for j in range(d)])


def _matrix(lists: pa.Array) -> np.ndarray:
    """A list array as float64 rows; what is missing isn't a number."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    width = int(sizes.max()) if len(sizes) else 0
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.full((len(sizes), width), np.nan)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def _groups(batches):
    """The groups of a partition sorted by its first column, each as a table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        g = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if held and held[0].column(0)[0].as_py() != g[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def candidates(
    states: DataFrame, queries: DataFrame, library: DataFrame, d: int, *, rows: int, width: int, count: int, folds: int | None = None, theiler: int | None = None
) -> DataFrame:
    """``sid``, ``state``, ``fold_id``, ``tq``, ``tl``, ``dist``, ``yl``, ``yq``: the nearest rows of each block of the library to
    every query in every state, see ``neighbours``.

    Rows of both sides are dealt into blocks of BROADCAST_BYTES, states too, and each three blocks meet in one task: a row is
    sent once for each block of the others. One block of the library may meet more blocks of queries, for the sake of tasks.
    A block is searched by ``nearest``, not by all distances.
    """
    spark = states.sparkSession
    folded = "fold_id" in states.columns
    lbs, sbs = (max(1, -(-size * 8 // BROADCAST_BYTES)) for size in (rows * width, count * (d + 2)))
    qbs = lbs if folded else max(lbs, min(2 * spark.sparkContext.defaultParallelism, rows // QUERY_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda c, n: F.pmod(F.col(c), F.lit(n)).cast("int")

    def dealt(frame: DataFrame, kind: int, key: str, sb, qb, lb) -> DataFrame:
        blocks = frame.withColumn("sb", sb).withColumn("qb", qb).withColumn("lb", lb)
        g = ((F.col("fold_id").cast("long") * sbs + F.col("sb")) * qbs + F.col("qb")) * lbs + F.col("lb")
        none = lambda c: F.lit(None).cast("array<float>").alias(c)
        x, y, state = ("x", "y", F.lit(None).cast("array<bigint>").alias("state")) if kind else (none("x"), none("y"), F.col("state").cast("array<bigint>").alias("state"))
        return blocks.select(g.alias("g"), F.lit(kind).alias("kind"), F.col(key).cast("long").alias("key"), F.col("fold_id").cast("int").alias("fold_id"), x, y, state)

    if not folded:
        each = spark.range(folds).select(F.col("id").cast("int").alias("fold_id")) if folds else queries.select("fold_id").distinct()
        states = states.select("sid", "state").crossJoin(F.broadcast(each))
    rows_of = lambda frame: frame.select("fold_id", "pos", F.col("x").cast("array<float>").alias("x"), F.col("y").cast("array<float>").alias("y"))
    parts = [
        dealt(states, 0, "sid", own("sid", sbs), every(qbs), every(lbs)),
        dealt(rows_of(library), 1, "pos", every(sbs), every(qbs), own("pos", lbs)),
        dealt(rows_of(queries), 2, "pos", every(sbs), own("pos", qbs), every(lbs)),
    ]
    tasks = min(MOST_TASKS, max(sbs * qbs * lbs, spark.sparkContext.defaultParallelism))
    met = reduce(DataFrame.unionByName, parts).repartitionById(tasks, F.pmod("g", F.lit(tasks)).cast("int")).sortWithinPartitions("g", "kind", "key")
    names = ["sid", "state", "fold_id", "tq", "tl", "dist", "yl", "yq"]

    def apply(batches):
        for t in _groups(batches):
            kind, key = t.column("kind").to_numpy(), t.column("key").to_numpy()
            cut = np.searchsorted(kind, [1, 2])
            lists = t.column("state").slice(0, cut[0]).combine_chunks()
            tl, tq = key[cut[0] : cut[1]], key[cut[1] :]
            if not len(lists) or not len(tq) or not (len(tl) or theiler is not None):
                continue
            fold = t.column("fold_id")[0].as_py()
            (xl, xq), (yl, yq) = ([t.column(c).slice(*at) for at in ((cut[0], len(tl)), (cut[1], len(tq)))] for c in "xy")
            xl, xq = _matrix(xl), _matrix(xq)
            ys = pa.chunked_array([*yl.chunks, *yq.chunks], yl.type).combine_chunks()
            for i, (sid, state) in enumerate(zip(key[: cut[0]].tolist(), lists.to_pylist())):
                k = len(state) + 1
                for lo in range(0, len(tq), OUT_ROWS):
                    some = slice(lo, lo + OUT_ROWS)
                    dist, row = nearest(xl[:, state] if len(tl) else np.zeros((0, len(state))), xq[some][:, state], k, place=tl, at=tq[some], apart=theiler)
                    found = ~np.isinf(dist)
                    r, c = np.nonzero(found)
                    lone = np.flatnonzero(~found.all(axis=1))  # too few: the query itself, without weight
                    at = np.concatenate([r, lone])
                    own_y = pa.array(at + lo + len(tl))
                    cells = (
                        pa.array(np.full(len(at), sid)), lists.take(pa.array(np.full(len(at), i))), pa.array(np.full(len(at), fold, np.int32)), pa.array(tq[some][at]),
                        pa.array(np.concatenate([tl[row[r, c]] if len(tl) else np.zeros(0, np.int64), tq[some][lone]])), pa.array(np.concatenate([dist[r, c], np.full(len(lone), NOWHERE)])),
                        ys.take(pa.array(np.concatenate([row[r, c], lone + lo + len(tl)]))), ys.take(own_y),
                    )
                    yield pa.RecordBatch.from_arrays(list(cells), names=names)

    return met.mapInArrow(apply, "sid long, state array<bigint>, fold_id int, tq long, tl long, dist double, yl array<float>, yq array<float>")


def neighbours(
    states: DataFrame, queries: DataFrame, library: DataFrame, d: int, *, rows: int, width: int, count: int, folds: int | None = None, theiler: int | None = None
) -> DataFrame:
    """The nearest library rows of every query in every state, one more than it has columns, with ``dist`` and weight ``w``.

    ``states``: sid, state (of ``d`` columns at most), and fold_id if each belongs to one fold. ``queries`` and ``library``:
    fold_id, pos, x, y. ``theiler`` excludes library rows at most that many positions away; a query itself stays,
    infinitely far and without weight, so that one with no neighbour is still there. ``count`` says how many states there
    are, ``rows`` and ``width`` size the library, ``folds`` is the number of folds, from 0 on, if it's known.
    """
    pairs = candidates(states, queries, library, d, rows=rows, width=width, count=count, folds=folds, theiler=theiler)
    # Blocks of the library are merged: the first of all.
    ranked = pairs.select("*", F.expr("row_number() over (partition by sid, fold_id, tq order by dist, tl)").alias("rn"))
    near = ranked.where((F.col("rn") <= d + 1) & (F.col("rn") <= F.size("state") + 1)).drop("rn")
    first = F.greatest(F.expr("min(dist) over (partition by sid, fold_id, tq)"), F.lit(LEAST_DISTANCE))
    weight = F.greatest(F.exp(-F.col("dist") / first), F.lit(LEAST_WEIGHT))
    return near.withColumn("w", F.when(F.col("dist") == NOWHERE, F.lit(0.0)).otherwise(weight))


def weighted(near: DataFrame, d: int, *, within: bool) -> DataFrame:
    """``sid``, ``fold_id``, ``tq``, ``target``, ``pred``, ``obs``: the neighbours' weighted targets, NaN without neighbours.

    Grouping keeps the partitioning of the top-k: no further shuffle.
    """
    both = F.arrays_zip(gathered("yl", d).alias("yl"), gathered("yq", d).alias("yq")) if within else F.arrays_zip("yl", "yq")
    both = F.slice(both, F.lit(1), F.size("state")) if within else both
    each = near.select("sid", "fold_id", "tq", "w", F.posexplode(both).alias("target", "v"))
    pred = F.coalesce(F.try_divide(F.sum(F.col("w") * F.col("v.yl")), F.sum("w")), F.lit(float("nan")))
    return each.groupBy("sid", "fold_id", "tq", "target").agg(pred.alias("pred"), F.max(F.col("v.yq").cast("double")).alias("obs"))


def simplex_predictions(states, queries, library, d: int, *, rows: int, width: int, count: int = 1, folds: int | None = None, within: bool = False) -> DataFrame:
    """Predictions of every query's targets in every state."""
    return weighted(neighbours(states, queries, library, d, rows=rows, width=width, count=count, folds=folds), d, within=within)


def loo_predictions(states, series, d: int, *, rows: int, width: int, count: int = 1, theiler: int = 0, within: bool = False) -> DataFrame:
    """Every row predicted from all others that are over ``theiler`` positions away."""
    own = series.select(F.lit(0).alias("fold_id"), F.col("t").alias("pos"), "x", "y")
    return weighted(neighbours(states, own, own, d, rows=rows, width=width, count=count, folds=1, theiler=theiler), d, within=within)
