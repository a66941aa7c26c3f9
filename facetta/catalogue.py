"""Named queries over the driver's tables, each with the DuckDB SQL of the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import pi

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures, oracle
from .functions import CORR, MAE, MEAN_RHO, RMSE, compose, gaussian_noise, mask_columns, softmax, zscore_normalize
from .operators import cross, embedding, enumerate_states, forward, lag_embed, loo_predictions, simplex, simplex_predictions, smap, within
from .operators.neighborhood import expand, initial
from .plans import beam, best_step, greedy, initial_frontier, recovery_count, subset_search, sweep, trace_frame, validate_trace
from .plans.strategy import FRONTIER, frontier, incumbent, pop, survivors
from .sources import Dataset, Fold, Subset, expanding_folds, fold_frame, horizon_shift, lorenz96_dataset, sliding_folds, temporal_fold

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
q = oracle.q


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r6(column) -> F.Column:
    return F.round(column, 6)


def states(spark: SparkSession, rows: list[list[int]], contexts: list[list[float]] | None = None) -> DataFrame:
    contexts = contexts or [[] for _ in rows]
    return spark.createDataFrame([(i, s, c) for i, (s, c) in enumerate(zip(rows, contexts))], "sid long, state array<bigint>, context array<double>")


def text(column: str = "state"):
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


# Datasets


@query(q(oracle.emb(6), select="SELECT t, round(CAST(x[1] AS DOUBLE), 6) AS x0, round(CAST(x[6] AS DOUBLE), 6) AS x5, round(CAST(y[1] AS DOUBLE), 6) AS y0 FROM data"))
def dataset_pair(spark, sf_dir):
    d = fixtures.embeddings(spark, sf_dir, 6)
    return Dataset(d.X, d.Y.select("t", F.get("y", F.lit(0)).alias("y"))).frame.select(
        "t", r6(F.get("x", F.lit(0)).cast("double")).alias("x0"), r6(F.get("x", F.lit(5)).cast("double")).alias("x5"), r6(F.get("y", F.lit(0)).cast("double")).alias("y0")
    )


@query(q(oracle.emb(6), select="SELECT count(*) AS n, CAST(max(len(x)) AS INTEGER) AS dx, CAST(max(len(y)) AS INTEGER) AS dy FROM data"))
def dataset_len(spark, sf_dir):
    d = fixtures.embeddings(spark, sf_dir, 6)
    return spark.range(1).select(F.lit(len(d)).cast("long").alias("n"), F.lit(d.widths[0]).alias("dx"), F.lit(d.widths[1]).alias("dy"))


@query(q(oracle.HOURLY, select="SELECT a.t, round(CAST(a.x[1] AS DOUBLE), 3) AS x0, round(CAST(b.x[3] AS DOUBLE), 3) AS y0 FROM hourly a JOIN hourly b ON b.t = a.t + 3"))
def dataset_horizon_shift(spark, sf_dir):
    frame = fixtures.hourly_events(spark, sf_dir).withColumn("y", F.slice("x", 3, 1))
    return horizon_shift(frame, 3).select("t", F.round(F.get("x", F.lit(0)).cast("double"), 3).alias("x0"), F.round(F.get("y", F.lit(0)).cast("double"), 3).alias("y0"))


def _numbers(frame: DataFrame) -> DataFrame:
    return frame.select("t", *[F.round(F.get("x", F.lit(i)).cast("double"), 3).alias(f"x{i}") for i in range(3)])


def _numbers_sql(rows: str) -> str:
    cells = ", ".join(f"round(CAST(x[{i + 1}] AS DOUBLE), 3) AS x{i}" for i in range(3))
    return q(oracle.ev(cross=True), select=f"SELECT p.pos AS t, {cells} FROM data JOIN (VALUES {rows}) p(pos, t) USING (t)")


@query(_numbers_sql("(0, 4), (1, 1), (2, 300), (3, 300)"))
def subset_rows(spark, sf_dir):
    return _numbers(Subset(fixtures.events(spark, sf_dir, cross=True), [4, 1, 300, 300]).frame)


@query(_numbers_sql("(0, 107), (1, 105), (2, 140)"))
def subset_of_subset(spark, sf_dir):
    return _numbers(Subset(Subset(fixtures.events(spark, sf_dir, cross=True), range(100, 200)), [7, 5, 40]).frame)


@query(q(oracle.ev(cross=True), select="SELECT t, round(CAST(x[1] AS DOUBLE) * 2, 3) AS x0, round(CAST(y[1] AS DOUBLE), 3) AS y0 FROM data WHERE t = 17"))
def sample_transformed(spark, sf_dir):
    d = fixtures.events(spark, sf_dir, cross=True)
    double = lambda f: f.withColumn("x", F.transform("x", lambda v: v.cast("double") * 2))
    row = Subset(Dataset.from_frame(d.frame, transform=double), range(10, 30)).sample(7)
    return row.select((F.col("t") + 10).alias("t"), F.round(F.get("x", F.lit(0)), 3).alias("x0"), F.round(F.get("y", F.lit(0)).cast("double"), 3).alias("y0"))


# Transforms


def _zscore_sql(x: bool, y: bool) -> str:
    def cells(name: str, on: bool) -> str:
        if not on:
            return ", ".join(f"round(CAST(CAST(x[{k}] AS FLOAT) AS DOUBLE), 3) AS {name}{k - 1}" for k in range(1, 5))
        z = "CAST((CAST(CAST(x[{k}] AS FLOAT) AS DOUBLE) - CAST(CAST(m{k} AS FLOAT) AS DOUBLE)) / greatest(CAST(CAST(s{k} AS FLOAT) AS DOUBLE), 1e-8) AS FLOAT)"
        return ", ".join(f"round(CAST({z.format(k=k)} AS DOUBLE), 4) AS {name}{k - 1}" for k in range(1, 5))

    stats = ", ".join(f"avg(CAST(CAST(x[{k}] AS FLOAT) AS DOUBLE)) AS m{k}, stddev_pop(CAST(CAST(x[{k}] AS FLOAT) AS DOUBLE)) AS s{k}" for k in range(1, 5))
    return q(oracle.LI, f"stats AS (SELECT {stats} FROM data)", select=f"SELECT t, {cells('x', x)}, {cells('y', y)} FROM data, stats")


def _zscore(spark, sf_dir, target):
    d = Dataset.from_frame(fixtures.daily_lineitems(spark, sf_dir))
    out = zscore_normalize(d.X, target=target)(d.frame)
    cells = [F.round(F.get(n, F.lit(k)).cast("double"), 4 if target in (n, "both") else 3).alias(f"{n}{k}") for n in "xy" for k in range(4)]
    return out.select("t", *cells)


@query(_zscore_sql(True, False))
def zscore_x(spark, sf_dir):
    return _zscore(spark, sf_dir, "x")


@query(_zscore_sql(False, True))
def zscore_y(spark, sf_dir):
    return _zscore(spark, sf_dir, "y")


@query(_zscore_sql(True, True))
def zscore_both(spark, sf_dir):
    return _zscore(spark, sf_dir, "both")


@query("SELECT CAST(t AS BIGINT) AS t, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS x1 FROM (SELECT unnest(range(0, 4)) AS t)")
def zscore_constant(spark, sf_dir):
    ones = spark.range(4).select(F.col("id").alias("t"), F.array(F.lit(1.0), F.lit(1.0)).cast("array<float>").alias("x"))
    return zscore_normalize(ones, target="x")(ones).select("t", *[F.get("x", F.lit(k)).cast("double").alias(f"x{k}") for k in range(2)])


def _noise_sql(k: int) -> str:
    key = ("'7'", "'0'", "CAST(t AS VARCHAR)", f"'{k}'")
    normal = f"sqrt(-2 * ln({oracle.uniform(*key, chr(39) + 'u' + chr(39))})) * cos({2 * pi!r} * {oracle.uniform(*key, chr(39) + 'v' + chr(39))})"
    return f"CAST(CAST(x[{k + 1}] AS DOUBLE) + 0.5 * {normal} AS FLOAT)"


@query(q(oracle.ev(cross=True), select=f"SELECT t, {', '.join(f'round(CAST({_noise_sql(k)} AS DOUBLE), 3) AS x{k}' for k in range(3))} FROM data"))
def gaussian_noise_seeded(spark, sf_dir):
    return _numbers(gaussian_noise(0.5, 7)(fixtures.events(spark, sf_dir, cross=True).frame))


@query(q(oracle.ev(cross=True), select="SELECT t, " + ", ".join(f"round((CAST(x[{k + 1}] AS DOUBLE) + 1) * 2, 3) AS x{k}" for k in range(3)) + " FROM data"))
def compose_order(spark, sf_dir):
    step = lambda f: lambda frame: frame.withColumn("x", F.transform("x", f))
    both = compose(step(lambda v: v.cast("double") + 1), step(lambda v: v * 2), compose())
    return _numbers(both(fixtures.events(spark, sf_dir, cross=True).frame))


@query(q(oracle.emb(5), select="SELECT t, " + ", ".join(f"round(CAST(x[{k}] AS DOUBLE), 3) AS x{i}" for i, k in enumerate((1, 3, 5))) + " FROM data"))
def candidate_mask(spark, sf_dir):
    return _numbers(mask_columns([True, False, True, False, True])(fixtures.embeddings(spark, sf_dir, 5).frame))


# States and expansion


@query("SELECT CAST(1 AS BIGINT) AS rows, CAST(0 AS INTEGER) AS length")
def state_initial(spark, sf_dir):
    return initial(spark).agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("state")).alias("length"))


def _forward_sql(parents: list[list[int]], n: int) -> str:
    h = oracle.hash48("'3'", "'1'", "CAST(sid AS VARCHAR)", "CAST(j AS VARCHAR)")
    return q(
        oracle.states(parents),
        select=f"""SELECT CAST(sid AS BIGINT) AS parent, {oracle.joined('list_append(state, j)')} AS state,
          row_number() OVER (PARTITION BY sid ORDER BY {h}, j) - 1 AS child_rank
        FROM s, (SELECT CAST(unnest(range(0, {n})) AS BIGINT) AS j) WHERE NOT list_contains(state, j)""",
    )


def _forward(spark, parents, n):
    rows = states(spark, parents).withColumnRenamed("sid", "rank")
    return forward(n)(rows, 3, 1).select(F.col("rank").alias("parent"), text(), F.col("child_rank").cast("long").alias("child_rank"))


@query(_forward_sql([[]], 6))
def forward_initial(spark, sf_dir):
    return _forward(spark, [[]], 6)


@query(_forward_sql([[0], [3], [1]], 5))
def forward_depth1(spark, sf_dir):
    return _forward(spark, [[0], [3], [1]], 5)


@query(_forward_sql([[0, 1], [1, 0]], 2))
def forward_exhausted(spark, sf_dir):
    return _forward(spark, [[0, 1], [1, 0]], 2)


@query(
    """WITH RECURSIVE s AS (SELECT CAST([] AS BIGINT[]) AS state, 0 AS depth UNION ALL
      SELECT list_append(state, j), depth + 1 FROM s, (SELECT CAST(unnest(range(0, 4)) AS BIGINT) AS j) WHERE depth < 3 AND NOT list_contains(state, j))
    SELECT array_to_string(state, ',') AS state, CAST(depth AS INTEGER) AS depth FROM s"""
)
def enumerate_all_states(spark, sf_dir):
    return enumerate_states(spark, 4, 3).select(text(), "depth")


# Folds


def _fold_sql(folds: str) -> str:
    return f"""SELECT CAST(k AS INTEGER) AS fold_id, arm, CAST(t - a AS BIGINT) AS pos, CAST(t AS BIGINT) AS t
      FROM (SELECT k, arm, a, unnest(range(a, b)) AS t FROM (SELECT k, 'train' AS arm, a, b FROM ({folds}) UNION ALL SELECT k, 'validation', b, c FROM ({folds})))"""


@query(_fold_sql("SELECT 0 AS k, 0 AS a, 576 AS b, 720 AS c"))
def fold_temporal(spark, sf_dir):
    return fold_frame(spark, [temporal_fold(720, 0.8)])


@query(_fold_sql("SELECT k, k * 144 AS a, k * 144 + 288 AS b, k * 144 + 432 AS c FROM (SELECT unnest(range(0, 3)) AS k)"))
def fold_sliding(spark, sf_dir):
    return fold_frame(spark, sliding_folds(720, 288, 144, 144))


@query(_fold_sql("SELECT k, 0 AS a, 200 + k * 100 AS b, 300 + k * 100 AS c FROM (SELECT unnest(range(0, 5)) AS k)"))
def fold_expanding(spark, sf_dir):
    return fold_frame(spark, expanding_folds(720, 200, 100, 100))


# Weights and metrics

_CONTEXTS = [[0.1, 0.4, 0.2], [0.0, 0.0, 0.0], [1e6, -1e6, 0.0], [-3.0, 5.5, 5.5]]


@query(
    q(
        "v AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, CAST({c} AS DOUBLE[]))" for i, c in enumerate(_CONTEXTS)) + ") v(k, c))",
        "r AS (SELECT k, tau, list_transform(c, lambda v: exp((v - list_max(c)) / tau)) AS r FROM v, (VALUES (0.1::DOUBLE), (1::DOUBLE), (10::DOUBLE)) t(tau))",
        select="SELECT CAST(k AS BIGINT) AS k, tau, i - 1 AS fold_id, round(r[i] / list_sum(r), 9) AS w FROM r, (SELECT unnest(range(1, 4)) AS i)",
    )
)
def softmax_weights(spark, sf_dir):
    rows = spark.createDataFrame(list(enumerate(_CONTEXTS)), "k long, c array<double>")
    each = [rows.select("k", F.lit(t).alias("tau"), F.posexplode(softmax(t)(F.col("c"))).alias("fold_id", "w")) for t in (0.1, 1.0, 10.0)]
    return reduce(DataFrame.unionByName, each).select("k", "tau", F.col("fold_id").cast("long").alias("fold_id"), F.round("w", 9).alias("w"))


_PREDS = "pred AS (SELECT t % 3 AS sid, 0 AS fold_id, t AS tq, k - 1 AS target, CAST(x[k] AS DOUBLE) AS pred, CAST(y[k] AS DOUBLE) AS obs FROM data, (SELECT unnest(range(1, 6)) AS k))"


def _metric_sql(name: str) -> str:
    return q(oracle.ev(cross=False), _PREDS, oracle.metric(name), select="SELECT sid, round(value, 6) AS value FROM m")


def _metric(spark, sf_dir, metric):
    each = fixtures.events(spark, sf_dir, cross=False).frame.select((F.col("t") % 3).alias("sid"), F.col("t").alias("tq"), F.posexplode(F.arrays_zip("x", "y")).alias("target", "v"))
    rows = each.select("sid", "tq", "target", F.col("v.x").cast("double").alias("pred"), F.col("v.y").cast("double").alias("obs"))
    return metric.aggregate(rows, ["sid"]).select("sid", r6("value").alias("value"))


@query(_metric_sql("mae"))
def metric_mae(spark, sf_dir):
    return _metric(spark, sf_dir, MAE)


@query(_metric_sql("rmse"))
def metric_rmse(spark, sf_dir):
    return _metric(spark, sf_dir, RMSE)


@query(_metric_sql("mean_rho"))
def metric_mean_rho(spark, sf_dir):
    return _metric(spark, sf_dir, MEAN_RHO)


# Simplex projection, over all rows: the last fifth is predicted from the rest, or of the rest the last quarter.

_PAIRS = [[0, 1], [2, 3], [1, 2]]


def outer_fold(data: Dataset) -> Fold:
    return temporal_fold(len(data), 0.8)


def inner_fold(train: Dataset) -> Fold:
    return temporal_fold(len(train), 0.75)


def training(data: Dataset) -> Subset:
    return Subset(data, outer_fold(data).train)


_PRED = "SELECT CAST(sid AS BIGINT) AS sid, tq, CAST(target AS INTEGER) AS target, round(pred, 6) AS pred, round(obs, 6) AS obs FROM pred"


def _pred(rows: DataFrame) -> DataFrame:
    return rows.select("sid", "tq", "target", r6("pred").alias("pred"), r6("obs").alias("obs"))


@query(q(oracle.emb(8), oracle.states(_PAIRS), oracle.arms([oracle.OUTER]), oracle.simplex(2), select=_PRED))
def simplex_predict(spark, sf_dir):
    d = fixtures.embeddings(spark, sf_dir, 8)
    rows = fold_frame(spark, [outer_fold(d)]).join(d.frame, "t")
    arm = lambda a: rows.where(F.col("arm") == a)
    return _pred(simplex_predictions(states(spark, _PAIRS), arm("validation"), arm("train"), 2, rows=len(d), width=9))


@query(q(oracle.emb(8), oracle.states(_PAIRS[:2]), oracle.LOO_ARMS, oracle.simplex(2, theiler=0), select=_PRED))
def simplex_loo(spark, sf_dir):
    d = fixtures.embeddings(spark, sf_dir, 8)
    return _pred(loo_predictions(states(spark, _PAIRS[:2]), d.frame, 2, rows=len(d), width=9))


@query(q(oracle.emb(8), oracle.states(_PAIRS[:2]), oracle.LOO_ARMS, oracle.simplex(2, theiler=2), select=_PRED))
def simplex_loo_theiler2(spark, sf_dir):
    d = fixtures.embeddings(spark, sf_dir, 8)
    return _pred(loo_predictions(states(spark, _PAIRS[:2]), d.frame, 2, rows=len(d), width=9, theiler=2))


# Energies

_ENERGY = "SELECT CAST(sid AS BIGINT) AS sid, {state} AS state, round(value, 6) AS energy FROM m JOIN s USING (sid)".format(state=oracle.joined())


def _energy(out: DataFrame) -> DataFrame:
    return out.select("sid", text(), r6("energy").alias("energy"))


def _colsum(X, Y, Q, *, mask=None):  # noqa: N803
    """Predicts the sum of the query's coordinates for each target."""
    total = Q.sum(axis=-1, keepdims=True)
    return np.repeat(total, Y.shape[-1], axis=-1)


_COLSUM = "pred AS (SELECT sid, fold_id, pos AS tq, 0 AS target, list_sum(list_transform(state, lambda j: CAST(x[j + 1] AS DOUBLE))) AS pred, CAST(y[1] AS DOUBLE) AS obs FROM qry, s)"


@query(q(oracle.emb(8), oracle.states(_PAIRS), oracle.arms([oracle.OUTER]), _COLSUM, oracle.metric("mae"), select=_ENERGY))
def cross_holdout_colsum(spark, sf_dir):
    data = fixtures.embeddings(spark, sf_dir, 8)
    _, e = cross.holdout(data=data, fold=outer_fold(data), predict=_colsum, metric=MAE, batch_size=2)
    return _energy(e(states(spark, _PAIRS)))


_HOLDOUT_SQL = q(oracle.emb(8), oracle.states(_PAIRS), oracle.arms([oracle.OUTER]), oracle.simplex(2), oracle.metric("corr"), select=_ENERGY)


def _holdout(spark, sf_dir, engine):
    data = fixtures.embeddings(spark, sf_dir, 8)
    _, e = cross.holdout(data=data, fold=outer_fold(data), predict=simplex, metric=CORR, engine=engine)
    return _energy(e(states(spark, _PAIRS)))


@query(_HOLDOUT_SQL)
def cross_holdout_simplex(spark, sf_dir):
    return _holdout(spark, sf_dir, "columns")


@query(_HOLDOUT_SQL)
def arrow_holdout_equiv(spark, sf_dir):
    return _holdout(spark, sf_dir, "arrow")


def event_folds(data: Dataset) -> list[Fold]:
    n, a, b = len(data), int(len(data) * 0.4 + 1e-9), int(len(data) * 0.2 + 1e-9)
    return sliding_folds(n, a, b, b)


_ONES, _TWOS = [[0], [1], [2]], [[0, 1], [2, 3], [4, 0]]
_CTX = [[0.5, 0.25, 0.1], [0.0, 1.0, 0.5], [3.0, 2.0, 2.5]]
_LISTS = ", ".join(f"round(m[{k + 1}], 6) AS m{k}" for k in range(3))
_FOLDED = f"SELECT CAST(sid AS BIGINT) AS sid, round(energy, 6) AS energy, {_LISTS} FROM e"


def _folds_sql(rows, d, ctx, *, within_: bool, temperature: float = 1.0, metric: str = "mae") -> str:
    context = "CASE sid " + " ".join(f"WHEN {i} THEN CAST({c} AS DOUBLE[])" for i, c in enumerate(ctx)) + " END"
    return q(
        oracle.ev(cross=not within_), oracle.states(rows), oracle.arms(oracle.sliding(3)), oracle.simplex(d, within=within_), oracle.metric(metric),
        oracle.fold_energy(temperature, context), select=_FOLDED,
    )


def _folds(spark, sf_dir, kind, rows, ctx, temperature=1.0, engine="columns"):
    data = fixtures.events(spark, sf_dir, cross=kind is cross)
    _, e = kind.folds(data=data, folds=event_folds(data), predict=simplex, metric=MAE, weight=softmax(temperature), engine=engine)
    out = e(states(spark, rows, ctx))
    return out.select("sid", r6("energy").alias("energy"), *[r6(F.get("context", F.lit(k))).alias(f"m{k}") for k in range(3)])


@query(_folds_sql(_ONES, 1, [[0.0, 0.0, 0.0]] * 3, within_=False))
def cross_folds_depth1(spark, sf_dir):
    return _folds(spark, sf_dir, cross, _ONES, [[0.0, 0.0, 0.0]] * 3)


@query(_folds_sql(_TWOS, 2, _CTX, within_=False, temperature=0.5))
def cross_folds_depth2(spark, sf_dir):
    return _folds(spark, sf_dir, cross, _TWOS, _CTX, 0.5)


@query(_folds_sql(_TWOS, 2, _CTX, within_=False, temperature=0.5))
def arrow_folds_equiv(spark, sf_dir):
    return _folds(spark, sf_dir, cross, _TWOS, _CTX, 0.5, "arrow")


@query(q(oracle.emb(8), oracle.states(_PAIRS), oracle.LOO_ARMS, oracle.simplex(2, theiler=1), oracle.metric("corr"), select=_ENERGY))
def cross_loo(spark, sf_dir):
    _, e = cross.loo(data=fixtures.embeddings(spark, sf_dir, 8), metric=CORR, theiler_window=1, engine="columns")
    return _energy(e(states(spark, _PAIRS)))


@query(q(oracle.ev(cross=False), oracle.states(_TWOS), oracle.arms([oracle.OUTER]), oracle.simplex(2, within=True), oracle.metric("rmse"), select=_ENERGY))
def within_holdout(spark, sf_dir):
    data = fixtures.events(spark, sf_dir, cross=False)
    _, e = within.holdout(data=data, fold=outer_fold(data), predict=simplex, metric=RMSE, engine="columns")
    return _energy(e(states(spark, _TWOS)))


@query(_folds_sql(_TWOS, 2, _CTX, within_=True))
def within_folds(spark, sf_dir):
    return _folds(spark, sf_dir, within, _TWOS, _CTX)


_WITHIN_LOO_SQL = q(oracle.ev(cross=False), oracle.states(_TWOS[:2]), oracle.LOO_ARMS, oracle.simplex(2, within=True, theiler=2), oracle.metric("mae"), select=_ENERGY)


@query(_WITHIN_LOO_SQL)
def within_loo(spark, sf_dir):
    _, e = within.loo(data=fixtures.events(spark, sf_dir, cross=False), metric=MAE, theiler_window=2, engine="columns")
    return _energy(e(states(spark, _TWOS[:2])))


@query(_WITHIN_LOO_SQL)
def arrow_within_loo_equiv(spark, sf_dir):
    _, e = within.loo(data=fixtures.events(spark, sf_dir, cross=False), metric=MAE, theiler_window=2, engine="arrow")
    return _energy(e(states(spark, _TWOS[:2])))


# The steps of a search, on a queue with ties, NaN and infinity

_LONE = f"""SELECT engine, CAST(sid AS BIGINT) AS sid, true AS undefined, CAST(n AS BIGINT) AS n_rows
  FROM (VALUES ('arrow'), ('columns')) e(engine), (SELECT unnest(range(0, {len(_TWOS)})) AS sid), (SELECT count(*) AS n FROM data WHERE t < 5)"""


@query(q(oracle.ev(cross=True), select=_LONE))
def loo_theiler_excludes_all(spark, sf_dir):
    """Five rows and a window of two: the middle row has no neighbour, so no metric is defined, whatever the engine."""
    data, parts = Subset(fixtures.events(spark, sf_dir, cross=True), range(5)), []
    for engine in ("arrow", "columns"):
        _, e = cross.loo(data=data, metric=MAE, theiler_window=2, engine=engine)
        parts.append(e(states(spark, _TWOS)).select(F.lit(engine).alias("engine"), "sid", F.isnan("energy").alias("undefined"), F.lit(len(data)).cast("long").alias("n_rows")))
    return parts[0].unionByName(parts[1])


_QUEUE = [(0, 2.0), (1, 1.0), (2, float("nan")), (3, 1.0), (4, float("inf")), (5, 3.0), (6, 1.0), (7, -0.5)]
_QUEUE_SQL = "v AS (SELECT * FROM (VALUES " + ", ".join(f"({s}, {e!r}::DOUBLE)" if np.isfinite(e) else f"({s}, '{e}'::DOUBLE)" for s, e in _QUEUE) + ") v(seq, energy))"
_SEQ = "SELECT CAST(seq AS BIGINT) AS seq, CAST(energy AS VARCHAR) AS energy FROM "


def _queue(spark):
    return spark.createDataFrame([(s, [s], [], e) for s, e in _QUEUE], FRONTIER)


def _shown(frame):
    e = F.col("energy")
    return frame.select("seq", F.when(F.isnan(e), "nan").when(e == float("inf"), "inf").otherwise(e.cast("string")).alias("energy"))


@query(q(_QUEUE_SQL, select=_SEQ + "(SELECT *, row_number() OVER (ORDER BY energy, seq) AS rn FROM v) WHERE rn <= 3"))
def pop_topk(spark, sf_dir):
    rows = [tuple(r[c] for c in FRONTIER.names) for r in pop(_queue(spark), 3)[0]]
    return _shown(spark.createDataFrame(rows, FRONTIER))


@query(q(_QUEUE_SQL, select=_SEQ + "(SELECT *, row_number() OVER (ORDER BY energy, seq) AS rn FROM v) WHERE rn > 3"))
def leftover(spark, sf_dir):
    return _shown(pop(_queue(spark), 3)[1])


@query(q(_QUEUE_SQL, select=_SEQ + "v WHERE NOT isnan(energy) AND energy <= 2.0"))
def cutoff_filter(spark, sf_dir):
    return _shown(survivors(_queue(spark), 2.0))


@query(q(_QUEUE_SQL, select=_SEQ + "v WHERE NOT isnan(energy)"))
def cutoff_infinite(spark, sf_dir):
    return _shown(survivors(_queue(spark), float("inf")))


@query(q(_QUEUE_SQL, select=_SEQ + "(SELECT * FROM v UNION ALL SELECT seq + 100, energy FROM v WHERE energy <= 1)"))
def push_union(spark, sf_dir):
    more = survivors(_queue(spark), 1.0).withColumn("seq", F.col("seq") + 100)
    return _shown(_queue(spark).unionByName(more))


@query(q(_QUEUE_SQL, select=_SEQ + "(SELECT * FROM v WHERE NOT isnan(energy) AND seq < 7 ORDER BY energy, seq LIMIT 1)"))
def incumbent_first(spark, sf_dir):
    """Ties go to the earlier row, and an equal later best doesn't replace it."""
    own = survivors(_queue(spark), float("inf"))
    best = incumbent(own.where("seq < 5"), None)
    best = incumbent(own.where("seq between 5 and 6"), best)
    return _shown(spark.createDataFrame([tuple(best[c] for c in FRONTIER.names)], FRONTIER))


# Searches

_TRACE = f"SELECT CAST(depth AS INTEGER) AS depth, {oracle.joined()} AS state, round(energy, 6) AS energy FROM ({{rows}})"


def _trace_sql(depth: int, *, width: int = 1, name: str = "corr") -> str:
    rows = " UNION ALL ".join(f"SELECT * FROM best{d}" for d in range(1, depth + 1))
    return q(oracle.emb(6), oracle.arms([oracle.INNER]), oracle.search(6, depth, name, width=width), select=_TRACE.format(rows=rows))


def _search(spark, sf_dir, make, metric=CORR, engine="auto"):
    data = training(fixtures.embeddings(spark, sf_dir, 6))
    context, e = cross.holdout(data=data, fold=inner_fold(data), predict=simplex, metric=metric, engine=engine)
    return list(make(e, forward(6))(initial_frontier(spark, context), 0))


def _trace(spark, trace):
    return trace_frame(trace, spark).select("depth", text(), r6("energy").alias("energy"))


@query(_trace_sql(3))
def greedy_trace(spark, sf_dir):
    return _trace(spark, _search(spark, sf_dir, lambda e, n: greedy(e, n, depth=3)))


@query(_trace_sql(2))
def greedy_trace_columns(spark, sf_dir):
    return _trace(spark, _search(spark, sf_dir, lambda e, n: greedy(e, n, depth=2), engine="columns"))


@query(_trace_sql(3, width=2).replace(oracle.joined(), oracle.joined("list_sort(state)")))
def beam_trace(spark, sf_dir):
    """States as sets: a wider beam reaches a set in several orders, which tie."""
    found = trace_frame(_search(spark, sf_dir, lambda e, n: beam(e, n, width=2, depth=3, beams=1)), spark)
    return found.withColumn("state", F.array_sort("state")).select("depth", text(), r6("energy").alias("energy"))


@query(_trace_sql(2, width=2).replace(oracle.joined(), oracle.joined("list_sort(state)")))
def chokudai_trace(spark, sf_dir):
    """Width one twice: at depth two the same states as one pass of width two."""
    found = trace_frame(_search(spark, sf_dir, lambda e, n: beam(e, n, width=1, depth=2, beams=2)), spark)
    return found.withColumn("state", F.array_sort("state")).select("depth", text(), r6("energy").alias("energy"))


_TABLE = {"0": 0.0, "1": 1.0, "2": 2.0, "0,1": 10.0, "0,2": 11.0, "1,0": 8.0, "1,2": -5.0}


def table_energy(table: dict[str, float]):
    """An energy that looks states up."""

    def energy(frame: DataFrame) -> DataFrame:
        pairs = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
        return frame.withColumn("energy", F.coalesce(F.element_at(pairs, F.array_join(F.col("state").cast("array<string>"), ",")), F.lit(float("nan"))))

    return energy


def ascending(n: int):
    """Forward expansion with children in order of column."""

    def neighbours(parents, seed, step):
        return expand(parents, n).withColumn("child_rank", F.expr("row_number() over (partition by rank order by child) - 1"))

    return neighbours


@query(
    "SELECT * FROM (VALUES (1, 1, 1, '0', 0.0::DOUBLE), (1, 1, 2, '0,1', 10.0), (1, 2, 1, '0', 0.0), (1, 2, 2, '1,2', -5.0), (2, 1, 1, '0', 0.0), (2, 1, 2, '1,2', -5.0)) "
    "v(width, beams, depth, state, energy)"
)
def worked_example(spark, sf_dir):
    out = []
    for width, beams in ((1, 1), (1, 2), (2, 1)):
        s = beam(table_energy(_TABLE), ascending(3), width=width, depth=2, beams=beams)
        found = trace_frame(list(s(frontier(spark, [[]], [[]], [float("inf")]), 0)), spark)
        out.append(found.select(F.lit(width).alias("width"), F.lit(beams).alias("beams"), "depth", text(), "energy"))
    return reduce(DataFrame.unionByName, out)


@query("SELECT * FROM (VALUES (1, '0,2', 1.5::DOUBLE), (2, '0,2,1', -2.0)) v(depth, state, energy)")
def many_starts(spark, sf_dir):
    """A search may start from several states, of any length; depth counts steps."""
    table = {"0,1": 3.0, "0,2": 1.5, "1,0": 2.0, "1,2": float("nan"), "0,2,1": -2.0, "1,0,2": 0.0}
    start = frontier(spark, [[0], [1]], [[], []], [1.0, 1.0])
    found = list(beam(table_energy(table), ascending(3), width=2, depth=2, beams=1)(start, 0))
    return trace_frame(found, spark).select("depth", text(), "energy")


_SMAP = [[0, 1], [2, 3]]


@query()
def smap_holdout(spark, sf_dir):
    """Another predictor than simplex projection: locally weighted linear maps, fitted by least squares on the executors."""
    data = fixtures.embeddings(spark, sf_dir, 8)
    _, e = cross.holdout(data=data, fold=outer_fold(data), predict=smap(1.0), metric=MAE)
    return _energy(e(states(spark, _SMAP)))


# Embedding and scan

_LAGS = "emb AS (SELECT t, [v, lag(v, 2) OVER (ORDER BY t), lag(v, 4) OVER (ORDER BY t)] AS x FROM (SELECT t, x[3] AS v FROM hourly))"


@query(q(oracle.HOURLY, _LAGS, select="SELECT t, " + ", ".join(f"round(CAST(x[{k + 1}] AS DOUBLE), 3) AS x{k}" for k in range(3)) + " FROM emb WHERE t >= 4"))
def lag_embedding(spark, sf_dir):
    return _numbers(lag_embed(fixtures.hourly_events(spark, sf_dir).select("t", F.get("x", F.lit(2)).alias("v")), E=3, tau=2))


_GRID = {"E": (1, 2), "tau": (1, 2), "columns": (0, 1, 2, 3, 4)}
#: The grid of the documented experiment.
_FULL_GRID = {"E": range(1, 11), "tau": range(1, 6)}


def _scan_ctes() -> list[str]:
    out, rows = [oracle.ev(cross=True)], []
    for e in _GRID["E"]:
        for lag in _GRID["tau"]:
            n = f"({oracle.N} - {(e - 1) * lag})"
            cut = oracle.part(n, 0.8)
            for c in _GRID["columns"]:
                tag = f"_{c}_{e}_{lag}"
                lags = ", ".join(f"lag(x[{c + 1}], {k * lag}) OVER (ORDER BY t)" for k in range(e))
                out.append(f"d{tag} AS (SELECT t - {(e - 1) * lag} AS t, x, y FROM (SELECT t, [{lags}] AS x, y FROM data) WHERE t >= {(e - 1) * lag})")
                out.append(oracle.arms([(("0", cut), (cut, n))], source=f"d{tag}", tag=tag))
                out.append(f"s{tag} AS (SELECT 0 AS sid, CAST({list(range(e))} AS BIGINT[]) AS state)")
                out += [oracle.simplex(e, s=f"s{tag}", tag=tag, arm=tag), oracle.metric("mean_rho", tag)]
                rows.append(f"SELECT {c} AS col, {e} AS E, {lag} AS tau, value AS score FROM m{tag}")
    return [*out, "grid AS (" + " UNION ALL ".join(rows) + ")"]


def _scan(spark, sf_dir):
    return embedding.scan(fixtures.events(spark, sf_dir, cross=True).frame, **_GRID)


@query(q(*_scan_ctes(), select="SELECT col, E, tau, round(score, 6) AS score FROM grid"))
def scan_grid(spark, sf_dir):
    return _scan(spark, sf_dir).select("col", "E", "tau", r6("score").alias("score"))


@query(q(*_scan_ctes(), select="SELECT col, E, tau, round(score, 6) AS score FROM grid"))
def scan_grid_columns(spark, sf_dir):
    """The same by one top-k over a table of all cells."""
    out = embedding.scan(fixtures.events(spark, sf_dir, cross=True).frame, **_GRID, engine="columns")
    return out.select("col", "E", "tau", r6("score").alias("score"))


def _past_sql(e: int, lag: int) -> str:
    return "[" + ", ".join(f"lag(v, {k * lag}) OVER w" for k in range(e)) + "]"


#: A row for each column, time and cell of the grid: the cell's number of rows, the row's place among them and its past.
_CELLS = " UNION ALL ".join(
    f"SELECT col, {e} AS E, {lag} AS tau, {oracle.N} - {(e - 1) * lag} AS n, t - {(e - 1) * lag} AS p, {_past_sql(e, lag)} AS x, y FROM line WINDOW w AS (PARTITION BY col ORDER BY t)"
    for e in _FULL_GRID["E"] for lag in _FULL_GRID["tau"]
)
_FULL_SCAN = [
    oracle.ev(cross=True),
    "line AS (SELECT t, col, x[col + 1] AS v, CAST(y[1] AS DOUBLE) AS y FROM data, (SELECT unnest(range(0, 5)) AS col))",
    f"cells AS MATERIALIZED (SELECT *, CAST(floor(n * 0.8 + 1e-9) AS BIGINT) AS cut FROM ({_CELLS}) WHERE p >= 0)",
    """near AS (SELECT *, greatest(exp(-dist / greatest(min(dist) OVER (PARTITION BY col, E, tau, tq), 1e-6)), 1e-6) AS w FROM (
        SELECT q.col, q.E, q.tau, q.p AS tq, q.y AS obs, l.p AS tl, l.y AS yl,
               sqrt(list_sum(list_transform(list_zip(q.x, l.x), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2)))) AS dist
        FROM cells q JOIN cells l ON q.col = l.col AND q.E = l.E AND q.tau = l.tau WHERE q.p >= q.cut AND l.p < l.cut
        QUALIFY row_number() OVER (PARTITION BY q.col, q.E, q.tau, q.p ORDER BY dist, l.p) <= q.E + 1))""",
    "pred AS (SELECT col, E, tau, tq, sum(w * yl) / sum(w) AS pred, max(obs) AS obs FROM near GROUP BY ALL)",
    "grid AS (SELECT col, E, tau, covar_pop(pred, obs) / nullif(stddev_pop(pred) * stddev_pop(obs), 0) AS score FROM pred GROUP BY ALL)",
]


@query(q(*_FULL_SCAN, select="SELECT CAST(col AS INTEGER) AS col, E, tau, round(score, 6) AS score FROM grid"))
def scan_full_grid(spark, sf_dir):
    """All columns with ten dimensions and five lags, as in the documented experiment."""
    out = embedding.scan(fixtures.events(spark, sf_dir, cross=True).frame, columns=range(5), **_FULL_GRID)
    return out.select("col", "E", "tau", r6("score").alias("score"))


_BEST = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY round(score, 9) DESC, E, tau) AS rn FROM grid WHERE score IS NOT NULL) WHERE rn = 1)"


@query(q(*_scan_ctes(), _BEST, select="SELECT col, E, tau, round(score, 6) AS score FROM best"))
def select_best(spark, sf_dir):
    rounded = _scan(spark, sf_dir).withColumn("score", F.round("score", 9))
    return embedding.select_best(rounded).select("col", "E", "tau", r6("score").alias("score"))


@query(q(*_scan_ctes(), _BEST, select="SELECT col, E, tau, round(score, 6) AS score FROM best WHERE score > 0.02"))
def prefilter(spark, sf_dir):
    rounded = _scan(spark, sf_dir).withColumn("score", F.round("score", 9))
    return embedding.prefilter(rounded, 0.02).select("col", "E", "tau", r6("score").alias("score"))


# Experiments


def _checked_ctes(depth: int, name: str = "corr") -> list[str]:
    return [oracle.emb(6), oracle.arms([oracle.INNER]), oracle.search(6, depth, name), oracle.validation(depth, name, oracle.OUTER)]


def _checked(spark, sf_dir, depth: int, metric=CORR):
    trace = trace_frame(_search(spark, sf_dir, lambda e, n: greedy(e, n, depth=depth), metric), spark)
    data = fixtures.embeddings(spark, sf_dir, 6)
    return validate_trace(trace, data, outer_fold(data), metric=metric)


@query(q(*_checked_ctes(2), select=f"SELECT CAST(depth AS INTEGER) AS depth, {oracle.joined()} AS state, round(energy, 6) AS energy, round(validation, 6) AS validation FROM checked"))
def trace_validation(spark, sf_dir):
    return _checked(spark, sf_dir, 2).select("depth", text(), r6("energy").alias("energy"), r6("validation").alias("validation"))


@query(q(*_checked_ctes(2), select="SELECT CAST(depth AS INTEGER) AS best_step, round(validation, 6) AS validation FROM checked ORDER BY checked.validation, depth LIMIT 1"))
def best_validated_step(spark, sf_dir):
    return best_step(_checked(spark, sf_dir, 2)).select("best_step", r6("validation").alias("validation"))


@query(q(*_checked_ctes(2), select="SELECT CAST(depth AS INTEGER) AS depth, CAST(len(list_intersect(state, CAST([0, 2, 4] AS BIGINT[]))) AS INTEGER) AS recovered FROM checked"))
def recovered_columns(spark, sf_dir):
    return recovery_count(_checked(spark, sf_dir, 2), [0, 2, 4])


def _sweep_part(name: str) -> str:
    ctes = q(*_checked_ctes(2, name), select=f"SELECT '{name}' AS metric, 'holdout' AS energy, 'greedy' AS strategy, CAST(depth AS INTEGER) AS step, {oracle.joined()} AS selected, round(energy, 6) AS train, round(validation, 6) AS validation FROM checked")
    return f"SELECT * FROM ({ctes})"


@query(" UNION ALL ".join(_sweep_part(m) for m in ("mae", "corr")))
def sweep_small(spark, sf_dir):
    holdout = lambda data, metric: cross.holdout(data=data, fold=inner_fold(data), predict=simplex, metric=metric)
    data = fixtures.embeddings(spark, sf_dir, 6)
    out = sweep(data, metrics=[MAE, CORR], energies={"holdout": holdout}, strategies={"greedy": lambda e, n: greedy(e, n, depth=2)})
    return out.select("metric", "energy", "strategy", "step", text("selected"), r6("train").alias("train"), r6("validation").alias("validation"))


@query()
def sweep_full(spark, sf_dir):
    """Three metrics, five energies and two strategies, 30 searches on the events; each state has its validation."""
    data = fixtures.events(spark, sf_dir, cross=False)
    build = {
        "cross_holdout": lambda d, m: cross.holdout(data=d, fold=inner_fold(d), predict=simplex, metric=m),
        "cross_folds": lambda d, m: cross.folds(data=d, folds=event_folds(d), predict=simplex, metric=m, weight=softmax()),
        "cross_loo": lambda d, m: cross.loo(data=d, metric=m, theiler_window=2),
        "within_folds": lambda d, m: within.folds(data=d, folds=event_folds(d), predict=simplex, metric=m, weight=softmax()),
        "within_loo": lambda d, m: within.loo(data=d, metric=m, theiler_window=2),
    }
    strategies = {"greedy": lambda e, n: greedy(e, n, depth=3), "beam": lambda e, n: beam(e, n, width=1, depth=3, beams=3)}
    out = sweep(data, metrics=[MAE, RMSE, CORR], energies=build, strategies=strategies)
    return out.select("metric", "energy", "strategy", "step", text("selected"), r6("train").alias("train"), r6("validation").alias("validation"))


@query()
def lorenz96_recovery(spark, sf_dir):
    """Which of the six signal columns among 24 a greedy search to depth 8 finds, of those that the scan of lag embeddings
    keeps: 2000 generated rows, no SQL. Four of them enter the target's equation."""
    data, informative = lorenz96_dataset(spark, T=2000)
    train = training(data)
    good = [r["col"] for r in embedding.prefilter(embedding.scan(train.frame, columns=range(data.widths[0]), **_FULL_GRID), 0.1).orderBy("col").collect()]
    mask = [i in good for i in range(data.widths[0])]
    kept = Dataset.from_frame(mask_columns(mask)(data.frame))
    found = subset_search(kept, depth=min(8, len(good)))
    return found.join(recovery_count(found, [good.index(i) for i in informative if i in good]), "depth").select("depth", text(), "energy", "validation", "recovered")


_EMBEDDED = 64
_FLAGSHIP = [[j] for j in range(_EMBEDDED)]


@query(q(oracle.emb(_EMBEDDED), oracle.states(_FLAGSHIP), oracle.arms([oracle.INNER]), oracle.simplex(1), oracle.metric("corr"), select=_ENERGY))
def single_columns(spark, sf_dir):
    return flagship(spark, sf_dir)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every single column scored on the inner fold, best first: greedy depth one."""
    data = training(fixtures.embeddings(spark, sf_dir, _EMBEDDED))
    _, e = cross.holdout(data=data, fold=inner_fold(data), predict=simplex, metric=CORR)
    return _energy(e(states(spark, _FLAGSHIP))).orderBy("energy", "sid")
