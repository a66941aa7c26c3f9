"""Chokudai search over frames of states.

There is one queue per depth. A pass pops the ``width`` best states of each queue in turn, expands and scores them, and
pushes the children to the next queue. Popped states are at most ``width`` rows and go through the driver; a queue is a
union of scored frames, each computed from its literal parents, so its lineage is one expansion deep however long the
search, and lost partitions are cheap to compute again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import pairwise

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.energy import Energy
from ..work import staged

FRONTIER = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("state", T.ArrayType(T.LongType())),
        T.StructField("context", T.ArrayType(T.DoubleType())),
        T.StructField("energy", T.DoubleType()),
    ]
)


@dataclass(frozen=True)
class Frontier:
    """States with contexts and energies; ``seq`` is their order of insertion."""

    frame: DataFrame

    def __len__(self) -> int:
        return self.frame.count()

    def rows(self) -> list[Row]:
        return self.frame.orderBy("seq").collect()

    @property
    def state(self) -> list[int]:
        return list(self.rows()[0]["state"])

    @property
    def energy(self) -> float:
        return self.rows()[0]["energy"]


Strategy = Callable[[Frontier, int], Iterator[Frontier]]


def frontier(spark: SparkSession, states, contexts, energies) -> Frontier:
    """From lists."""
    if not len(states) == len(contexts) == len(energies):
        raise ValueError(f"states, contexts and energies must have the same length, got {len(states)}, {len(contexts)}, {len(energies)}")
    rows = [(i, [int(v) for v in s], [float(v) for v in c], float(e)) for i, (s, c, e) in enumerate(zip(states, contexts, energies))]
    return Frontier(spark.createDataFrame(rows, FRONTIER))


def initial_frontier(spark: SparkSession, context) -> Frontier:
    """The empty state with the energy's first context."""
    return frontier(spark, [[]], [list(context)], [float("inf")])


def _best(queue: DataFrame, width: int) -> list[Row]:
    """The ``width`` rows of least (energy, seq), NaN last: each partition sends its best ``width`` rows."""
    return queue.orderBy("energy", "seq").limit(width).collect()


def _behind(queue: DataFrame, last: Row) -> DataFrame:
    return queue.where(F.struct("energy", "seq") > F.struct(F.lit(last["energy"]).alias("energy"), F.lit(last["seq"]).alias("seq")))


def pop(queue: DataFrame, width: int) -> tuple[list[Row], DataFrame]:
    """The ``width`` rows of least (energy, seq), NaN last, and the rest of the queue."""
    top = _best(queue, width)
    return (top, _behind(queue, top[-1])) if top else (top, queue)


def survivors(children: DataFrame, cutoff: float) -> DataFrame:
    """Rows of at most ``cutoff``; NaN and null go even if there is none."""
    return children.where(~F.isnan("energy") & (F.col("energy") <= F.lit(float(cutoff))))


def incumbent(children: DataFrame, best: Row | None) -> Row | None:
    """The first row of least energy, if it's lower than ``best``."""
    first = children.orderBy("energy", "seq").limit(1).collect()
    if first and (best is None or first[0]["energy"] < best["energy"]):
        return first[0]
    return best


def _at_least(**limits: tuple[int, int]) -> None:
    for name, (value, least) in limits.items():
        if value < least:
            raise ValueError(f"{name}: {value} is below {least}")


def _score(E, N, children: DataFrame, size: int, parents: int) -> DataFrame:  # noqa: N803
    """Children with energies; a built-in energy need not look at what a built-in neighborhood has made."""
    own = getattr(N, "children", None)
    return E(children, size=size, count=parents * own) if isinstance(E, Energy) and own else E(children)


def _order(row: Row) -> tuple:
    return math.isnan(row["energy"]), row["energy"], row["seq"]


@dataclass
class _Pushed:
    """What is left of a frame of scored states; ``rows``, if known, are its best, and ``all`` of it if it has no others."""

    frame: DataFrame
    rows: list[Row] | None = None
    all: bool = False

    def best(self, width: int) -> list[Row]:
        if self.rows is None:
            self.rows = _best(self.frame, width)
            self.all = len(self.rows) < width
        return self.rows

    def without(self, top: list[Row]) -> _Pushed | None:
        last = _order(top[-1])
        kept = [r for r in self.rows if _order(r) > last]
        if self.all:
            return _Pushed(_behind(self.frame, top[-1]), kept, True) if kept else None
        return _Pushed(_behind(self.frame, top[-1])) if len(kept) < len(self.rows) else self


@dataclass
class _Depth:
    """What a search holds of one depth: the frames waiting there, and the best state seen."""

    waiting: list[_Pushed] = field(default_factory=list)
    best: Row | None = None

    def take(self, width: int) -> list[Row]:
        """The best rows of all frames, by the best of each: one job for each frame that isn't known yet."""
        top = sorted((r for p in self.waiting for r in p.best(width)), key=_order)[:width]
        self.waiting = [left for p in self.waiting if (left := p.without(top))] if top else []
        return top

    def put(self, scored: DataFrame, width: int) -> None:
        pushed = _Pushed(scored)
        first = pushed.best(width)[:1]
        if first:
            self.waiting.append(pushed)
            if self.best is None or first[0]["energy"] < self.best["energy"]:
                self.best = first[0]


def _single(spark: SparkSession, row: Row) -> Frontier:
    return Frontier(spark.createDataFrame([tuple(row[c] for c in FRONTIER.names)], FRONTIER))


def beam(E, N, *, width: int, depth: int, beams: int, cutoff: float = float("inf")) -> Strategy:  # noqa: N803
    """``beams`` passes of width ``width`` over ``depth`` queues; yields the best state of each depth, as far as reached.

    ``E`` is an energy, ``N`` a neighborhood. Popped states never return. Children over ``cutoff`` are dropped.
    """
    _at_least(width=(width, 1), depth=(depth, 0), beams=(beams, 1))

    def search(initial: Frontier, seed: int = 0) -> Iterator[Frontier]:
        spark = initial.frame.sparkSession
        levels = [_Depth([_Pushed(initial.frame.select(*FRONTIER.names))]), *(_Depth() for _ in range(depth))]
        cached: list[DataFrame] = []
        base = 1 + (initial.frame.agg(F.max("seq")).first()[0] or 0)
        for here, after in [pair for _ in range(beams) for pair in pairwise(levels)]:
            top = here.take(width)
            if not top:
                continue
            parents = spark.createDataFrame([(i, r["state"], r["context"]) for i, r in enumerate(top)], "rank long, state array<bigint>, context array<double>")
            # Lexicographic in (push, parent, child): a parent has fewer than 2**31 children.
            seq = F.lit(base) + F.col("rank") * (1 << 31) + F.col("child_rank")
            children = N(parents, seed, len(cached)).select(seq.alias("sid"), "state", "context")
            base += len(top) << 31
            scored = _score(E, N, children, len(top[0]["state"]) + 1, len(top))
            cached.append(survivors(scored, cutoff).select(F.col("sid").alias("seq"), "state", "context", "energy").persist())
            after.put(cached[-1], width)
        for frame in cached:
            frame.unpersist()
        for level in levels[1:]:
            if level.best is None:
                return
            yield _single(spark, level.best)

    return search


def greedy(E, N, *, depth: int, cutoff: float = float("inf")) -> Strategy:  # noqa: N803
    """One pass of width one."""
    return beam(E, N, width=1, depth=depth, beams=1, cutoff=cutoff)


def exhaustive(E, N, *, depth: int, cutoff: float = float("inf")) -> Strategy:  # noqa: N803
    """Every state whose prefixes survive the cutoff: the truth that the others approach.

    Each depth is a table in the shared folder, expanded and scored as a whole; only the best state of a depth, the first
    in order of its columns on ties, comes to the driver. States of a start have one length.
    """
    _at_least(depth=(depth, 0))

    def search(initial: Frontier, seed: int = 0) -> Iterator[Frontier]:
        spark = initial.frame.sparkSession
        level = initial.frame.select(*FRONTIER.names)
        for step in range(depth):
            parents = level.select(F.monotonically_increasing_id().alias("rank"), "state", "context")
            children = N(parents, seed, step).select(F.monotonically_increasing_id().alias("sid"), "state", "context")
            children = staged(children, "children")  # numbers must not change when tasks run again
            level = staged(survivors(E(children), cutoff).select(F.col("sid").alias("seq"), "state", "context", "energy"), "level")
            best = level.orderBy("energy", "state").limit(1).collect()
            if not best:
                return
            yield _single(spark, best[0])

    return search


def trace_frame(trace: list[Frontier], spark: SparkSession) -> DataFrame:
    """``depth``, ``state``, ``context``, ``energy`` of a trajectory."""
    rows = [(k, r["state"], r["context"], r["energy"]) for k, f in enumerate(trace, 1) for r in f.rows()]
    return spark.createDataFrame(rows, "depth int, state array<bigint>, context array<double>, energy double")


def write_trace(trace: DataFrame, path: str) -> None:
    """A trajectory as Parquet, one file."""
    trace.coalesce(1).write.mode("overwrite").parquet(path)
