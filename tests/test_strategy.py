import numpy as np
import pytest
from pyspark.sql import functions as F

from facetta.catalogue import ascending, table_energy
from facetta.operators import forward
from facetta.plans import beam, exhaustive, greedy
from facetta.plans.strategy import frontier


def accumulating(seed):
    """Context carries the sum of column values so far: a misrouted context changes every energy below it."""

    def energy(frame):
        last = F.get("state", F.size("state") - 1)
        value = F.pmod(F.hash(F.lit(seed), last, F.size("state")), F.lit(997)).cast("double") / 100 - 4
        grown = F.coalesce(F.get("context", F.lit(0)), F.lit(0.0)) + value
        return frame.withColumn("energy", grown).withColumn("context", F.array(grown))

    return energy


def start(spark):
    return frontier(spark, [[]], [[0.0]], [float("inf")])


def run(spark, strategy, seed=0):
    return [(f.state, round(f.energy, 9)) for f in strategy(start(spark), seed)]


def plain_beam(table, n, width, depth, beams, cutoff=float("inf")):
    """The same search over lists."""
    queues, best, seq = [[(float("inf"), 0, ())]] + [[] for _ in range(depth)], [None] * (depth + 1), 1
    for _ in range(beams):
        for d in range(depth):
            queues[d].sort(key=lambda r: (np.isnan(r[0]), r[0], r[1]))
            top, queues[d] = queues[d][:width], queues[d][width:]
            for _, _, s in top:
                for j in range(n):
                    if j in s:
                        continue
                    e = table.get(",".join(map(str, (*s, j))), float("nan"))
                    if e <= cutoff:
                        queues[d + 1].append((e, seq, (*s, j)))
                        if best[d + 1] is None or e < best[d + 1][1]:
                            best[d + 1] = ((*s, j), e)
                    seq += 1
    out = []
    for b in best[1:]:
        if b is None:
            break
        out.append((list(b[0]), b[1]))
    return out


@pytest.mark.parametrize("seed, width, beams, cutoff", [(1, 1, 2, float("inf")), (2, 2, 1, 1.5), (3, 2, 2, 2.0), (4, 3, 1, -9.0)])
def test_beam_matches_lists(spark, seed, width, beams, cutoff):
    rng = np.random.default_rng(seed)
    values = [0.0, 1.0, 1.0, 2.0, float("nan"), float("inf"), -1.0]
    states = [(a,) for a in range(3)] + [(a, b) for a in range(3) for b in range(3) if a != b] + [(0, 1, 2), (2, 1, 0), (1, 0, 2), (0, 2, 1), (1, 2, 0), (2, 0, 1)]
    table = {",".join(map(str, s)): values[rng.integers(len(values))] for s in states}
    got = run(spark, beam(table_energy(table), ascending(3), width=width, depth=4, beams=beams, cutoff=cutoff))
    assert got == plain_beam(table, 3, width, 4, beams, cutoff)


def test_context_follows_its_state(spark):
    e, n = accumulating(7), forward(4)
    trace = list(beam(e, n, width=2, depth=3, beams=2)(start(spark), 5))
    for f in trace:
        s, total = f.state, 0.0
        for k in range(len(s)):
            row = spark.createDataFrame([(0, s[: k + 1], [total])], "sid long, state array<bigint>, context array<double>")
            total = e(row).first()["energy"]
        assert f.energy == pytest.approx(total)


def test_wide_beam_is_exhaustive_and_bounds_narrow(spark):
    e, n = accumulating(11), forward(4)
    full = run(spark, exhaustive(e, n, depth=3))
    assert [x[1] for x in run(spark, beam(e, n, width=400, depth=3, beams=1))] == [x[1] for x in full]
    one, two = (run(spark, beam(e, n, width=1, depth=3, beams=b)) for b in (1, 2))
    assert all(f[1] <= b[1] <= a[1] for a, b, f in zip(one, two, full))
    assert run(spark, greedy(e, n, depth=3)) == one
    assert run(spark, greedy(e, n, depth=3)) == one  # the same seed


@pytest.mark.parametrize("depth, cutoff, steps", [(0, float("inf"), 0), (5, float("inf"), 3), (3, -100.0, 0)])
def test_trace_ends_where_nothing_is_reached(spark, depth, cutoff, steps):
    assert len(run(spark, greedy(accumulating(1), forward(3), depth=depth, cutoff=cutoff))) == steps


@pytest.mark.parametrize("bad, words", [({"width": 0}, "width"), ({"depth": -1}, "depth"), ({"beams": 0}, "beams")])
def test_beam_invalid(bad, words):
    with pytest.raises(ValueError, match=words):
        beam(None, None, **({"width": 1, "depth": 1, "beams": 1} | bad))


def test_forward(spark):
    with pytest.raises(ValueError, match="n must be non-negative"):
        forward(-1)
    parents = spark.createDataFrame([(0, [2], []), (1, [0], [])], "rank long, state array<bigint>, context array<double>")
    a, b = (sorted(map(tuple, forward(4)(parents, 1, 0).select("rank", "child_rank", F.col("state")[1]).collect())) for _ in range(2))
    assert a == b and {x[:1] + x[2:] for x in a} == {(0, 0), (0, 1), (0, 3), (1, 1), (1, 2), (1, 3)}
    assert [x[1] for x in a] == [0, 1, 2, 0, 1, 2]
    assert forward(0)(parents, 1, 0).count() == 0
