import pytest
from common_checks import SF, same_rows

from facetta import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, duck, name):
    same_rows(catalogue.queries()[name](spark, SF), duck, catalogue.oracle_sql()[name])


def test_every_query_without_sql_is_known():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"lorenz96_recovery", "smap_holdout", "sweep_full"}


def test_lorenz96_recovery(spark):
    rows = catalogue.queries()["lorenz96_recovery"](spark, SF).collect()
    depths = sorted(r["depth"] for r in rows)
    assert depths == list(range(1, len(depths) + 1)) and len(depths) >= 6
    # The target's equation names four sites: itself, its right neighbour and two to the left. They come first, and no other helps.
    recovered = {r["depth"]: r["recovered"] for r in rows}
    assert recovered[4] == 4 and min(rows, key=lambda r: r["validation"])["depth"] == 4


def test_sweep_full(spark):
    rows = catalogue.queries()["sweep_full"](spark, SF).collect()
    assert len({(r["metric"], r["energy"], r["strategy"]) for r in rows}) == 30 and len(rows) == 90
    best = {(r["metric"], r["energy"], r["strategy"], r["step"]): r["train"] for r in rows}
    assert all(best[m, e, "beam", k] <= v + 1e-6 for (m, e, s, k), v in best.items() if s == "greedy")


def test_flagship_is_ordered(spark):
    rows = catalogue.flagship(spark, SF).collect()
    assert [r["energy"] for r in rows] == sorted(r["energy"] for r in rows)


def test_smap_holdout(spark):
    """The same numbers from the predictor on arrays."""
    import numpy as np
    from facetta.catalogue import _SMAP
    from facetta.fixtures import embeddings
    from facetta.operators import smap

    rows = embeddings(spark, SF, 8).frame.orderBy("t").collect()
    x, y = (np.array([r[c] for r in rows]) for c in "xy")
    cut = int(len(x) * 0.8 + 1e-9)
    got = {r["sid"]: r["energy"] for r in catalogue.queries()["smap_holdout"](spark, SF).collect()}
    for i, s in enumerate(_SMAP):
        want = np.abs(smap(1.0)(x[:cut][:, s], y[:cut], x[cut:][:, s]) - y[cut:]).mean()
        assert got[i] == pytest.approx(want, abs=1e-6)


def test_driver_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 64
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
