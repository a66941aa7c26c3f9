"""Expansion of states: from a frame of parents (``rank``, ``state``, ``context``) to one of children."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keyed import hash48

Neighborhood = Callable[[DataFrame, int, int], DataFrame]


def initial(spark: SparkSession) -> DataFrame:
    """The empty state."""
    return spark.range(1).select(F.array().cast("array<bigint>").alias("state"))


def expand(parents: DataFrame, n: int) -> DataFrame:
    """Each parent once for every column it hasn't got, that column appended; ``child`` is the column.

    Generated from the parent's row: no join.
    """
    columns = F.sequence(F.lit(0), F.lit(n - 1)) if n else F.array().cast("array<int>")
    each = parents.withColumn("child", F.explode(columns))
    free = each.where(~F.array_contains("state", F.col("child").cast("bigint")))
    return free.withColumn("state", F.concat("state", F.array(F.col("child").cast("bigint"))))


def forward(n: int) -> Neighborhood:
    """Append one unused column of ``n``; children of a parent come in random order, parents keep theirs.

    The order depends on seed, step, parent and column only. ``child_rank`` counts from 0 in each parent.
    """
    if n < 0:
        raise ValueError(f"n must be non-negative, got {n}")

    def neighbours(parents: DataFrame, seed: int, step: int) -> DataFrame:
        # Sorted in the parent's own row: no exchange.
        free = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: ~F.array_contains("state", j.cast("bigint"))) if n else F.array().cast("array<int>")
        order = F.array_sort(F.transform(free, lambda j: F.struct(hash48(seed, step, F.col("rank"), j).alias("h"), j.alias("child"))))
        each = parents.select("*", F.posexplode(order).alias("child_rank", "__c")).withColumn("child", F.col("__c.child")).drop("__c")
        return each.withColumn("state", F.concat("state", F.array(F.col("child").cast("bigint"))))

    neighbours.children = n  # of a parent at most, each one column longer, all valid
    return neighbours


def enumerate_states(spark: SparkSession, n: int, depth: int) -> DataFrame:
    """All ordered selections of up to ``depth`` of ``n`` columns, the empty one included, by a recursive query."""
    return spark.sql(f"""
        WITH RECURSIVE s(state, d) AS (
          SELECT CAST(array() AS ARRAY<BIGINT>), 0
          UNION ALL
          SELECT concat(state, array(id)), d + 1 FROM s CROSS JOIN range({int(n)})
          WHERE d < {int(depth)} AND NOT array_contains(state, id)
        ) SELECT state, d AS depth FROM s""")
