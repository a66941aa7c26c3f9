"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..work import few_files, staged, unstage

__all__ = ["few_files", "join_grouped", "repeated", "row_hash", "staged", "table", "unstage", "utf8_bytes"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_hash(seed: int, *cols: Column) -> Column:
    """Unsigned-looking 63-bit hash of a row's columns, the same on every rerun."""
    return F.xxhash64(F.lit(seed).cast("long"), *cols).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def repeated(df: DataFrame, column: str) -> bool:
    """Whether any value of a hash column comes again; only the hashes are shuffled."""
    return not df.groupBy(column).count().where("count > 1").isEmpty()


def utf8_bytes(text: Column) -> Column:
    """Bytes of a text in UTF-8; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


#: Rows up to which a table with a row per group is broadcast; beyond it the join is a salted shuffle.
BROADCAST_GROUPS = 50_000
SALT = 64


def join_grouped(df: DataFrame, groups: DataFrame, keys: dict[str, str], rows: int, spread: Column, *, most: int = BROADCAST_GROUPS) -> DataFrame:
    """Left join of ``groups``, which has ``rows`` rows, one a group, to ``df``; null keys are equal to each other.

    ``keys`` maps columns of ``df`` to those of ``groups``, which go. Up to ``most`` rows are broadcast. More are
    joined by shuffle, each of them SALT times, with the rows of ``df`` dealt by the hash ``spread``: no task gets a hot
    group whole.
    """
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in keys.items()]
    if rows <= most:
        return df.join(F.broadcast(groups), same, "left").drop(*keys.values())
    left = df.withColumn("__s1", F.pmod(spread, F.lit(SALT)).cast("int"))
    right = groups.withColumn("__s2", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return left.join(right, [*same, F.col("__s1") == F.col("__s2")], "left").drop(*keys.values(), "__s1", "__s2")
