"""Series derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources import Dataset, horizon_shift

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
START = "2024-01-01 00:00:00"


def embeddings(spark: SparkSession, sf_dir: str, d: int) -> Dataset:
    """Row = vector, columns = its first ``d`` values, target = the next vector's first value."""
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    frame = raw.select(F.col("vec_id").alias("t"), F.slice("embedding", 1, d).alias("x"), F.array(F.get("embedding", F.lit(0))).alias("y"))
    return Dataset.from_frame(horizon_shift(frame, 1))


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``t`` (hours from the start), ``x`` (total value of each event type), with a row for each hour up to the last event."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    hour = F.expr(f"timestampdiff(HOUR, timestamp_ntz'{START}', ts)")
    sums = [F.coalesce(F.round(F.sum(F.when(F.col("event_type") == e, F.col("value"))), 4), F.lit(0.0)) for e in EVENT_TYPES]
    found = raw.groupBy(hour.cast("long").alias("t")).agg(F.array(*sums).cast("array<float>").alias("x"))
    hours = found.agg(F.max("t").alias("last")).select(F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("t"))
    none = F.array(*[F.lit(0.0)] * len(EVENT_TYPES)).cast("array<float>")
    return hours.join(found, "t", "left").select("t", F.coalesce("x", none).alias("x"))


def events(spark: SparkSession, sf_dir: str, *, cross: bool) -> Dataset:
    """Target: the next hour's ``purchase`` (cross), or all its columns (within)."""
    frame = hourly_events(spark, sf_dir).withColumn("y", F.slice("x", 3, 1) if cross else F.col("x"))
    return Dataset.from_frame(horizon_shift(frame, 1))


def daily_lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``t`` (rank of the ship day), ``x`` (the day's sums); ranks run over one row a day."""
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    names = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    days = raw.groupBy(F.to_date("l_shipdate").alias("day")).agg(F.array(*[F.round(F.sum(c), 4) for c in names]).alias("x"))
    return days.select(F.expr("dense_rank() over (order by day) - 1").cast("long").alias("t"), "x", F.col("x").alias("y"))
