"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records uniformly into buckets that fit in memory, by a seeded hash of the whole row. Pass 2
shuffles each bucket with Fisher-Yates. The buckets, one after the other, then are one uniform random permutation of all
records, and shard k is the k-th of equally long stretches of it: a bucket's task can write its records straight into at
most a few shards, without another exchange.

Repeated rows are counted and scattered by (row, occurrence), so no bucket grows with the copies of one record.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import few_files, repeated, row_hash, staged, table, utf8_bytes

SEED = 20_240
#: Records that one Fisher-Yates task holds in memory; with ``bucket_bytes`` the size of a bucket.
BUCKET_ROWS = 200_000
BUCKET_BYTES = 64 << 20
MIN_BUCKETS = 64
#: Bytes that a record takes in memory besides its values of varying length.
RECORD_BYTES = 64


def memory_bytes(schema: T.StructType) -> Column:
    """Bytes of a record in memory: those of its texts and binaries, of nested values as text, and RECORD_BYTES."""
    total = F.lit(RECORD_BYTES).cast("long")
    for f in schema.fields:
        value = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            value = value.cast("string")
        elif not isinstance(f.dataType, (T.StringType, T.BinaryType)):
            continue
        total = total + utf8_bytes(value)
    return total


def shuffle_into_shards(
    df: DataFrame,
    *,
    shards: int = 16,
    seed: int = SEED,
    size: Column | None = None,
    bucket_rows: int = BUCKET_ROWS,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """``df`` with ``shard`` (int, 0 to ``shards`` - 1) and ``slot`` (long, gapless from 0 in each shard).

    Shards differ by at most one row. ``size`` gives a record's bytes in memory (default: ``memory_bytes`` of its
    columns); buckets hold about ``bucket_rows`` records and ``bucket_bytes`` bytes.

    Nulls hash and are kept like other values; an empty table gives an empty result; repeated rows are kept, each with a
    slot of its own; rows that are alike in all columns are interchangeable. Columns named ``shard`` or ``slot`` in the
    input are replaced. Columns must be groupable (no maps).
    """
    if shards < 1:
        raise ValueError(f"shards must be >= 1, got {shards}")
    df = df.drop("shard", "slot")
    cols = [F.col(f"`{c}`") for c in df.columns]
    # Only if any row's hash comes again are whole rows counted, which shuffles them once more.
    spread = df.withColumn("__tag", row_hash(seed, *cols))
    if repeated(spread, "__tag"):
        counted = spread.groupBy(*cols, "__tag").agg(F.count(F.lit(1)).alias("__n"))
        each = counted.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
        spread = each.withColumn("__tag", F.when(F.col("__i") == 1, F.col("__tag")).otherwise(row_hash(seed, F.col("__tag"), F.col("__i")))).select(*cols, "__tag")

    total = df.agg(F.count(F.lit(1)).alias("n"), F.sum(memory_bytes(df.schema) if size is None else size).alias("b")).first()
    n = total["n"]
    buckets = max(MIN_BUCKETS, -(-n // bucket_rows), -(-int(total["b"] or 0) // bucket_bytes))

    scattered = staged(spread.withColumn("__bucket", F.pmod(F.col("__tag"), F.lit(buckets)).cast("int")), "scatter", n, texts=True)
    # One row a bucket: bounded by the input's size over the bucket's.
    sizes = sorted((r[0], r[1]) for r in scattered.groupBy("__bucket").count().collect())
    starts = np.concatenate([[0], np.cumsum([c for _, c in sizes], dtype=np.int64)])[:-1].tolist() if sizes else []
    spark = df.sparkSession
    based = spark.createDataFrame([(b, s) for (b, _), s in zip(sizes, starts)], "__bucket int, __base long")
    ready = scattered.join(F.broadcast(based), "__bucket")

    schema = T.StructType([*df.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    width = len(df.columns)

    def fisher_yates(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        """One whole bucket, in order of the rows' tags; ``__tag``, ``__bucket``, ``__base`` are the last columns."""
        whole = pa.Table.from_batches(batches).combine_chunks()
        bucket, base = whole.column(width + 1)[0].as_py(), whole.column(width + 2)[0].as_py()
        order = np.arange(whole.num_rows)
        np.random.Generator(np.random.PCG64([seed, bucket])).shuffle(order)  # in place, Fisher-Yates
        at = base + np.arange(whole.num_rows)
        shard = at * shards // n
        first = -(-shard * n // shards)
        mixed = whole.select(range(width)).take(pa.array(order)).combine_chunks().to_batches()[0]
        return pa.RecordBatch.from_arrays([*mixed.columns, pa.array(shard.astype(np.int32)), pa.array(at - first)], names=schema.names)

    def apply(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            b = batch.column(width + 1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if held and held[0].column(width + 1)[0].as_py() != b[lo]:
                    yield fisher_yates(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield fisher_yates(held)

    dealt = ready.select(*df.columns, "__tag", "__bucket", "__base").repartition("__bucket").sortWithinPartitions("__bucket", "__tag")
    return few_files(dealt.mapInArrow(apply, schema), n, texts=True)


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Shuffle whole records and write them as Parquet, a folder for each shard.

    Nulls, repeated rows, empty tables and memory are as in ``shuffle_into_shards``, whose ``options`` it takes; a task
    holds one bucket, and an empty table gives no folders.
    """
    shuffle_into_shards(df, **options).write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame) -> DataFrame:
    """The contract's columns for ``documents``, from its shuffled rows: law ``rows``, so ``grown_shard`` is null."""
    return shuffle_into_shards(docs).select(
        "doc_id",
        (utf8_bytes(F.col("text")) + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
