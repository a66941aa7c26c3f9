"""Where work files go, and how large a broadcast may be."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and driver and executors are one process, as in tests.
LOCAL_WORK_DIR = "file:///tmp/facetta-work"
#: Bytes of a table that may be broadcast; beyond it the operators go block by block through a shuffle.
BROADCAST_BYTES = 64 << 20


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Without it a local master has a folder of its own; a cluster's executors would each write to their own disk, so there
    it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or LOCAL_WORK_DIR).rstrip("/")


#: Partitions a core at least; beyond that, what one holds at most: bytes of the files it is made from, short rows, and rows
#: that hold texts or are made from them.
FILES_PER_CORE, INPUT_BYTES, SHORT_ROWS, TEXT_ROWS = 2, 16 << 20, 1_000_000, 10_000


def input_bytes(df: DataFrame) -> int:
    """Bytes of all files that ``df`` is made from, as the optimizer knows them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    files = [leaves.apply(i) for i in range(leaves.size())]
    return sum(int(str(x.stats().sizeInBytes())) for x in files if x.getClass().getSimpleName() == "LogicalRelation")


def few_files(df: DataFrame, rows: int = 0, *, texts: bool = False, per_core: int = FILES_PER_CORE) -> DataFrame:
    """``df`` in no more partitions than its size calls for, by the bytes of its input files and, if known, by its ``rows``.

    Partitions are read one after the other by one task; nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(1, per_core * cores, input_bytes(df) // INPUT_BYTES, rows // (TEXT_ROWS if texts else SHORT_ROWS)))


def staged(df: DataFrame, tag: str, rows: int | None = None, *, few: bool = False, texts: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    The files outlive any executor, and go when the driver's JVM ends. With ``few``, or ``rows``, about how many there are,
    it writes no more of them than needed; ``texts`` if they hold texts or are made from texts in the same stage.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/facetta-{tag}-{uuid.uuid4().hex}"
    df = few_files(df, rows or 0, texts=texts) if few or rows is not None else df
    # Readers get the path only once the write is over: no mark of success is needed.
    plain = df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    plain.option("compression", "zstd").parquet(path)
    fs, where = _hadoop(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._facetta_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete the files behind a ``staged`` frame that nothing will read again."""
    path = getattr(df, "_facetta_path", None)
    if path:
        fs, where = _hadoop(df.sparkSession, path)
        fs.delete(where, True)


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where
