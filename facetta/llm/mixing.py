"""Mixing sources to target weights with hash-threshold histograms.

Every document gets a hash. Sizes are summed by source and hash bucket; a source whose target is f times its size takes
every document floor(f) times, and once more the documents whose hash is below a threshold. The histogram tells the
bucket in which the threshold lies, and only that bucket is cut into finer ones, until it can't be cut further. Nothing
is sorted, and a document's fate depends only on its hash and its source's threshold. Of repeated rows each has a hash of
its own, so a threshold can part them too.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few_files, join_grouped, repeated, staged, table

SEED = 9_001
#: Digits by which the boundary bucket is refined: LEVELS of BITS bits each make up a hash.
HASH_BITS, BITS, LEVELS = 60, 10, 6
MAX_REPEATS = 2
SHARE = 1.5
WEIGHTS = (3, 1, 2)


def document_hash(seed: int) -> Column:
    """HASH_BITS bits of the MD5 of seed, doc_id, source and the text's MD5; nulls are left out."""
    key = F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("source").cast("string"), F.md5(F.col("text").cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def occurrence_hash(i: Column) -> Column:
    """The hash of the ``i``-th of repeated rows (from 1): the first has the document's own."""
    later = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("__hash").cast("string"), i.cast("string")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")
    return F.when(i == 1, F.col("__hash")).otherwise(later)


def each_occurrence(df: DataFrame) -> DataFrame:
    """``df`` with ``__hash`` of each occurrence instead of each document. Rows are counted first, so repeated ones never
    meet in one task but as their number."""
    counted = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    each = counted.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    return each.withColumn("__hash", occurrence_hash(F.col("__i"))).drop("__n", "__i")


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    plain = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.array_remove(F.split(plain, " "), ""))).cast("long")


def targets_for(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, most: float = MAX_REPEATS) -> list[float]:
    """Targets of sources given in order: ``share`` of all sizes by weight, none above ``most`` times its own size.

    What a full source can't take is shared again among the others by weight, until none is above. The total can't exceed
    ``most`` times all sizes.
    """
    total = share * sum(s for _, s in sizes)
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    full: set[int] = set()
    while True:
        left = total - sum(most * sizes[i][1] for i in full)
        w = sum(x for i, x in enumerate(weight) if i not in full)
        now = [most * s if i in full else (left * weight[i] / w if w else 0.0) for i, (_, s) in enumerate(sizes)]
        over = {i for i in range(len(sizes)) if i not in full and now[i] > most * sizes[i][1]}
        if not over:
            return [float(x) for x in now]
        full |= over


def with_source_table(df: DataFrame, small: DataFrame, rows: int) -> DataFrame:
    return join_grouped(df, small.withColumnRenamed("source", "__k"), {"source": "__k"}, rows, F.col("__hash"))


def thresholds(hashed: DataFrame, *, weights=WEIGHTS, share: float = SHARE) -> tuple[DataFrame, int]:
    """A row per source: ``source``, ``source_size``, ``target``, ``__base`` copies of everything, and ``__low``, the hash
    below which a document is taken once more; and the number of sources.

    ``hashed`` has ``source``, ``size`` and ``__hash``, and is read LEVELS + 1 times: it should be staged.
    """
    spark = hashed.sparkSession
    per_source = hashed.groupBy("source").agg(F.sum("size").alias("s")).collect()  # one row a source
    order = sorted(((r[0], int(r[1])) for r in per_source), key=lambda x: (x[0] is None, x[0] or ""))
    goals = targets_for(order, weights, share)

    base, want = {}, {}
    for (name, s), t in zip(order, goals):
        base[name] = min(int(t // s), MAX_REPEATS) if s else 0
        want[name] = t - base[name] * s if s and base[name] < MAX_REPEATS else 0.0
    low = dict.fromkeys(base, 0)
    taken = dict.fromkeys(base, 0)
    open_ = {k for k in base if want[k] > 0}

    for level in range(LEVELS):
        if not open_:
            break
        above, below = HASH_BITS - BITS * level, HASH_BITS - BITS * (level + 1)
        at = with_source_table(
            hashed.select("source", "size", "__hash"),
            spark.createDataFrame([(k, low[k] >> above) for k in open_], "source string, __prefix long"),
            len(open_),
        )
        own = at.where(F.shiftright("__hash", above) == F.col("__prefix")) if level else at.where(F.col("__prefix").isNotNull())
        digit = F.shiftright("__hash", below).bitwiseAND(F.lit((1 << BITS) - 1))
        cells: dict = {}
        for r in own.groupBy("source", digit.alias("d")).agg(F.sum("size").alias("s")).collect():
            cells.setdefault(r[0], {})[r[1]] = int(r[2])
        for k in list(open_):
            cut = 1 << BITS
            for d, s in sorted(cells.get(k, {}).items()):
                if taken[k] + s > want[k]:
                    nearer = level == LEVELS - 1 and taken[k] + s - want[k] < want[k] - taken[k]
                    cut = d + nearer
                    break
                taken[k] += s
            else:
                open_.discard(k)
            low[k] += cut << below

    rows = [(name, s, t, base[name], Decimal(low[name])) for (name, s), t in zip(order, goals)]
    return spark.createDataFrame(rows, "source string, source_size long, target double, __base int, __low decimal(20,0)"), len(rows)


def repeats() -> Column:
    more = (F.col("__hash") < F.col("__low")).cast("int")
    return F.when(F.col("__base") >= MAX_REPEATS, F.lit(MAX_REPEATS)).otherwise(F.col("__base") + more)


def sized(df: DataFrame, seed: int) -> DataFrame:
    """A short row for every row of ``df``: ``doc_id``, ``source``, ``size`` and ``__hash``, written down."""
    own = df.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), document_hash(seed).alias("__hash"))
    # Hashed where the texts are read, counted behind the shuffle of short rows.
    return staged(each_occurrence(own), "mix", few=True)


def mix(df: DataFrame, *, seed: int = SEED, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target`` and ``repeats`` (0 to 2) for every row of ``df``.

    ``df`` has ``doc_id``, ``text`` and ``source``; other columns are ignored. A null source is a source of its own, the
    last one; a null text has size 0. Equal rows (doc_id, source, text) have a hash each. Empty input gives an empty
    result; a source of size 0 has target 0.
    """
    hashed = sized(df, seed)
    plan, n = thresholds(hashed, weights=weights, share=share)
    return with_source_table(hashed, plan, n).withColumn("repeats", repeats()).drop("__hash", "__base", "__low")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The contract's columns for ``documents``."""
    out = mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))
    return few_files(out, docs.count())


def keep_mixed(docs: DataFrame, *, seed: int = SEED, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, all columns kept. Rows are shuffled only if they are repeated.

    Rows alike in doc_id, source and text that differ in other columns share a hash for each occurrence.
    """
    hashed = sized(docs, seed)
    plan, n = thresholds(hashed, weights=weights, share=share)
    own = docs.withColumn("__hash", document_hash(seed))
    if repeated(own, "__hash"):
        own = each_occurrence(own)
    taken = with_source_table(own, plan.select("source", "__base", "__low"), n)
    copies = taken.withColumn("__copy", repeats()).where("__copy > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copy"))))
    return few_files(copies.select(*[F.col(f"`{c}`") for c in docs.columns]), docs.count(), texts=True)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))
