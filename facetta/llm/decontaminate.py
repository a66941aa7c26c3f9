"""Benchmark decontamination: a prefix-filtered set join, in DataFrame operations only.

A benchmark item is cut into windows of WINDOW consecutive words (a shorter item is one window). Words are ordered by
their count over all documents; a document can hold a window only if it holds the window's rarest word, so one word is
the necessary prefix of an exact containment. Documents are laid out as (position, word) rows inside one generated
stage, and meet the windows at their rarest words. A meeting survives if the window then begins at or after the first
word and ends within the text (positional and length bounds), and is verified word by word against the document's words.

The windows are broadcast in blocks of a bounded number of rows, so a benchmark of any size is worked off block by block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few_files, staged, table

WINDOW = 13
#: Windows, and words of the benchmark, in one broadcast: at most about 100 MB.
BLOCK_WINDOWS, BLOCK_WORDS = 200_000, 1_000_000
#: Fixed value: what parts words, after A-Z are lower-cased.
SEPARATOR = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands at position -1 of every document; no word is empty.
EDGE = ""


def words(text: Column) -> Column:
    """The words of a text, an empty array for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATOR), "")


def windows(items: DataFrame) -> DataFrame:
    """``window`` (its words), ``len`` and ``items`` (the item_ids as strings): every different window once."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - WINDOW + 1, F.lit(1)))
    cut = w.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.expr(f"slice(w, s, {WINDOW})").alias("window"))
    return cut.groupBy("window").agg(F.collect_set("item_id").alias("items")).withColumn("len", F.size("window"))


def laid_out(docs: DataFrame) -> DataFrame:
    """A row for each word of each document, and one at position -1, with the document's words at hand."""
    return docs.withColumn("__w", words(F.col("text"))).drop("text").select(
        "*", F.posexplode(F.concat(F.array(F.lit(EDGE)), F.col("__w"))).alias("__p", "__word")
    )


def rarest_words(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """``wins`` with ``id``, ``word`` (the window's rarest over all documents) and ``off``, where it stands in the window."""
    spark = docs.sparkSession
    vocabulary = wins.select(F.explode("window").alias("word")).distinct()
    blocks = max(1, -(-vocabulary.count() // BLOCK_WORDS))
    counts = []
    for b in range(blocks):
        own = vocabulary.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == b) if blocks > 1 else vocabulary
        met = laid_out(docs.select("text")).join(F.broadcast(own), F.col("__word") == F.col("word"))
        counts.append(met.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    known = reduce(DataFrame.unionByName, counts)
    each = wins.withColumn("id", F.xxhash64("window")).select("id", "window", "len", "items", F.posexplode("window").alias("off", "word"))
    ranked = each.join(known, "word", "left").groupBy("id", "window", "len", "items")
    best = ranked.agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "off")).alias("b"))
    return best.select("id", "window", "len", "items", "b.word", "b.off", "b.n")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """For every row of ``docs`` (``doc_id``, ``text``): ``n_words``, ``n_hit``, ``item_ids`` (as sorted strings), ``hits``
    (where windows occur: first word and the one behind), ``contaminated`` and ``text_hash``.

    A null or empty text has no words and is not contaminated, nor is anything if the benchmark is empty or without
    words. Repeated rows come back as often as given; null doc_ids are kept; items with equal windows all count; other
    columns are ignored.
    """
    slim = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    wins = staged(windows(items.select("item_id", "text")), "windows", few=True)
    known = staged(rarest_words(slim, wins).where("n > 0"), "rarest", few=True)  # a word in no document: a window in no document
    n = known.count()
    blocks = max(1, -(-n // BLOCK_WINDOWS))
    parts = []
    for b in range(blocks):
        own = known.select("id", "window", "len", "word", "off")
        own = own.where(F.pmod("id", F.lit(blocks)) == b) if blocks > 1 else own
        if b == 0:  # each document meets the edge once, with or without windows
            own = own.unionByName(own.sparkSession.range(1).select(F.lit(None).cast("long").alias("id"), F.array().cast("array<string>").alias("window"), F.lit(0).alias("len"), F.lit(EDGE).alias("word"), F.lit(0).alias("off")))
        begin = F.col("__p") - 1 - F.col("off")
        met = laid_out(slim).join(F.broadcast(own), F.col("__word") == F.col("word"))
        inside = (begin >= 0) & (begin + F.col("len") <= F.size("__w")) & (F.slice("__w", begin + 1, F.col("len")) == F.col("window"))
        parts.append(
            met.where(F.when(F.col("id").isNull(), F.lit(True)).otherwise(inside)).select(
                "doc_id", "text_hash", "id",
                F.when(F.col("id").isNull(), F.size("__w")).alias("n_words"),
                F.when(F.col("id").isNotNull(), F.struct(begin.alias("s"), (begin + F.col("len")).alias("e"))).alias("hit"),
            )
        )
    by_doc = reduce(DataFrame.unionByName, parts).groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.count("n_words").alias("copies"),
        F.collect_set("hit").alias("hits"),
        F.collect_set("id").alias("ids"),
    )
    covered = F.aggregate(
        F.array_sort("hits"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, h: F.struct((a.n + F.greatest(h.e - F.greatest(h.s, a.end), F.lit(0))).alias("n"), F.greatest(a.end, h.e).alias("end")),
    ).n
    found = staged(by_doc.withColumn("n_hit", covered), "hits", docs.count())
    # Of the documents with windows, which are few, the items.
    named = found.where(F.size("ids") > 0).select("doc_id", "text_hash", F.explode("ids").alias("id")).join(known.select("id", "items"), "id")
    listed = named.select("doc_id", "text_hash", F.explode("items").alias("item")).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    same = F.col("f.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("f.text_hash") == F.col("l.text_hash"))
    rows = found.alias("f").join(listed.alias("l"), same, "left").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    ids = F.coalesce(F.col("item_ids"), F.array().cast("array<string>"))
    out = rows.select(
        F.col("f.doc_id"),
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"),
        ids.alias("item_ids"),
        F.array_sort("hits").alias("hits"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit").cast("long") >= F.col("n_words"))).alias("contaminated"),
        F.col("f.text_hash"),
    )
    return few_files(out, docs.count())


def digested(found: DataFrame) -> DataFrame:
    """``contamination``'s rows with the number of items and a digest of them instead of lists."""
    digest = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest, "contaminated")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows."""
    bad = contamination(docs, items).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    same = docs.doc_id.eqNullSafe(F.col("__id")) & (F.xxhash64(docs.text) == F.col("__hash"))
    return few_files(docs.join(bad, same, "left_anti"), docs.count(), texts=True)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for ``documents``, from the items and words that are hit."""
    return digested(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
