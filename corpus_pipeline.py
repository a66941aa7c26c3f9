"""A training-corpus pipeline: five of the training-data operators, one after the other, over ``documents``.

Each stage's result is written as Parquet to the shared folder and read again, so a lost executor costs at most a stage's
tasks. Every stage but the last returns the columns of ``documents``, and further columns that it is given.

In every stage an empty table gives an empty result, extra columns may have any names, and of repeated rows:
language ID and decontamination keep or drop them alike, near-duplicate removal keeps one, mixing takes each as often as
the others, sharding gives each a slot. Nulls: language ID drops a null text, as it does a text without letters;
near-duplicate removal takes a null text for an empty one and a null doc_id for the largest; decontamination keeps a null
text; for mixing a null text has no words and a null source is the last source; sharding takes a null text for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from facetta.llm.common import staged, table
from facetta.llm.decontaminate import drop_contaminated
from facetta.llm.langid import keep_identified
from facetta.llm.mixing import keep_mixed
from facetta.llm.sharding import shard_documents
from facetta.llm.simhash import keep_one_of_each


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts."""
    return keep_identified(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return keep_mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return shard_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: Fingerprints, components and a trained model have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
