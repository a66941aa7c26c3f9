"""Preference formatting of paired conversations.

The longest common turn prefix of a chosen and a rejected conversation is the prompt, rendered once; what follows in each
is its completion, in which only the assistant's turns are trained on. The prefix ends at the smallest turn in which the
two differ, which takes only aggregates. Prompt and completions are then put together by stretches of turns, so that a
conversation of any length is never gathered whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The marks around a turn.
BEGIN, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
#: Turn numbers in one row of pairs: ordinary conversations are one row, longer ones several, to be read in order.
STRETCH = 1000


def _unmarked(value: Column) -> Column:
    """A value in which marks are broken up, so that they can't begin or end a turn."""
    return F.replace(F.coalesce(value, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


def header(role: Column) -> Column:
    """What comes before a turn's text: the opening mark and the role, on one line whatever it holds."""
    return F.concat(F.lit(BEGIN), F.translate(_unmarked(role), "\n\r", "  "), F.lit("\n"))


def rendered(role: Column, text: Column) -> Column:
    """A turn between its marks."""
    return F.concat(header(role), _unmarked(text), F.lit(END + "\n"))


def preference_rows(turns: DataFrame) -> DataFrame:
    """``pair_id``, ``part`` (prompt, chosen, rejected), ``turn``, ``role``, ``rendered``, ``trained``, ``copies``, ``prompt_turns``.

    ``turns`` has ``pair_id``, ``side`` (chosen or rejected), ``turn``, ``role`` and ``text``. Parts read in order of turn.
    ``trained`` is false in the prompt and true for the assistant's turns of the completions. ``prompt_turns`` counts the
    prompt's different turn numbers.

    A repeated row comes once, with its number in ``copies``; two sides are alike in a turn if they have the same different
    (role, text) rows there as often. A null turn comes first, a null role or text renders empty, null pair_ids are one
    pair. A side without a partner has an empty prompt. An empty table gives an empty result; other columns are ignored.
    """
    rows = turns.groupBy("pair_id", "side", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    mark = F.xxhash64("role", "text", "copies").cast("decimal(38,0)")
    by_turn = rows.groupBy("pair_id", "turn").agg(
        *[F.coalesce(F.sum(F.when(F.col("side") == s, mark)), F.lit(0)).alias(s) for s in ("chosen", "rejected")],
        *[F.count(F.when(F.col("side") == s, 1)).alias(f"n_{s}") for s in ("chosen", "rejected")],
    )
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    alike = (F.col("chosen") == F.col("rejected")) & (F.col("n_chosen") == F.col("n_rejected"))
    first = by_turn.groupBy("pair_id").agg(F.min(F.when(~alike, place)).alias("first"))
    met = by_turn.join(first.withColumnRenamed("pair_id", "p1"), F.col("pair_id").eqNullSafe(F.col("p1")))
    before = F.col("first").isNull() | (place < F.col("first"))
    ends = met.groupBy("pair_id", "first").agg(F.count(F.when(before, 1)).alias("prompt_turns"))
    ends = ends.select(F.col("pair_id").alias("p2"), "first", "prompt_turns")
    out = rows.join(ends, F.col("pair_id").eqNullSafe(F.col("p2")))
    common = F.coalesce(before, F.lit(False))
    # The prompt is the chosen side's; the rejected side's equal turns are not rendered again.
    kept = out.where(~common | (F.col("side") == "chosen"))
    return kept.select(
        "pair_id",
        F.when(common, F.lit("prompt")).otherwise(F.col("side")).alias("part"),
        "turn",
        "role",
        rendered(F.col("role"), F.col("text")).alias("rendered"),
        (~common & (F.coalesce("role", F.lit("")) == ASSISTANT)).alias("trained"),
        "copies",
        "prompt_turns",
    )


def preference_pairs(turns: DataFrame, *, stretch: int = STRETCH) -> DataFrame:
    """``pair_id``, ``stretch``, ``prompt``, ``chosen``, ``rejected``, and ``chosen_mask`` and ``rejected_mask``: the parts of
    the completions to train on, from behind an assistant's header to the end of its turn, as (begin, end) in code points.

    ``turns`` and what nulls, repeated rows and missing partners give are as in ``preference_rows``; a repeated row is
    rendered once, rows of one turn come in order of role and text. A pair has a row for each ``stretch`` turn numbers in
    which it has any (null counts to the first), which follow each other in order of ``stretch``; masks count from the
    beginning of a row's completion.
    """
    rows = preference_rows(turns).withColumn("stretch", F.floor(F.coalesce(F.col("turn"), F.lit(0)) / stretch).cast("long"))
    own = F.struct("turn", "role", F.col("rendered").alias("text"), F.when(F.col("trained"), F.char_length(header(F.col("role")))).alias("skip"))
    parts = ("prompt", "chosen", "rejected")
    pairs = rows.groupBy("pair_id", "stretch").agg(*[F.array_sort(F.collect_list(F.when(F.col("part") == x, own))).alias(x) for x in parts])

    def mask(part: str) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<begin: long, end: long>>").alias("spans"))

        def step(a: Column, t: Column) -> Column:
            end = a.at + F.char_length(t.text)
            span = F.array(F.struct((a.at + t.skip).alias("begin"), end.alias("end")))
            return F.struct(end.alias("at"), F.when(t.skip.isNull(), a.spans).otherwise(F.concat(a.spans, span)).alias("spans"))

        return F.aggregate(part, start, step).spans

    whole = [F.array_join(F.transform(x, lambda t: t.text), "").alias(x) for x in parts]
    return pairs.select("pair_id", "stretch", *whole, *[mask(x).alias(f"{x}_mask") for x in parts[1:]])


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) are a pair; masks as ``begin:end,...``."""
    turns = table(spark, sf_dir, "conversations")
    side = F.when(F.pmod("conv_id", F.lit(2)) == 1, F.lit("rejected")).otherwise(F.lit("chosen"))
    pairs = preference_pairs(turns.select(F.floor(F.col("conv_id") / 2).alias("pair_id"), side.alias("side"), "turn", "role", "text"))
    spans = [F.array_join(F.transform(m, lambda x: F.concat_ws(":", x.begin.cast("string"), x.end.cast("string"))), ",").alias(m) for m in ("chosen_mask", "rejected_mask")]
    return pairs.select("pair_id", "stretch", "prompt", "chosen", "rejected", *spans)
