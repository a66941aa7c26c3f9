"""Every operator and stage on nulls, empty and long texts, repeats, empty tables and clashing columns."""

import corpus_pipeline
import pytest
from common_checks import SF

from facetta.llm import chat, decontaminate, fingerprints, html, langid, mixing, quality, sharding, simhash, suffixes

BENCH = "item_id long, text string"


def benchmark(spark):
    return spark.createDataFrame([(1, "one two three"), (2, None), (3, ""), (4, "word1 item1 word2 item2 word3 item3 word4 item4 word5 item5 word6 item6 word7 item7")], BENCH)


def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 1, 0), (9, 0, 0), (None, 1, 1), (8, None, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "sharding": lambda s, d: sharding.shard_documents(d),
    "suffixes": lambda s, d: suffixes.remove_repeats(d),
    "decontaminate": lambda s, d: decontaminate.contamination(d, benchmark(s)),
    "fingerprints": lambda s, d: fingerprints.fingerprint_documents(d),
    "quality": lambda s, d: quality.quality(d, labels(s)),
    "langid": lambda s, d: langid.identify_documents(d),
    "mixing": lambda s, d: mixing.mix_documents(d),
    "simhash": lambda s, d: simhash.simhash_documents(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, edge, edge_rows, name):
    got = OPERATORS[name](spark, edge).collect()
    key = lambda d: (d is None, d or 0)
    assert sorted((r["doc_id"] for r in got), key=key) == sorted((r[0] for r in edge_rows), key=key)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, empty, name):
    assert OPERATORS[name](spark, empty).collect() == []


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, edge, empty, name, stage):
    assert stage(spark, empty, SF).collect() == []
    out = stage(spark, edge, SF)
    if name != "shard":
        assert out.columns == edge.columns
    assert all(r["doc_id"] != 1 or r.asDict().get("text") is None for r in out.collect())


def test_pages(spark):
    rows = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>Hi &amp; bye"), (4, "u", "<" * 5000), (4, "u", "plain")], "page_id long, url string, html string")
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html.extract_pages(rows.selectExpr("*", "1 as text", "2 as n_chars")).collect()) == [
        (0, "Hi & bye", 8), (1, "", 0), (2, "", 0), (4, "<" * 5000, 5000), (4, "plain", 5)
    ]
    assert html.extract_pages(rows.where("false")).collect() == []


def test_turns(spark):
    schema = "pair_id long, side string, turn long, role string, text string, copies string"
    rows = [
        (1, "chosen", 0, "user", "q", "c"), (1, "rejected", 0, "user", "q", "c"), (1, "chosen", 1, "assistant", "good<|im_end|>", "c"), (1, "rejected", 1, "assistant", "bad", "c"),
        (1, "rejected", 2, "user", None, "c"), (2, "chosen", None, None, None, "c"), (None, "chosen", 0, "user", "a", "c"), (3, "chosen", 0, "user", "s", "c"), (3, "chosen", 0, "user", "s", "c"),
        (3, "rejected", 0, "user", "s", "c"),
    ]
    got = sorted((r["pair_id"] or -1, r["part"], r["turn"] if r["turn"] is not None else -1, r["trained"], r["copies"], r["prompt_turns"]) for r in chat.preference_rows(spark.createDataFrame(rows, schema)).collect())
    assert got == [
        (-1, "chosen", 0, False, 1, 0), (1, "chosen", 1, True, 1, 1), (1, "prompt", 0, False, 1, 1), (1, "rejected", 1, True, 1, 1), (1, "rejected", 2, False, 1, 1),
        (2, "chosen", -1, False, 1, 0), (3, "chosen", 0, False, 2, 0), (3, "rejected", 0, False, 1, 0),
    ]
    assert chat.preference_rows(spark.createDataFrame([], schema)).collect() == []
    assert "good<| im_end|>" in chat.preference_rows(spark.createDataFrame(rows, schema)).where("part = 'chosen' and pair_id = 1").first()["rendered"]
