"""Extraction and the quality model."""

import itertools

import numpy as np
import pytest
from common_checks import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from facetta.llm import html, langid, quality


@settings(max_examples=80, deadline=None)
@given(st.data())
def test_min_cut_is_minimal(data):
    n = data.draw(st.integers(1, 6))
    costs = [(data.draw(st.integers(0, 9)), data.draw(st.integers(0, 9))) for _ in range(n)]
    pairs = list(itertools.combinations(range(n), 2))
    edges = [(*p, data.draw(st.integers(1, 6))) for p in data.draw(st.lists(st.sampled_from(pairs), max_size=8))] if pairs else []
    total = lambda keep: sum(c if k else b for (c, b), k in zip(costs, keep)) + sum(w for u, v, w in edges if keep[u] != keep[v])
    assert total(html.min_cut(costs, edges)) == min(total(k) for k in itertools.product([False, True], repeat=n))


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header><a href=/>Home</a></header>
<div id="cookie-notice">We use cookies on this site to be nice. <button>OK</button></div><nav>Menu <a>x</a></nav>
<div class="sidebar">Related stuff that is long and boring with many words in it, so many that it could be content</div>
<main><h1>Title &eacute;</h1><p>Short.</p><p>Text <b>bo</b>ld  and\n more text<br>line two &lt;tag&gt; end of it.
<table><tr><td>cell1<td>cell2</table><div class="ad">Buy now</div><!-- <p>no</p> --><p>After ad.</p><form><label>Name</label><input></form></main>
<div class="comments"><p>Great article, I really liked reading all of it, thanks.</p></div><footer>(c)</footer><script>if (a<b) x="</p>"</script>"""


def test_page():
    assert html.extract(PAGE) == "Title é\nShort.\nText bold and more text line two <tag> end of it.\ncell1\ncell2\nAfter ad."


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("   ", ""), ("just text", "just text"), ("<p>a<p>b", "a\nb"), ("<p>a &#x41; &nbsp; b</p><!-- open", "a A b"), ("a < b", "a < b"), ("<script>x", ""), ("<div><p>one</div>two", "one\ntwo")])
def test_small_pages(page, text):
    assert html.extract(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html><head><title>t</title><meta charset=utf-8><body><p>Kept text.</p></body></html>", "Kept text."),
        ("<head><title>t</title><style>p{}</style><p>Kept text.</p>", "Kept text."),
        ("<head><title>t</title>Kept text.", "Kept text."),
        ("<head><template><p>No.</p></template></head><p>Kept text.</p>", "Kept text."),
        ("<article><p>So <math><mi>a</mi><mo>+</mo><mi>b</mi></math> holds.</p></article>", "So a+b holds."),
        *[(f"<article><p>Before.</p><{t}><p>Fallback text.</p></{t}></article>", "Before.\nFallback text.") for t in ("object", "canvas", "audio", "video")],
    ],
)
def test_content_in_open_head_and_fallback_is_kept(page, text):
    assert html.extract(page) == text


def test_long_page_is_quick():
    page = "<article>" + "".join(f"<p>Paragraph number {i} with some words.</p>" for i in range(5000)) + "</article>"
    assert html.extract(page).count("\n") == 4999


def test_quality_tells_junk(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.quality(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").collect()
    assert sum(r["keep"] == bool(r["quality"]) for r in out) / len(out) >= 0.97


def test_sparse_sites_shrink(spark):
    """A path with one document is drawn toward its host, a host with many keeps its own mean."""
    rows = [(i, "good " * 5, f"p{i % 3}", "h1") for i in range(60)] + [(100, "x", "only", "h2"), (101, "y", "p", "h1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.quality(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert got[0]["evidence"] == pytest.approx(0.5) and got[100]["posterior"] == pytest.approx(0.5, abs=0.01)


def test_newton_fits():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, quality.FEATURES))
    y = (x[:, 0] - x[:, 1] > 0).astype(float)
    assert ((quality.train(x, y).logit(x) > 0) == (y > 0)).mean() > 0.97


def test_left_out_language_is_rejected(spark):
    """A language in the script of the learned ones, of which training sees nothing; the learned ones are kept."""
    sf = SF.replace("sf0.001", "sf0.1")
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null and doc_id < 3000").select("doc_id", "text", "lang")
    model = langid.fit(docs.where("lang <> 'en'"))
    held = docs.where(langid.fold_of(docs.doc_id) == 0).collect()
    told = [(r["lang"], *model.predict(r["text"])) for r in held if langid.has_letter(r["text"])]
    kept = [score >= model.threshold for lang, _, score in told if lang != "en"]
    rejected = [score < model.threshold for lang, _, score in told if lang == "en"]
    assert sum(kept) >= 0.97 * len(kept) and sum(rejected) >= 0.9 * len(rejected)


def test_every_language_is_learned(spark):
    rows = [(10 * k + i, f"word{k} text{k}", f"l{k}") for k in range(230) for i in range(4 if k < 15 else 8)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=1000)
    assert set(model.langs) == {f"l{k}" for k in range(230)}
