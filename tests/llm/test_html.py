import time
from itertools import product

import pytest
from facetta.llm import html
from hypothesis import given, settings
from hypothesis import strategies as st

PIECES = st.sampled_from(
    ["<p>", "</p>", "<div>", "</div>", "<nav>", "</nav>", "<article>", "</article>", "<ul><li>", "<li>", "</ul>", "<a href='x'>", "</a>", "<h2>", "</h2>", "<br>", "<hr>",
     "<!-- note -->", "<script>x()</script>", "<div class='comments'>", "<footer>", "</footer>", "some words of text ", "more, and more still; a long sentence of many words ", "&amp; "]
)
HOSTILE = st.sampled_from(["<", ">", "<!--", "-->", "<a b", "<p>", "='", '="', "'", '"', "</", "<script", "</script", "<![CDATA[", "]]>", "<!x", "&", "&#", "\0", "é", " "])


def cost(labels, costs, edges):
    own = sum(a if keep else b for keep, (a, b) in zip(labels, costs))
    return own + sum(c for u, v, c in edges if labels[u] != labels[v])


@settings(max_examples=150, deadline=None)
@given(st.lists(PIECES, max_size=30))
def test_extraction_is_the_labelling_of_least_cost(pieces):
    page = "".join(pieces)
    blocks = html.blocks_of(page)[:11]
    costs, edges = html.graph(blocks)
    got = html.min_cut(costs, edges)
    assert cost(got, costs, edges) == min(cost(x, costs, edges) for x in product([True, False], repeat=len(blocks)))
    full = html.blocks_of(page)
    if len(full) <= 11:
        assert html.extract(page) == "\n".join(b.text for b, keep in zip(full, got) if keep)


@settings(max_examples=60, deadline=None)
@given(st.lists(HOSTILE, min_size=1, max_size=6))
def test_time_is_proportional_to_the_page(pieces):
    page = "".join(pieces)
    page *= 400_000 // len(page)
    began = time.perf_counter()
    html.extract(page)
    assert time.perf_counter() - began < 3  # under 1 s on an idle machine


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a</p><!-- ad <p>x</p>", "a"),
        ("<article><p>First words of it.</p><div class='legal'><p>The court held that it was so.</p></div></article>", "First words of it.\nThe court held that it was so."),
        ("<article><p>First words of it.</p><div class='reply-quote'><p>So it was said then.</p></div></article>", "First words of it.\nSo it was said then."),
        ("<article><p>First words of it.</p><div class='comments'><p>Nice!</p></div></article>", "First words of it."),
        ("<p>a <b title='it's'>b</b> c</p>", "a b c"),
        ("<p>a long enough start of it <a href='x>b</a> c</p>", "a long enough start of it b c"),
        ("<p>1 < 2 and <3</p><p>b <", "1 < 2 and <3\nb <"),
        ("<p>shown</p><div hidden><p>not</p></div><div style='display: none'>nor this</div>", "shown"),
        ("<!--><p>after an empty comment</p>", "after an empty comment"),
    ],
)
def test_pages(page, text):
    assert html.extract(page) == text
