"""Main text of web pages by minimum-cut labelling.

A page becomes blocks of text, each with its path in the document. A classifier turns a block's path, class names, link
share and length into the cost of calling it content and the cost of calling it boilerplate; these are the capacities of
its edges to the two terminals. Blocks next to each other and blocks with the same parent are joined by edges that are
stronger the nearer they are in the tree. The minimum cut, found by max-flow, is the labelling of least total cost.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few_files, table

# Names of HTML elements by what they mean for the text.
HIDDEN = frozenset("script style noscript template svg iframe head title textarea select datalist".split())
IN_HEAD = frozenset("base basefont bgsound link meta title script style noscript template head".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
P_CLOSERS = BLOCK - frozenset("button td th tr tbody thead tfoot html body legend option optgroup summary".split())
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}
}
SCOPES = frozenset("table ul ol dl menu select body article section div nav aside form".split())
BAD_TAGS = frozenset("nav footer aside form button dialog menu option label".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
GOOD_TAGS = frozenset(["article", "main"])
BAD_NAMES = frozenset(
    "nav navbar navigation menu footer header masthead sidebar aside ad ads adv advert adverts advertisement advertising banner promo promoted "
    "sponsor sponsored sponsors cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist disqus reply replies respond share sharing social related recommended breadcrumb breadcrumbs pagination pager "
    "toolbar widget widgets copyright legal disclaimer tags search form skip".split()
)
#: What an article itself has no use for; other bad names inside an article weigh little against its text.
FOREIGN_NAMES = frozenset("comment comments reply replies ad ads advert advertisement sponsored promo promoted related recommended".split())
GOOD_NAMES = frozenset("article content post entry story body text main".split())
QUOTE_NAMES = frozenset("quote quotation blockquote pullquote".split())

# The classifier: log-odds that a block is boilerplate.
BAD_WEIGHT, INNER_WEIGHT, GOOD_WEIGHT, HEADER_WEIGHT, LINK_WEIGHT = 6.0, 2.0, -3.0, 4.0, 3.0
HEADING_WEIGHT, LENGTH_WEIGHT, BASE_WEIGHT = -0.5, -0.5, 0.0
# Edges: strength between neighbours and between siblings, over 1 + their distance in the tree.
NEXT_WEIGHT, SIBLING_WEIGHT = 1.0, 0.8
UNIT = 1000  # capacities are whole thousandths

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_COMMENT_END = re.compile(r"--!?>")
_STOP = re.compile(r"[>=]")
_FILLED = re.compile(r"\S")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Element:
    tag: str
    parent: Element | None
    depth: int
    log_odds: float  # the classifier's sum from here up to the root
    hidden: bool
    inside: bool  # of an article or main element
    block: Element | None = None  # the nearest block element, itself if it is one


@dataclass(slots=True)
class Block:
    parent: Element
    text: list[str] | str = field(default_factory=list)
    linked: int = 0


def _element(tag: str, attrs: str, up: Element | None) -> Element:
    odds, inside = (up.log_odds, up.inside) if up else (BASE_WEIGHT, False)
    hidden = (up.hidden if up else False) or tag in HIDDEN
    names: set[str] = set()
    role = ""
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            key = m[1].lower()
            value = unescape(m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                names.update(_NAME.findall(value))
            elif key == "role":
                role = value.strip()
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
                hidden = True
    bad = names & (FOREIGN_NAMES if tag in ("article", "main", "h1") else BAD_NAMES) if tag not in ("html", "body") else set()
    if (bad == {"header"} and names & GOOD_NAMES) or (inside and names & QUOTE_NAMES):
        bad = set()  # the head of the article, or what it quotes
    if tag in BAD_TAGS or role in BAD_ROLES or (bad and not inside) or bad & FOREIGN_NAMES:
        odds += BAD_WEIGHT
    elif bad:
        odds += INNER_WEIGHT
    elif tag == "header" and not inside:
        odds += HEADER_WEIGHT
    elif tag in GOOD_TAGS or role in GOOD_TAGS:
        odds, inside = odds + (0 if inside else GOOD_WEIGHT), True
    elif names & GOOD_NAMES:
        odds += GOOD_WEIGHT / 2
    own = Element(tag, up, up.depth + 1 if up else 0, odds, hidden, inside)
    own.block = own if tag in BLOCK or up is None else up.block
    return own


def tokens(page: str) -> Iterator[tuple[str, str, str, int]]:
    """Kind (text, raw, open, close), name or text, attributes, and where the token ends; in time proportional to the page.

    Comments, declarations and processing instructions are left out. A comment, declaration or tag that nothing ends runs
    to the end of the page; a quote that nothing ends is no quote. ``send`` a place to go on from there.
    """
    n, at = len(page), 0
    last = {q: page.rfind(q) for q in "\"'>"}
    last_cdata = page.rfind("]]>")
    text = 0  # where the text before a tag begins

    def end_of_tag(k: int) -> int:
        while (m := _STOP.search(page, k)) is not None:
            k = m.end()
            if m[0] == ">":
                return k
            value = _FILLED.search(page, k)
            if value is not None and value[0] in "\"'" and last[value[0]] > value.start():
                k = page.find(value[0], value.end()) + 1
            elif value is not None:
                k = value.start() if value[0] == ">" else value.end()
        return -1

    while True:
        at = page.find("<", at)
        if at < 0 or at + 1 >= n:
            break
        begin, c = at, page[at + 1]
        token = None
        if c == "!" or c == "?":
            if page.startswith("<!--", at):
                m = _COMMENT_END.search(page, at + 2)
                end = m.end() if m else -1
            elif page.startswith("<![CDATA[", at) and last_cdata >= at + 9:
                end = page.find("]]>", at + 9) + 3
                token = ("raw", page[at + 9 : end - 3], "")
            else:
                end = page.find(">", at) + 1 if last[">"] > at else -1
        elif (m := _OPEN.match(page, at)) is not None:
            end = end_of_tag(m.end())
            token = ("close" if m[1] else "open", m[2].lower(), page[m.end() : end - 1])
        else:
            at += 1
            continue
        if begin > text:
            yield "text", page[text:begin], "", begin
        if end < 0:
            return
        at = text = end
        if token:
            skipped = yield *token, end
            if skipped is not None:
                yield "skipped", "", "", skipped
                at = text = skipped
    if text < n:
        yield "text", page[text:], "", n


def blocks_of(page: str) -> list[Block]:
    """The page's non-empty blocks, in order: runs of text that no block element's tag interrupts."""
    stack = [_element("html", "", None)]
    opened: Counter = Counter()  # names of the open elements but the root
    out: list[Block] = []
    now: Block | None = None
    links = 0

    def end_block():
        nonlocal now
        if now is not None:
            now.text = _SPACE.sub(" ", "".join(now.text)).strip()
            if now.text:
                out.append(now)
        now = None

    def add(text: str, decode: bool = True):
        nonlocal now
        if stack[-1].tag == "head" and text and not text.isspace():
            pop(len(stack) - 1)  # text ends a head that is left open
        if not text or stack[-1].hidden:
            return
        if now is None:
            if text.isspace():
                return
            now = Block(stack[-1].block)
        text = unescape(text) if decode and "&" in text else text
        now.text.append(text)
        if links:
            now.linked += len(text)

    def pop(k: int):
        nonlocal links
        while len(stack) > k:
            e = stack.pop()
            opened[e.tag] -= 1
            links -= e.tag == "a"
            if e.tag in BLOCK:
                end_block()

    def close_nearest(tags, scopes):
        """Close the nearest open element of ``tags``, if none of ``scopes`` comes before it."""
        if any(opened[t] > 0 for t in tags):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in tags:
                    return pop(k)
                if stack[k].tag in scopes:
                    return None
        return None

    stream = tokens(page)
    for kind, tag, attrs, at in stream:
        if kind in ("text", "raw"):
            add(tag, kind == "text")
            continue
        if kind == "skipped":
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD and (kind == "open" or tag in ("html", "body", "br")):
            pop(len(stack) - 1)  # and so does the first element that can't be in a head
        if kind == "close":
            close_nearest((tag,), () if tag in BLOCK else BLOCK)  # an inline element's end doesn't close blocks
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in ("html", "body") and opened[tag] > 0:
            continue
        if tag in P_CLOSERS:
            close_nearest(("p",), BLOCK)
        if tag in SIBLINGS:
            close_nearest(SIBLINGS[tag], SCOPES)
        if tag in BLOCK:
            end_block()
        if tag in VOID:
            continue
        own = _element(tag, attrs, stack[-1])
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            end = page.find(">", close.end()) if close else -1
            stream.send(end + 1 if end >= 0 else len(page))
            continue
        stack.append(own)
        opened[tag] += 1
        links += tag == "a"
    pop(0)
    end_block()
    return out


def log_odds(b: Block) -> float:
    """The classifier: log-odds that a block is boilerplate."""
    n = len(b.text)
    words = b.text.count(" ") + 1
    return (
        b.parent.log_odds
        + LINK_WEIGHT * min(1.0, b.linked / max(1, n))
        + (HEADING_WEIGHT if b.parent.tag in ("h1", "h2", "h3", "h4", "h5", "h6") else 0)
        + LENGTH_WEIGHT * min(4.0, words / 10)
    )


def tree_distance(a: Element, b: Element) -> int:
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def min_cut(costs: list[tuple[int, int]], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for the nodes on the content side of a minimum cut.

    ``costs``: what a node costs as content and as boilerplate. ``edges``: two nodes and what labelling them differently
    costs. Dinic's algorithm from the content terminal; ties go to content, the side that reaches the sink no more.
    """
    n = len(costs)
    s, t = n, n + 1
    to, cap, at = [], [], [[] for _ in range(n + 2)]

    def join(u: int, v: int, c: int, back: int):
        at[u].append(len(to))
        to.append(v)
        cap.append(c)
        at[v].append(len(to))
        to.append(u)
        cap.append(back)

    for i, (content, boiler) in enumerate(costs):
        direct = min(content, boiler)  # flows straight through
        if boiler > direct:
            join(s, i, boiler - direct, 0)
        if content > direct:
            join(i, t, content - direct, 0)
    for u, v, c in edges:
        join(u, v, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in at[u]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            break
        nxt = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if not cap[e])
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while nxt[u] < len(at[u]):
                e = at[u][nxt[u]]
                if cap[e] and level[to[e]] == level[u] + 1:
                    break
                nxt[u] += 1
            else:
                if u == s:
                    break
                level[u] = -1
                u = to[path.pop() ^ 1]
                continue
            path.append(e)
            u = to[e]
    # Content: all that can't reach the sink in the residual graph.
    reach = [False] * (n + 2)
    reach[t] = True
    queue = deque([t])
    while queue:
        v = queue.popleft()
        for e in at[v]:
            if cap[e ^ 1] and not reach[to[e]]:
                reach[to[e]] = True
                queue.append(to[e])
    return [not reach[i] for i in range(n)]


def graph(blocks: list[Block]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """What each block costs as content and as boilerplate, and what labelling two blocks differently costs."""
    costs, edges, last = [], [], {}
    for i, b in enumerate(blocks):
        x = int(round(UNIT * log_odds(b)))
        costs.append((max(0, x), max(0, -x)))
        if i:
            edges.append((i - 1, i, int(UNIT * NEXT_WEIGHT / (1 + tree_distance(blocks[i - 1].parent, b.parent)))))
        parent = id(b.parent.parent)
        j = last.get(parent)
        if j is not None and j != i - 1:
            edges.append((j, i, int(UNIT * SIBLING_WEIGHT / (1 + tree_distance(blocks[j].parent, b.parent)))))
        last[parent] = i
    return costs, [e for e in edges if e[2]]


def extract(page: str | None) -> str:
    """The main text of a page, a line for each block; empty for null and for pages without content."""
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, keep in zip(blocks, min_cut(*graph(blocks))) if keep)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` for every row of ``pages``.

    A null or empty html gives an empty text; other nulls and repeated rows come back as given; other columns are ignored;
    an empty table gives an empty result. A comment or tag that nothing ends runs to the end of the page, however long.
    """

    def apply(batches):
        for b in batches:
            got = [extract(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(got, pa.string()), pa.array([len(x) for x in got], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    out = pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(apply, "page_id long, url string, text string, n_chars long")
    return few_files(out, pages.count(), texts=True)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
