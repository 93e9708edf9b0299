"""HTML main-text extraction by the maximum-scoring subsequence of a page's tokens.

Each word and tag of a page is of a kind: words of text, of a link, in boilerplate (by tag, or by class and id), or beside the
page's article; tags by name, and whether they stand in boilerplate. Kinds are weighed by their log-odds in labelled pages (a
bounded, generated set by default): words score positive and tags negative. One linear scan finds the best contiguous
region. It is filled up to the edges of the innermost element that holds all of it, so that short last lines of an
article are not lost, and its boilerplate (menus, headers, footers, sidebars, notices, adverts, forms, reader comments) is
left out. Each page is handled on its own, in time linear in its length, so nothing is shuffled.

Classes, ids and roles are read as attributes; within an article only one that is such a word as a whole counts. One
that sounds like boilerplate does not make an element boilerplate if it holds the page's article or more than half of
its words (but for reader comments), or if it is an article's header. Elements after the one with most of the
words are left out if they say little to a line. Scripts, styles and the like end no block.

Defined cases: null or empty html gives an empty text; unclosed, stray and cut-off tags and any depth of nesting are
tolerated; pages without words give an empty text; repeated rows are each extracted; other columns pass through, but for
one that has the name of the result, which is replaced.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from voxframe.storage import prepare

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[/a-zA-Z!?](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|<[/a-zA-Z!?][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
_NAME = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9]*)")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br del picture source".split())
#: Elements that are a part of a text, never the whole of it.
BLOCKS_OF_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tr td th figure figcaption details summary address hgroup".split())
#: Lines that belong to a text wherever they stand in it.
TEXT_LINES = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER_TAGS = frozenset("nav header footer aside form head menu button select option dialog fieldset legend".split())
BOILER_MARKS = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads adv advert adverts advertisement advertising banner promo sponsor "
    "sponsored cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription share sharing social "
    "related recommended recommendations breadcrumb breadcrumbs widget pagination pager login signup search toolbar skip complementary "
    "contentinfo copyright".split()
)
#: Words that go with such a word in a class or id without changing what it means ("site-header", not "search-results").
PLAIN_MARKS = frozenset(
    "site page top bottom left right wrapper wrap container box block list links link bar item items inner outer global primary secondary main area "
    "section posts articles stories content column col slot unit zone panel".split()
)
COMMENT_MARKS = frozenset("comment comments reply replies respond disqus".split())
MAIN_TAGS = frozenset(("article", "main"))
MAIN_MARKS = frozenset("main article content post entry story articlebody".split())


def attributes(tag: str) -> dict[str, str]:
    """Names (lower case) and values of a tag's attributes; the first of a name counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(tag, _NAME.match(tag).end()):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _sounds_like(names: list[str], within_article: bool) -> bool:
    """Whether a class, id or role is a word for boilerplate, or outside an article such a word and plain ones."""
    if within_article:
        return any(n in BOILER_MARKS for n in names)
    parts = [{w for w in re.split(r"[^a-z]+", n) if w} for n in names]
    return any(p & BOILER_MARKS and p <= BOILER_MARKS | PLAIN_MARKS for p in parts)


class _Node:
    """An element; elements are numbered in page order, and ``last`` is the greatest number within."""

    __slots__ = ("name", "parent", "order", "last", "mark", "main", "boiler")

    def __init__(self, name: str, parent: _Node | None, order: int, mark: str, main: bool):
        self.name, self.parent, self.order, self.last, self.mark, self.main, self.boiler = name, parent, order, order, mark, main, False


def _element(name: str, tag: str, node: _Node, order: int) -> _Node:
    own = attributes(tag)
    names = [n for a in ("class", "id", "role") for n in own.get(a, "").lower().split()]
    words = {w for n in names for w in re.split(r"[^a-z0-9]+", n)}
    if name in ("html", "body"):
        mark = ""
    elif own.get("hidden", "until-found") != "until-found" or _UNSEEN.search(own.get("style", "")) or (name in BOILER_TAGS and not (name == "header" and node.main)):
        mark = "tag"
    elif words & COMMENT_MARKS:
        mark = "comment"
    elif _sounds_like(names, node.main):
        mark = "" if words & BOILER_MARKS == {"header"} and (node.main or words & MAIN_MARKS) else "marked"
    else:
        mark = ""
    return _Node(name, node, order, mark, node.main or (name in MAIN_TAGS and mark not in ("tag", "comment")))


def parse(page: str) -> tuple[list[tuple[str, str, _Node, int, bool]], list[_Node]]:
    """(word or tag name, text, element, block, in a link) in page order, and all elements."""
    root = node = _Node("root", None, 0, "", False)
    out, nodes, block, linked = [], [root], 0, False
    opened: Counter[str] = Counter()
    for m in _TOKEN.finditer(page):
        s = m[0]
        if s[0] != "<" or s == "<":
            out.append(("", s, node, block, linked))
            continue
        n = _NAME.match(s)
        if not n:
            continue
        name, closing = n[1].lower(), s[1] == "/"
        if m[1] or name in ("br", "wbr", "img"):
            if name == "br":
                out.append(("br", " ", node, block, linked))
            continue
        if name in INLINE:
            if name == "a":
                linked = not closing
            out.append((name, "", node, block, linked))
            continue
        block += 1
        linked = False
        out.append((name, "", node, block, False))
        if closing:
            while opened[name]:
                opened[node.name] -= 1
                found, node = node.name == name, node.parent
                if found:
                    break
            continue
        if name in VOID:
            continue
        if (node.name in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and name != "head") or (name in ("li", "tr", "td", "th", "dt", "dd", "option") and node.name == name):
            opened[node.name] -= 1
            node = node.parent
        node = _element(name, s, node, len(nodes))
        opened[name] += 1
        nodes.append(node)
    for x in reversed(nodes):
        if x.parent:
            x.parent.last = max(x.parent.last, x.last)
    return out, nodes


def tokens(page: str) -> list[tuple[str, str, _Node, int]]:
    """(kind, text, element, block) in page order; kinds are ``word:`` text, link, beside, boiler, or ``tag:`` and a name."""
    out, nodes = parse(page)
    for x in nodes[1:]:  # words that are boilerplate for sure
        x.boiler = x.parent.boiler or x.mark in ("tag", "comment")
    said = [0] * len(nodes)
    for name, s, x, _, linked in out:
        if not name and not x.boiler and not linked:
            said[x.order] += len(s.split())
    upto = [0, *accumulate(said)]
    mains = [x.order for x in nodes if x.main and not x.boiler and not x.parent.main]
    held = sum(upto[nodes[i].last + 1] - upto[i] for i in mains)
    has_main = held * 4 >= upto[-1] and held > 0
    for x in nodes[1:]:
        mark = x.mark
        if mark == "marked":
            at = bisect_left(mains, x.order)
            if (at < len(mains) and mains[at] <= x.last) or 2 * (upto[x.last + 1] - upto[x.order]) > upto[-1]:
                mark = ""
        elif mark == "comment":
            at = bisect_left(mains, x.order)
            if at < len(mains) and mains[at] <= x.last and x.name not in MAIN_TAGS:
                mark = ""
        x.boiler = x.parent.boiler or bool(mark)

    def kind(name: str, x: _Node, linked: bool) -> str:
        if name:
            return f"tag:{name}:boiler" if x.boiler else f"tag:{name}"
        return "word:boiler" if x.boiler else "word:beside" if has_main and not x.main else "word:link" if linked else "word:text"

    return [(kind(name, x, linked), s, x, block) for name, s, x, block, linked in out]


def labelled_pages(n: int = 200, seed: int = 7) -> list[tuple[str, str]]:
    """n generated pages, each as (html, main text's html part): the labelled sample of fixed, bounded size.

    A third has an ``article``, a third a ``div`` with a telling class and a third a plain one; a line beside it that no
    tag or class tells from text stands in a quarter of them.
    """
    rng = random.Random(seed)
    words = "river stone market evening letter garden winter music table window children number paper morning history".split()

    def said(a: int, b: int) -> str:
        return " ".join(rng.choice(words) for _ in range(rng.randint(a, b)))

    out = []
    for _ in range(n):
        body = f"<h1>{said(3, 9)}</h1>" + "".join(
            rng.choice(
                (
                    f"<p>{said(8, 90)}</p>",
                    f"<p>{said(5, 60)} <a href=#>{said(1, 3)}</a> {said(3, 20)}</p>",
                    f"<h2>{said(2, 5)}</h2><p><b>{said(1, 4)}</b> {said(10, 60)}<br></p>",
                    f"<ul><li>{said(2, 12)}</li><li>{said(2, 12)}</li></ul>",
                    f"<blockquote><p>{said(10, 40)}</p></blockquote>",
                )
            )
            for _ in range(rng.randint(2, 9))
        )
        menu = rng.choice(("<nav><ul>{}</ul></nav>", "<div class=menu><ul>{}</ul></div>", "<ul>{}</ul>")).format("".join(f"<li><a href=#>{said(1, 2)}</a></li>" for _ in range(rng.randint(3, 9))))
        line = f"<div>{said(1, 4)}</div>" if rng.random() < 0.25 else ""
        side = rng.choice(("", f"<aside><h3>{said(1, 3)}</h3><ul>" + f"<li><a href=#>{said(2, 5)}</a></li>" * 4 + "</ul></aside>", f'<div class="ad">{said(3, 9)}</div>'))
        foot = rng.choice((f"<footer>{said(3, 12)}</footer>", f'<div class="comments"><p>{said(5, 15)}</p></div><footer><a href=#>{said(1, 2)}</a> {said(2, 6)}</footer>', f"<form>{said(2, 4)}<input></form><footer>{said(3, 8)}</footer>"))
        start, end = rng.choice((("<article>", "</article>"), ('<div class="post">', "</div>"), ("<div>", "</div>")))
        out.append((menu + line + side, start + body + end, foot))
    return [(a + b + c, b) for a, b, c in out]


def learn(pages: list[tuple[str, str]]) -> dict[str, float]:
    """Log-odds of each kind inside against outside the main part; words of text at least 0.05, tags at most -0.05."""
    inside, all_of = Counter(), Counter()

    def count(into: Counter, page: str) -> None:
        for kind, s, _, _ in tokens(page):
            into[kind] += len(s.split()) if kind.startswith("word") else 1

    for page, main in pages:
        count(inside, main)
        count(all_of, page)
    outside = {k: max(0, all_of[k] - inside[k]) for k in all_of}
    a, b = sum(inside.values()), sum(outside.values())
    out = {}
    for k in {*inside, *outside}:
        x = math.log((inside[k] + 0.5) / (a + 1)) - math.log((outside.get(k, 0) + 0.5) / (b + 1))
        out[k] = max(0.05, x) if k == "word:text" else min(-0.05, x)
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and last index of the maximum-scoring contiguous run (Kadane's scan); (0, -1) if none is positive."""
    best, at, run, start = 0.0, (0, -1), 0.0, 0
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, at = run, (start, i)
    return at


def _end_of_article(toks: list[tuple[str, str, _Node, int]], top: _Node) -> int:
    """The last element of the article within top. Where one child of top has most of its words, elements after it that say little
    to a line (reader comments and footers that no tag or name tells) do not belong to the article; lines of text do."""
    words: Counter[_Node] = Counter()
    child: dict[_Node, _Node] = {}
    lines: dict[_Node, set[int]] = {}
    kept = 0
    for kind, s, x, block in toks:
        if kind in ("word:text", "word:link") and top.order <= x.order <= top.last and (n := len(s.split())):
            kept += n
            path = []
            while x not in child and x is not top and x.parent is not top:
                path.append(x)
                x = x.parent
            x = child.get(x, x)
            child.update((y, x) for y in path)  # so that each element is climbed once
            words[x] += n
            lines.setdefault(x, set()).add(block)
    body, most = max(words.items(), key=lambda w: w[1], default=(top, 0))
    if body is top or body.name in BLOCKS_OF_TEXT or 2 * most < kept or top.main:
        return top.last
    after = sorted((x for x in words if x is not top and x.order > body.last), key=lambda x: x.order)
    usual = most / len(lines[body])
    for i, x in enumerate(after):
        if all(y.name not in TEXT_LINES and 3 * words[y] < usual * len(lines[y]) for y in after[i:]):
            return x.order - 1
    return top.last


def main_text(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""
    toks = tokens(page)
    other = weights.get("tag:div", -0.5)
    lo, hi = best_region([weights.get(k, -1.0) * len(s.split()) if k.startswith("word") else weights.get(k, other) for k, s, _, _ in toks])
    held = [x for k, s, x, _ in toks[lo : hi + 1] if k == "word:text" and s.strip()]
    if not held:
        return ""
    top, last = min(held, key=lambda x: x.order), max(x.order for x in held)
    while top.parent and (top.last < last or top.name in BLOCKS_OF_TEXT):
        top = top.parent
    end = _end_of_article(toks, top)
    parts, now = [], None
    for kind, s, x, block in toks:
        if (kind in ("word:text", "word:link") or (kind == "tag:br")) and top.order <= x.order <= end:
            if block != now:
                parts.append([])
                now = block
            parts[-1].append(s)
    blocks = (" ".join(_html.unescape("".join(x)).split()) for x in parts)
    return "\n".join(x for x in blocks if x)


def extract(pages: DataFrame, column: str = "html", into: str = "text", weights: dict[str, float] | None = None) -> DataFrame:
    """pages plus ``into``, the main text."""
    prepare(pages.sparkSession)
    learned = weights or learn(labelled_pages())

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            yield html.map(lambda x: main_text(x, learned), na_action=None).astype(object)

    each.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return pages.withColumn(into, F.pandas_udf(each, StringType())(F.col(column)))
