"""Main text of pages that are hard to tell: scripts in lines, telling names in articles, endings that no name tells."""

import random
import time

import pytest

from voxframe.llm import html_extract

W = html_extract.learn(html_extract.labelled_pages())
LONG = "the old river ran past the market and the stone garden for many winters before anyone wrote its history down"
MORE = "in the evening the children read a letter at the table while music came in from the open window of the house"
PAGES = [
    # scripts, styles and comments end no block
    (f"<article><p>one two<script>x()</script> three {LONG}</p></article>", f"one two three {LONG}"),
    (f"<article><p>one <noscript><img></noscript>two<style>p{{}}</style> {LONG}<!-- c --> end</p></article>", f"one two {LONG} end"),
    (f"<article><p>a<template><p>no</p></template>b {LONG}</p><script>y</script><p>{MORE}</p></article>", f"ab {LONG}\n{MORE}"),
    # names inside an article do not drop its parts
    (f'<article><p>{LONG}</p><section data-id="share"><p>{MORE}</p></section></article>', f"{LONG}\n{MORE}"),
    (f'<article><p>{LONG}</p><section id="related-work"><h2>Related work</h2><p>{MORE}</p></section></article>', f"{LONG}\nRelated work\n{MORE}"),
    (f'<article><p>{LONG}</p><section class="search-results"><p>{MORE}</p></section></article>', f"{LONG}\n{MORE}"),
    (f'<div><p>{LONG}</p><section class="search-results"><p>{MORE}</p></section></div>', f"{LONG}\n{MORE}"),
    (f'<article><p title="hidden gems" data-x="class=ad">{LONG}</p><p data-note="display: none">{MORE}</p></article>', f"{LONG}\n{MORE}"),
    (f'<article><p>{LONG}</p><p hidden="until-found">{MORE}</p><p hidden>no</p><p style="color:red;display:none">no</p></article>', f"{LONG}\n{MORE}"),
    # what is no article goes, in and beside it
    (f'<article><p>{LONG}</p><div class="ad">buy now</div><div class="box share">send</div><p>{MORE}</p></article>', f"{LONG}\n{MORE}"),
    (f'<div class="site-header"><p>A name of a site</p></div><div><p>{LONG}</p></div><div class="footer-links">some words</div>', LONG),
    (f'<article><p>{LONG}</p><ul class="comment-list"><li>{MORE}</li></ul></article>', LONG),
    # endings without a telling tag or name
    (f"<body><div><h1>Title here</h1><p>{LONG}</p><p>{MORE}</p><p>{LONG}</p></div><div><h3>5 responses</h3><ol><li>Nice one</li><li>I agree with this</li><li>me too</li></ol></div><div>All rights kept 2024</div></body>", f"Title here\n{LONG}\n{MORE}\n{LONG}"),
    (f"<body><h1>Title</h1><div><p>{LONG}</p><p>{MORE}</p></div><div>Made by us</div></body>", f"Title\n{LONG}\n{MORE}"),
    # but lines of text and sections like the others stay
    (f"<body><div><p>{LONG}</p><p>{MORE}</p></div><p>The end.</p></body>", f"{LONG}\n{MORE}\nThe end."),
    (f"<body><div><p>{LONG}</p><p>{MORE}</p></div><div><p>{LONG}</p></div></body>", f"{LONG}\n{MORE}\n{LONG}"),
    (f"<article><div><p>{LONG}</p><p>{MORE}</p></div><div>short last part</div></article>", f"{LONG}\n{MORE}\nshort last part"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_page(page, text):
    assert html_extract.main_text(page, W) == text


def test_attributes():
    tag = "<div CLASS='a b' data-id=\"x id=y\" id = main hidden aria-label='it\"s' class=second>"
    assert html_extract.attributes(tag) == {"class": "a b", "data-id": "x id=y", "id": "main", "hidden": "", "aria-label": 'it"s'}
    assert html_extract.attributes("<br/>") == {} and html_extract.attributes("<p") == {}


def test_region_is_the_best_run_of_a_whole_page():
    rng = random.Random(5)
    for page, _ in html_extract.labelled_pages(12, 3):
        toks = html_extract.tokens(page)
        score = [W.get(k, -1.0) * len(s.split()) if k.startswith("word") else W.get(k, -0.5) for k, s, _, _ in toks]
        if rng.random() < 0.5:
            score = [x * rng.uniform(0.2, 2) for x in score]
        sums = [0.0]
        for x in score:
            sums.append(sums[-1] + x)
        best = max(sums[j] - sums[i] for i in range(len(score)) for j in range(i + 1, len(score) + 1))
        lo, hi = html_extract.best_region(score)
        assert sums[hi + 1] - sums[lo] == pytest.approx(best)


def test_repeated_rows_and_depth(spark):
    rows = [(1, PAGES[0][0]), (1, PAGES[0][0]), (2, None), (3, "")]
    got = sorted((r["page_id"], r["text"]) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, html string")).collect())
    assert got == [(1, PAGES[0][1]), (1, PAGES[0][1]), (2, ""), (3, "")]
    deep = "<div>" * 20_000 + f"<p>{LONG}</p>" + "</div><i>x</i>" * 20_000
    start = time.perf_counter()
    assert html_extract.main_text(f"<body>{deep}<div>{MORE}</div></body>", W)
    assert time.perf_counter() - start < 20
