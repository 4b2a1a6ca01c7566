import itertools
import re
from html import unescape

import numpy as np
import pytest
from helpers import SF_SMALL

from tablelens.llm import html_extract, queries
from tablelens.llm.html_pages import labelled_pages
from tablelens.llm.html_tree import parse


@pytest.fixture(scope="module")
def model():
    return html_extract.default_model()


def test_messages_are_the_sums_over_all_labellings():
    page = parse('<div class=x><p>a</p><ul><li>b</li><li id=y>c</li></ul></div><p>d</p>')
    trees = html_extract.forest([page])
    r = np.random.default_rng(1)
    n = len(page.nodes)
    score, pair = r.normal(size=n), r.normal(size=(2, 2, 2))
    marginal, edge, log_z = html_extract.messages(trees, score, pair)
    total, want, want_edge = 0.0, np.zeros((n, 2)), np.zeros((n, 2, 2))
    for y in itertools.product((0, 1), repeat=n):
        p = np.exp(sum(score[i] * y[i] for i in range(n)) + sum(pair[trees.kind[i], y[trees.parent[i]], y[i]] for i in range(1, n)))
        total += p
        for i in range(n):
            want[i, y[i]] += p
            if i:
                want_edge[i, y[trees.parent[i]], y[i]] += p
    assert np.isclose(np.exp(log_z), total)
    assert np.allclose(marginal, want / total) and np.allclose(edge[1:], want_edge[1:] / total)


def test_held_out_labelled_pages(model):
    pages = [parse(s) for s in labelled_pages(200, seed=1234)]
    right = total = 0
    for page, chance in zip(pages, html_extract.marginals(pages, model)):
        for node, _ in page.runs:
            right += (chance[node] > 0.5) == (page.nodes[node].label == "1")
            total += 1
    assert right / total > 0.97


def plain(source):
    """The article of the given pages by hand."""
    m = re.search(r"<article>(.*?)(</article>|$)", source, re.S)
    blocks = re.split(r"</?(?:p|h1)>", m[1]) if m else []
    texts = [" ".join(unescape(b.replace("<br>", " ").replace("<b>", "")).split()) for b in blocks]
    return "\n\n".join(t for t in texts if t)


def test_query(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    rows = queries.QUERIES["op6_tree_model"](spark, SF_SMALL).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == plain(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


ARTICLE = "<p>The first paragraph of the story is here, and it has some words.</p><p>The second one, too; it isn&#39;t long.</p>"
WANT = "The first paragraph of the story is here, and it has some words.\n\nThe second one, too; it isn't long."


@pytest.mark.parametrize(
    "source, want",
    [
        (f"<article>{ARTICLE}</article>", WANT),
        (f"<nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></nav><div class='content'>{ARTICLE}</div><footer>&copy; all rights reserved</footer>", WANT),
        (f"<header><p>A site</p></header><main>{ARTICLE}<div class='ad'>Buy this now. It is cheap.</div></main><div id='comments'><h2>Comments</h2><div class='comment'><p>I like it very much, thank you.</p></div></div>", WANT),
        (f"<div class=cookie-notice><p>We use cookies. Do you agree?</p></div><article><h1>Title</h1>{ARTICLE}</article><aside class=sidebar><p>Other things that you may like.</p></aside>", "Title\n\n" + WANT),
        (f"<article>{ARTICLE}<form class=search><p>Search here</p><input></form></article>", WANT),
        ("<article><p>One<p>Two <b>bold</b>&nbsp; and\n more<br>line<script>var t='</p>';</script><style>p{}</style></article>", "One\n\nTwo bold and more line"),
        ("<article><p>Cut off in a ta<a hre", "Cut off in a ta"),
        ("<article><p>Cut off in a comment <!-- never ends </p><p>x", "Cut off in a comment"),
        ("<article><p>1 < 2 &amp;&amp; 3 > 2 &lt;b&gt; &unknown; &am</p></article>", "1 < 2 && 3 > 2 <b> &unknown; &am"),
        ("", ""),
        ("<html><head><title>x</title></head><body></body></html>", ""),
    ],
)
def test_pages(model, source, want):
    assert html_extract.extract([source], model) == [want]


def test_edges(spark, model):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    rows = [(1, "u", None, "z"), (1, "u", "", "z"), (None, None, f"<article>{ARTICLE}</article>", None), (2, "v", deep, ""), (3, "w", f"<article>{ARTICLE * 500}</article>", ""), (3, "w", f"<article>{ARTICLE * 500}</article>", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract_pages(pages, model=model)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    by = {(r.page_id, r.url): r.text for r in got.collect()}
    assert got.count() == 6 and by[1, "u"] == "" and by[None, None] == WANT and by[3, "w"] == "\n\n".join([WANT] * 500)
    assert html_extract.extract_pages(pages.limit(0), model=model).count() == 0
