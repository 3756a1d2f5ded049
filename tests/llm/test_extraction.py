"""Main text of pages: blocks of markup, gradients, held-out layouts, given pages."""

import re

import numpy as np
import pytest

from vagari.llm.extraction import Blocks, ExtractParams, Labeller, labelled, main_blocks, main_text, trained
from vagari.llm.html_blocks import Paths, page_blocks
from vagari.llm.layouts import Layouts

SCHEMA = "page_id long, url string, html string"


def texts(html):
    return [b[1] for b in page_blocks(html, Paths())]


@pytest.mark.parametrize("html, want", [
    ("", []), ("plain  text\n here", ["plain text here"]), ("a<br>b<p>c<p>d</p>e", ["a b", "c", "d", "e"]), ("<p>x &lt;b&gt; &amp &copy;&#233;&nbsp;y</p>", ["x <b> & ©é y"]),
    ("<div title='a > b'>one</div><!-- <p>no</p> -->two", ["one", "two"]), ("<script>if (a<b) '</p>'</script><style>p{}</style><title>t</title>x", ["x"]), ("<SCRIPT>never ends", []), ("a < b and <3", ["a < b and <3"]),
    ("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>5", ["1", "2", "3", "4", "5"]), ("<p><b>head<br><p>text</b> more</p>", ["head", "text more"]), ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]), ("x</div></p>y", ["x", "y"]), ("end <p class=", ["end"]), ("<p>a<hr>b", ["a", "b"]), ("<!doctype html><?xml?><x-y>own</x-y>z", ["own", "z"]), ("w<b>or</b>d", ["word"]),
])
def test_blocks(html, want):
    assert texts(html) == want


def test_states_and_links():
    paths = Paths()
    got = list(page_blocks('<div class="side-bar"><p>a <a href=x>link</a></p><p>b</p></div><p>c</p>', paths))
    assert [(t, n) for _, t, n in got] == [("a link", 4), ("b", 0), ("c", 0)]
    assert got[0][0] == got[1][0] != got[2][0] and {".side", ".bar", "p", "div"} == paths.above[got[0][0]]


def test_deep_and_odd_pages_end():
    assert texts("<div><b>" * 20000 + "x" + "<p>y" * 20000)[:2] == ["x", "y"]
    assert texts("<" * 5000 + "<a b='" * 5000)


def test_gradients():
    p = ExtractParams(embed=5, hidden=3, word_buckets=16)
    paths, draw = Paths(), Layouts(3)
    pages, labels = labelled([draw.page() for _ in range(3)], paths)
    b, model = Blocks(pages, paths.features, 16), Labeller.fresh(p)
    b.numbers = b.numbers.astype(np.float64)
    model = Labeller({k: v.astype(np.float64) for k, v in model.p.items()})

    def loss():
        s = model.scores(b)
        return -np.mean(labels * np.log(s) + (1 - labels) * np.log(1 - s))

    g, r = model.step(b, labels), np.random.default_rng(0)
    for name, w in model.p.items():
        at = np.unravel_index(np.abs(g[name]).argmax() if name in ("paths", "words") else r.integers(w.size), w.shape)
        old, step = w[at], 1e-5
        w[at] = old + step
        up = loss()
        w[at] = old - step
        down = loss()
        w[at] = old
        assert abs((up - down) / (2 * step) - g[name][at]) < 1e-4 * max(1, abs(g[name][at])), name


def test_layouts_that_it_has_not_seen():
    p, paths, draw = ExtractParams(), Paths(), Layouts(4711)
    pages, labels = labelled([draw.page() for _ in range(500)], paths)
    right = (trained(p).scores(Blocks(pages, paths.features, p.word_buckets)) >= p.threshold) == (labels > 0)
    assert right.mean() > 0.99


def test_pages_stand_on_their_own():
    p, draw = ExtractParams(), Layouts(5)
    pages = [re.sub("[]", "", draw.page()) for _ in range(40)]
    assert main_blocks(trained(p), pages, p) == [main_blocks(trained(p), [x], p)[0] for x in pages]


PAGE = """<!DOCTYPE html><html><head><title>T</title></head><body class="home">
<div class="cookie-banner">We use cookies. <button>Accept</button></div><header class="site-header"><a href="/">The Daily</a><form><label>Search</label><input></form></header>
<ul class="menu"><li><a href="/a">News</a></li><li><a href="/b">Sport</a></li></ul>
<div id="wrapper"><div class="post-content"><h1>Boats on the lake</h1><p>The first boats went out at dawn, and the lake lay still.</p>
<div class="advertisement">Buy a boat today!</div><p>By noon a wind had come up &amp; all were back.</p><ul><li>three sails</li><li>two oars</li></ul></div>
<aside class="sidebar"><h3>Popular</h3><ul><li><a href="/x">Ten best lakes</a></li></ul></aside></div>
<section id="comments"><h2>2 comments</h2><div class="comment"><p>Anna</p><p>I liked the part about the wind very much, thank you for it.</p></div></section>
<footer>&copy; 2024 The Daily</footer></body></html>"""


def test_a_page():
    assert main_blocks(trained(), [PAGE], ExtractParams())[0] == ["Boats on the lake", "The first boats went out at dawn, and the lake lay still.", "By noon a wind had come up & all were back.", "three sails", "two oars"]


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in main_text(pages).collect():
        assert r.text == "\n".join(texts(re.search("<article>(.*)</article>", html[r.page_id], re.S).group(1))), r.page_id
        assert r.n_chars == len(r.text)


def test_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", ""), (None, None, "<p>"), (2, "u", PAGE), (2, "u", PAGE), (3, "v", "<article>" + "<p>A line of this page, of some length.</p>" * 3000 + "</article>")]
    got = main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.page_id, r.url, r.n_chars) for r in got][:3] == [(1, "u", 0), (1, "u", 0), (None, None, 0)]
    assert got[3] == got[4] and got[3].n_chars > 100 and got[5].text.count("\n") == 2999
    assert main_text(spark.createDataFrame([], SCHEMA)).collect() == []
    clash = spark.createDataFrame([(1, "u", PAGE, "x", 7)], SCHEMA + ", text string, n_chars int")
    assert main_text(clash).columns == ["page_id", "url", "text", "n_chars"]
