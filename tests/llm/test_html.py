import html
import itertools
import math
import re

import numpy as np
import pytest

from quarrymill.llm import html_text as X
from quarrymill.llm.html_blocks import read
from quarrymill.llm.html_labelled import labelled_pages


def runs(text):
    page = read(text)
    return [(page.tags[p], t) for p, t in zip(page.parents, page.texts) if t]


@pytest.mark.parametrize("source, want", [
    ("", []),
    ("plain &amp; &#233;&nbsp;\n text", [("html", "plain & é text")]),
    ("<p>a<p><b>b<br>c</b><p>d</div>", [("p", "a"), ("p", "b c"), ("p", "d")]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", [("li", "a"), ("li", "b"), ("li", "c"), ("li", "d")]),
    ("<table><tr><td>1<td>2<tr><th>3</div>4</table>5", [("td", "1"), ("td", "2"), ("th", "34"), ("html", "5")]),
    ("<div>a<p>b</p>c</div>", [("div", "a"), ("p", "b"), ("div", "c")]),
    ("<script>var t='</p>';<p>x</SCRIPT >a<style>p{}</style><!-- <p>b --><textarea><p>c</textarea>d", [("html", "a d")]),
    ("<head><title>t</title><body><h1>x</h2>y", [("h1", "x"), ("body", "y")]),
    ("<head><title>t<body>x", [("body", "x")]),
    ('a<span title="x>y" b=\'>\'>b</span>1 < 2 <3', [("html", "ab1 < 2 <3")]),
    ("<p it's>a</p><p>b's</p>", [("p", "a"), ("p", "b's")]),
    ("&lt;p&gt;&am &copy &#0; &#xD800; &bogus;", [("html", "<p>&am © � � &bogus;")]),
    ("a<!-->b<!--->c<!x>d<?y>e</>f<!-- open", [("html", "abcdef")]),
    ("<dl><dt>a<dd>b<dt>c</dl><h1>d<h2>e", [("dt", "a"), ("dd", "b"), ("dt", "c"), ("h1", "d"), ("h2", "e")]),
])
def test_reader(source, want):
    assert runs(source) == want


def test_words_of_attributes():
    page = read('<div class="cookieNotice ad-box2" ID=top role=\'main\'><p hidden style="display:none">x')
    assert page.names[1] == ("cookie", "notice", "ad", "box", "top", "main") and page.names[2] == ("-hidden",)


@pytest.mark.parametrize("bad", ["<div>", "</b>", '<a b="', "<!--", "<p>x", "<li>", "<", "&", "<ul><li>", "<table><tr><td>", "</h2><div>"])
def test_broken_pages_end(bad):
    """Neither deep nor broken pages take more than a few passes, and the model reads them, too."""
    assert isinstance(X.Model({}, np.zeros(0), np.zeros((X.EDGES, 2, 2))).texts([bad * 20_000])[0], str)


def test_sum_product_like_all_assignments():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 9):
        parent = np.array([-1, *(int(rng.integers(0, i)) for i in range(1, n))])
        depth = [0] * n
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        levels = [np.array([i for i in range(n) if depth[i] == d]) for d in range(1, max(depth) + 1)]
        kind, own, edge = rng.integers(0, X.EDGES, n), rng.normal(0, 2, n), rng.normal(0, 1, (X.EDGES, 2, 2))
        odds, joint = X.sum_product(X.Forest(parent, kind, levels, None, None, [0]), own, edge)
        total, single, both = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for values in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(own[i] * v for i, v in enumerate(values)) + sum(edge[kind[i], values[parent[i]], values[i]] for i in range(1, n)))
            total += w
            single += w * np.array(values)
            for i in range(1, n):
                both[i, values[parent[i]], values[i]] += w
        assert np.allclose(1 / (1 + np.exp(-odds)), single / total)
        assert np.allclose(joint[1:], both[1:] / total)


def test_training_follows_the_likelihood():
    """The slope by messages is that of the likelihood by differences."""
    pages = labelled_pages(6, 2)
    read_pages = [read(h) for h, _ in pages]
    numbers = {}
    forest = X.Forest.of(read_pages, numbers, grow=True)
    y = np.concatenate([X.labels(p, t) for p, (_, t) in zip(read_pages, pages)])
    rng = np.random.default_rng(1)
    model = X.Model(numbers, rng.normal(0, 0.3, len(numbers)), rng.normal(0, 0.3, (X.EDGES, 2, 2)))

    def log_likelihood(weights):
        own = np.bincount(forest.row, weights=weights[forest.feature], minlength=len(y))
        chain = 0.0  # by the chain rule: the root, then each node given its parent, both by messages
        odds, joint = X.sum_product(forest, own, model.edge)
        for i in range(len(y)):
            if forest.parent[i] < 0:
                chain += -math.log1p(math.exp(-odds[i] if y[i] else odds[i]))
            else:
                pair = joint[i, y[forest.parent[i]]]
                chain += math.log(pair[y[i]] / pair.sum())
        return chain

    odds, _ = X.sum_product(forest, model.own(forest), model.edge)
    miss = y - 1 / (1 + np.exp(-odds))
    slope = np.bincount(forest.feature, weights=miss[forest.row], minlength=len(numbers))
    for k in rng.integers(0, len(numbers), 12):
        step = np.zeros(len(numbers))
        step[k] = 1e-5
        assert abs((log_likelihood(model.weights + step) - log_likelihood(model.weights - step)) / 2e-5 - slope[k]) < 1e-4


def test_labels_by_alignment():
    page = read("<nav>Home</nav><article><h1>Home</h1><p>Text  one.</p><div class=ad>Buy</div><p>Text two.</article>")
    y = X.labels(page, "Home\n\nText one.\n\nText two.")
    assert [t for t, k in zip(page.texts, y) if t and k][-2:] == ["Text one.", "Text two."] and sum(y[i] for i, t in enumerate(page.texts) if t) == 3
    assert y[page.tags.index("article")] == 1 and y[page.tags.index("div")] == 0
    assert not X.labels(read(""), "x").any() and not X.labels(page, "").any()


def test_held_out_made_up_pages():
    """Blocks of pages that were not learned: over 0.95 of what is returned belongs there, and of what belongs there is returned."""
    pages = labelled_pages(300, 77)
    both = extra = missing = 0
    for got, (_, want) in zip(X.default_model().texts([h for h, _ in pages]), pages):
        a, b = set(got.split("\n\n")), set(want.split("\n\n"))
        both, extra, missing = both + len(a & b), extra + len(a - b), missing + len(b - a)
    assert both / (both + extra) > 0.95 and both / (both + missing) > 0.95


PAGE = """<!DOCTYPE html><html><head><title>The tide</title><meta charset=utf-8><link rel=x><style>p{}</style></head><body>
<div id="cookie-notice"><p>We use cookies to improve this site. You can accept them all.</p><button>Accept</button></div>
<header class="site-header"><h1>Harbour News</h1><p>All that floats</p></header>
<nav><ul><li><a href=/>Home</a></li><li><a href=/a>Sport</a></li><li><a href=/b>Culture</a></li></ul></nav>
<div class="ad">Buy boats now. They are cheap. Only today.</div>
%s
<aside class="sidebar"><h3>Most read</h3><ul><li><a href=/1>Ten harbours</a></li><li><a href=/2>Five boats</a></li></ul></aside>
<section id="comments"><h3>2 comments</h3><div class="comment"><p>I liked this piece a lot. The author knows the sea.</p></div><div class="comment"><p>Nonsense! Tides do not wait.</p></div></section>
<form class="newsletter"><p>Subscribe to our newsletter.</p><label>Mail</label><input><select><option>a</select></form>
<footer>&copy; 2024 Harbour News &middot; All rights reserved.</footer></body></html>"""
TIDE = "<h1>The tide &amp; the town</h1><p>At six the water <a href=/w>came back</a>,\n as it does.<p><b>Nobody minded.<br><ul><li>boats rose</li><li>ropes held</li></ul><p>Yes.</p>"
TIDE_TEXT = "The tide & the town\n\nAt six the water came back, as it does.\n\nNobody minded.\n\nboats rose\n\nropes held\n\nYes."


@pytest.mark.parametrize("wrapper", ["<article>%s</article>", "<main>%s</main>", "<main><article class=post>%s</article></main>", '<div id="content">%s</div>', '<div class="post-content entry">%s</div>'])
def test_all_kinds_of_other_text_go(wrapper):
    assert X.default_model().texts([PAGE % (wrapper % TIDE)]) == [TIDE_TEXT]


def test_inside_the_article_too():
    inside = TIDE.replace("<p>Yes.</p>", '<div class="ad">Buy boats now. They are cheap.</div><aside class="related"><h4>Related</h4><a href=/x>Ten harbours</a></aside><p>Yes.</p>')
    assert X.default_model().texts([PAGE % f"<article>{inside}</article>"]) == [TIDE_TEXT]


def plain(page):
    """The table's pages have one article each, of headings and paragraphs."""
    inside = page[page.index("<article>") + 9 : page.rindex("</article>")]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"<p>|</p>|<h1>|</h1>", inside))
    return "\n\n".join(b for b in blocks if b)


def test_table_pages(spark):
    got = {r.page_id: r for r in X.op13(spark, "/root/testdata/sf0.01").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert (got[r.page_id].url, got[r.page_id].text, got[r.page_id].n_chars) == (r.url, plain(r.html), len(plain(r.html)))


def test_odd_rows(spark):
    long = "<article>" + "<p>A sentence of the article, as it goes on.</p>" * 30_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<nav><a>x</a></nav>"), (4, "w", PAGE % f"<article>{TIDE}</article>"), (4, "w", PAGE % f"<article>{TIDE}</article>"), (5, "x", long), (6, "y", "\u0000<p>퟿🙂")]
    df = spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, kept int").repartition(3)
    found = X.extract(df)
    assert found.columns == ["page_id", "url", "text"]
    got = sorted(((r.page_id, r.url, r.text) for r in found.collect()), key=str)
    assert [r for r in got if r[0] in (1, 2, None)] == [(1, "u", ""), (2, None, ""), (None, "v", "")]
    assert [r[2] for r in got if r[0] == 4] == [TIDE_TEXT] * 2
    assert next(r[2] for r in got if r[0] == 5).count("\n\n") == 29_999
    assert X.extract(df.limit(0)).collect() == []


def test_without_labelled_pages():
    model = X.train([])
    assert len(model.texts(["<p>a</p>", None])) == 2
