import html
import re
import statistics

import pytest
from helpers import SF

from parchmill.llm import dom, extraction


@pytest.fixture(scope="module")
def model():
    return extraction.trained()


def article(page):
    body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(x for x in blocks if x)


def test_pages_table(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in extraction.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == article(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_held_out_pages(model):
    pages = extraction.Pages(4711)
    right = []
    for _ in range(200):
        nodes = dom.parse(pages.page())
        truth = extraction.states(nodes)
        right += [(m[extraction.ALL] > m[extraction.NONE]) == (t == extraction.ALL) for x, t, m in zip(nodes, truth, model.marginals(nodes), strict=True) if x.tag == "#"]
    assert statistics.mean(right) > 0.98


def test_messages_give_exact_marginals(model):
    nodes = dom.parse("<div><nav><a href=/>x</a></nav><p>Some text here.</p><div class=ad>buy</div></div>")
    got = model.marginals(nodes)
    import itertools

    own = [model.potential(k) for k in extraction.features(nodes)]
    total, marginal = 0.0, [[0.0] * 4 for _ in nodes]
    for states in itertools.product(range(4), repeat=len(nodes)):
        p = model.root[states[0]]
        for i, s in enumerate(states):
            p *= own[i][s] * (model.pairs[states[nodes[i].parent]][s] if i else 1.0)
        total += p
        for i, s in enumerate(states):
            marginal[i][s] += p
    for a, b in zip(got, marginal, strict=True):
        assert a == pytest.approx([x / total for x in b], abs=1e-9)


def texts(page):
    return [x.text for x in dom.parse(page) if x.tag == "#"]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>a<p>b<ul><li>c<li>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<p>one<b>two</b>\n three<br>four</p>", ["onetwo three four"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
        ("<script>if (a < b) '<p>'</script><style>p{}</style>x<!-- y --><p>z", ["x", "z"]),
        ("<p title='a>b'>t</p><p title=\"x>y>u</p>", ["t", "y>u"]),  # a quote that is never closed ends with its tag
        ("a < b and <3 and <p>c", ["a < b and <3 and", "c"]),
        ("<script>never closed <p>x", []),
        ("<div>&#x41;&#66;&nbsp;&copy &lt;p&gt;</div>", ["AB © <p>"]),
        ("</p></div>x</b>", ["x"]),
    ],
)
def test_parsing(page, want):
    assert texts(page) == want


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    rows = [(1, "u", None), (2, None, ""), (None, "u", "bare &lt;text&gt;"), (4, "u", deep), (4, "u", "<p>" * 2000), (5, "u", "<" * 5000), (6, "u", "<a href='" * 3000), (7, "u", "\x00<p>\x01</p>")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = extraction.extract(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == "" and by[None] == "bare <text>"
    assert extraction.extract(pages.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<!DOCTYPE html><html><head><title>t</title><article><p>one<p>two</article>", ["one", "two"]),
        ("<head><meta charset=x><style>p{}</style><script>'<p>no</p>'</script><noscript><p>no</p></noscript> <p>x", ["x"]),
        ("<head><title>t</title>text first<p>x", ["text first", "x"]),
        ("<head><!-- c --><title>t</title></head><p>x", ["x"]),
        ("<head><title>t</title><body><p>x", ["x"]),
        ("<p>if <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> then", ["if x=2 then"]),
    ],
)
def test_open_heads_and_formulas(page, want):
    assert texts(page) == want


def test_pages_without_head_and_body_tags(model):
    pages = extraction.Pages(815)
    for _ in range(50):
        page = pages.page()
        bare = page.replace("</head>", "").replace("<body>", "")
        assert texts(bare) == texts(page) and model.text(bare) == model.text(page)


def test_file_is_what_a_new_fit_gives(model):
    new = extraction.fitted()
    assert set(new.weights) == set(model.weights)
    assert all(a == pytest.approx(b, abs=1e-4) for f, w in new.weights.items() for a, b in zip(w, model.weights[f], strict=True))
    assert all(a == pytest.approx(b, abs=1e-6) for x, y in zip(new.pairs, model.pairs, strict=True) for a, b in zip(x, y, strict=True))


SENTENCE = "The river had risen through the night, and by the morning it stood at the lower edge of the meadow."
#: Pages in the manner of several kinds of sites, by hand; what stands between [[ and ]] is the article.
BY_HAND = {
    "weblog": f"""<html><head><title>x</title></head><body class="single post-template"><div id="page" class="hfeed site"><header id="masthead" class="site-header"><a class="skip-link" href="#content">Skip to content</a><p class="site-title"><a href="/">My Notes</a></p>
<nav id="site-navigation" class="main-navigation"><ul id="primary-menu"><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul></nav></header>
<div id="content" class="site-content"><div id="primary" class="content-area"><main id="main"><article id="post-12" class="post type-post"><header class="entry-header"><h1 class="entry-title">[[High water]]</h1></header>
<div class="entry-content"><p>[[{SENTENCE}]]</p><p>[[{SENTENCE} {SENTENCE}]]</p><h2>[[What we saw]]</h2><ul><li>[[A boat without oars]]</li><li>[[Two swans]]</li></ul><p>[[{SENTENCE}]]</p></div></article>
<div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts</h2><ol class="comment-list"><li class="comment"><p>Nice pictures, thank you!</p></li><li class="comment"><p>I was there as well.</p></li></ol></div></main></div>
<aside id="secondary" class="widget-area"><section class="widget"><h2>Recent Posts</h2><ul><li><a href=/a>Spring</a></li><li><a href=/b>Frost</a></li></ul></section></aside></div>
<footer id="colophon" class="site-footer"><p>Powered by something</p></footer></div></body></html>""",
    "plain": f"""<body><header><a href=/>Home</a> <a href=/x>Contact</a></header><main><h1>[[On rivers]]</h1><p>[[{SENTENCE}]]<p>[[{SENTENCE}]]<blockquote><p>[[{SENTENCE}]]</p></blockquote></main><footer><p>All rights reserved</p></footer>""",
    "tables": f"""<table width=800><tr><td colspan=2><a href=/>Index</a> | <a href=/m>Map</a> | <a href=/s>Search</a></td></tr><tr><td valign=top><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul></td>
<td><h1>[[Of the flood]]</h1><p>[[{SENTENCE}]]<p>[[{SENTENCE} {SENTENCE}]]<p>[[{SENTENCE}]]</td></tr></table>""",
    "news": f"""<html><body><div class="cookie-consent"><p>We use cookies to improve your stay.</p><button>Accept</button></div><div class="top-bar"><ul><li><a href=/w>World</a></li><li><a href=/s>Sport</a></li><li><a href=/c>Culture</a></li></ul></div>
<div class="layout"><div class="article-body" itemprop="articleBody"><h1>[[Town under water]]</h1><p>[[{SENTENCE}]]</p><div class="advert">Buy boots now</div><p>[[{SENTENCE}]]</p><p>[[{SENTENCE} {SENTENCE}]]</p></div>
<div class="related"><h3>More on this</h3><ul><li><a href=/1>Dam holds</a></li><li><a href=/2>Rain ahead</a></li></ul></div></div><div class="newsletter-signup"><form><label>Your address</label><input></form></div><div class="footer"><p>Imprint</p></div></body></html>""",
    "manual": f"""<div role="navigation"><ul><li><a href=a>Install</a></li><li><a href=b>Configure</a></li></ul></div><div role="main"><section id="s1"><h1>[[Measuring]]</h1><p>[[{SENTENCE}]]</p><pre>[[gauge --level 3]]</pre><p>[[{SENTENCE}]]</p><table><tr><td>[[mark]]</td><td>[[metres]]</td></tr></table></section></div><div role="contentinfo"><p>Version 3</p></div>""",
}


def test_pages_by_hand(model):
    right = []
    for page in BY_HAND.values():
        want = [" ".join(x.split()) for x in re.findall(r"\[\[(.*?)\]\]", page, re.S)]
        nodes = dom.parse(page.replace("[[", "").replace("]]", ""))
        blocks = [x.text for x in nodes if x.tag == "#"]
        assert all(w in blocks for w in want)
        got = model.text(page.replace("[[", "").replace("]]", "")).split("\n")
        right += [(b in got) == (b in want) for b in blocks]
    assert statistics.mean(right) >= 0.95
