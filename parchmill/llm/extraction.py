"""Main text of web pages by a tree-structured graphical model (operator 7).

The nodes are a page's blocks and text runs. Each has one of four states: all of it is content, none is, it
lies around the article, or it is the article (or a part) with other things in between. A softmax regression on features of the node gives its own potential; a table gives the
potential of each pair of parent's and child's states. Sum-product messages pass from the leaves up and
from the root down, which on a tree yields the exact marginals; a text run whose content state is the
likelier goes into the text.

Both are trained here, from pages that a generator writes with the state of each text known, and kept in a file beside this module: several layouts,
with and without telling names, with unclosed elements, and with notices, adverts, forms and comments inside
and outside the article. Character references are decoded, white space in a block becomes one space, blocks are
joined by a line feed, and nothing else is dropped.

Null, empty and markup-free pages: null and empty give an empty text; bare text is one block. Equal page_ids are
separate pages; a page_id must be a number or null. Other columns are ignored.
"""

from __future__ import annotations

import json
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.llm.dom import Node, attributes, parse

NONE, AROUND, WITHIN, ALL = range(4)
STATES = 4
#: A private character by which the generator marks content; it is never part of a feature.
KNOWN = ""
#: The fitted model.
FITTED = Path(__file__).with_name("article_model.json")
#: Generated pages, and their seed.
PAGES, SEED = 700, 11

NAME = re.compile(r"[A-Za-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])


# --- features ---------------------------------------------------------------------------------


@lru_cache(maxsize=20_000)
def named(tag: str, raw: str) -> tuple[str, ...]:
    """Features of a tag and its attributes."""
    out = {f"tag={tag}"}
    if raw:
        found = attributes(raw)
        for key in ("class", "id", "role", "aria-label", "itemprop", "name"):
            for word in NAME.findall(CAMEL.sub(" ", found.get(key, ""))):
                word = word.lower()
                out.add(f"word={word}")
                out.update(f"part={p}" for p in PARTS if len(word) > len(p) and (word.startswith(p) or word.endswith(p)))
        if "hidden" in found or "none" in found.get("style", "").replace(" ", "").partition("display:")[2][:4] or found.get("aria-hidden") == "true":
            out.add("hidden")
    return tuple(sorted(out))


#: Parts of names that sites join others to.
PARTS = ("nav", "menu", "foot", "head", "side", "comment", "advert", "promo", "share", "social", "cookie", "banner", "related", "article", "content", "post", "story", "entry", "body", "text", "widget", "newsletter", "popup", "modal", "notice", "breadcrumb")


def grade(n: int) -> int:
    return min(9, n.bit_length())


def features(nodes: list[Node]) -> list[tuple]:
    """A key of each node; equal keys have equal features."""
    n = len(nodes)
    size, links, runs, long_runs, stops = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    total = 1
    for i in range(n - 1, 0, -1):
        x = nodes[i]
        if x.tag == "#":
            size[i], links[i], runs[i] = len(x.text), x.linked, 1
            long_runs[i] = len(x.text) > 80
            stops[i] = x.text[-1] in ".!?:;\"'…»”"
            total += size[i]
        p = x.parent
        size[p] += size[i]
        links[p] += links[i]
        runs[p] += runs[i]
        long_runs[p] += long_runs[i]
        stops[p] += stops[i]
    out: list[tuple] = []
    for i, x in enumerate(nodes):
        linkage = 0 if not links[i] else 1 + min(3, 4 * links[i] // (size[i] + 1))
        if x.tag == "#":
            parent = nodes[x.parent].tag
            out.append(("#", parent, grade(size[i]), linkage, stops[i]))
        else:
            out.append((x.tag, x.attributes, grade(runs[i]), linkage, min(5, 6 * size[i] // total), grade(long_runs[i]), min(3, 4 * stops[i] // (runs[i] + 1)), min(x.depth, 6)))
    return out


def spelled(key: tuple) -> list[str]:
    """The features that a key stands for."""
    if key[0] == "#":
        _, parent, size, linkage, stop = key
        return ["leaf", f"in={parent}", f"leafsize={size}", f"leaflinks={linkage}", f"leafstop={stop}", f"leaf={parent}/{min(size, 7)}/{linkage}"]
    tag, raw, runs, linkage, share, long_runs, stops, depth = key
    return [*named(tag, raw), f"runs={runs}", f"links={linkage}", f"share={share}", f"long={long_runs}", f"stops={stops}", f"depth={depth}", f"tagshare={tag}/{share}", f"taglinks={tag}/{linkage}"]


# --- the model --------------------------------------------------------------------------------


class Model:
    """weights: per feature the scores of the states; pairs[parent][child]: potentials."""

    def __init__(self, weights: dict[str, tuple[float, ...]], pairs: list[list[float]], root: list[float]) -> None:
        self.weights, self.pairs, self.root = weights, pairs, root
        self.known: dict[tuple, tuple[float, float, float, float]] = {}

    def potential(self, key: tuple) -> tuple[float, float, float, float]:
        found = self.known.get(key)
        if found is None:
            s = [sum(x) for x in zip(*(self.weights.get(f, (0.0,) * STATES) for f in spelled(key)), strict=True)]
            leaf = key[0] == "#"
            top = max(s[NONE], s[ALL]) if leaf else max(s)
            e = [math.exp(x - top) if not leaf or i in (NONE, ALL) else 0.0 for i, x in enumerate(s)]
            found = (e[0], e[1], e[2], e[3])
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[key] = found
        return found

    def marginals(self, nodes: list[Node]) -> list[tuple[float, float, float, float]]:
        """Probabilities of the states of each node, by one pass of messages up and one down."""
        n = len(nodes)
        (p00, p01, p02, p03), (p10, p11, p12, p13), (p20, p21, p22, p23), (p30, p31, p32, p33) = self.pairs
        below = [self.potential(k) for k in features(nodes)]
        up: list[tuple[float, float, float, float]] = [(1.0, 1.0, 1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            a, b, c, d = below[i]
            s = 1.0 / (a + b + c + d)
            a, b, c, d = a * s, b * s, c * s, d * s
            w, x, y, z = up[i] = (p00 * a + p01 * b + p02 * c + p03 * d, p10 * a + p11 * b + p12 * c + p13 * d, p20 * a + p21 * b + p22 * c + p23 * d, p30 * a + p31 * b + p32 * c + p33 * d)
            p = nodes[i].parent
            a, b, c, d = below[p]
            a, b, c, d = a * w, b * x, c * y, d * z
            s = 1.0 / (a + b + c + d)
            below[p] = (a * s, b * s, c * s, d * s)
        out: list[tuple[float, float, float, float]] = [(0.0, 0.0, 0.0, 0.0)] * n
        for i in range(n):
            a, b, c, d = below[i]
            if i:
                # What the parent believes without this child's message, carried over the pair's potentials.
                (w, x, y, z), (q, r, t, u) = out[nodes[i].parent], up[i]
                w, x, y, z = w / q, x / r, y / t, z / u
                a, b, c, d = a * (w * p00 + x * p10 + y * p20 + z * p30), b * (w * p01 + x * p11 + y * p21 + z * p31), c * (w * p02 + x * p12 + y * p22 + z * p32), d * (w * p03 + x * p13 + y * p23 + z * p33)
            else:
                a, b, c, d = a * self.root[0], b * self.root[1], c * self.root[2], d * self.root[3]
            s = 1.0 / (a + b + c + d)
            out[i] = (a * s, b * s, c * s, d * s)
        return out

    def text(self, html: str) -> str:
        nodes = parse(html)
        if len(nodes) == 1:
            return ""
        if all(x.tag == "#" for x in nodes[1:]):  # no blocks: nothing to tell apart
            return "\n".join(x.text for x in nodes[1:])
        beliefs = self.marginals(nodes)
        return "\n".join(x.text for x, m in zip(nodes, beliefs, strict=True) if x.tag == "#" and m[ALL] > m[NONE])


def states(nodes: list[Node]) -> list[int]:
    """The true states, from the marks of the generator; the marks are removed."""
    some, other = [0] * len(nodes), [False] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        x = nodes[i]
        if x.tag == "#":
            some[i] = int(KNOWN in x.text)
            other[i] = not some[i]
            x.text = x.text.replace(KNOWN, "")
            x.linked = min(x.linked, len(x.text))
        if x.parent >= 0:
            some[x.parent] += some[i]
            other[x.parent] |= other[i]
    article = max((i for i in range(len(nodes)) if some[i] == some[0]), default=0)  # the innermost that holds all content
    out, inside = [], set()
    for i, x in enumerate(nodes):
        if i == article or x.parent in inside:
            inside.add(i)
        out.append(NONE if not some[i] else ALL if not other[i] else WITHIN if i in inside else AROUND)
    return out


def train(pages: list[str], rounds: int = 250) -> Model:
    """Fits a model to pages whose content is marked."""
    index: dict[str, int] = {}
    rows, labels = [], []
    pairs, root = np.full((STATES, STATES), 0.05), np.full(STATES, 0.5)
    for html in pages:
        nodes = parse(html)
        truth = states(nodes)
        for x, t, key in zip(nodes, truth, features(nodes), strict=True):
            rows.append([index.setdefault(f, len(index)) for f in spelled(key)])
            labels.append(t)
            if x.parent >= 0:
                pairs[truth[x.parent], t] += 1
            else:
                root[t] += 1
    y = np.array(labels)
    share = np.bincount(y, minlength=STATES) / len(y)
    flat = np.concatenate([np.array(r) for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    hot = np.eye(STATES)[y]
    w, speed = np.zeros((len(index), STATES)), np.full((len(index), STATES), 1e-3)
    often = np.bincount(flat, minlength=len(index))
    for _ in range(rounds):
        s = np.stack([np.bincount(owner, w[flat, k], len(rows)) for k in range(STATES)], 1)
        e = np.exp(s - s.max(1, keepdims=True))
        d = (e / e.sum(1, keepdims=True) - hot)[owner]
        g = np.stack([np.bincount(flat, d[:, k], len(index)) for k in range(STATES)], 1) + 0.5 * w
        speed += g * g
        w -= 0.5 * g / np.sqrt(speed)
    # A node's potential is its likelihood: the prior of its state is in the pairs, so it is divided out, once a node.
    w = np.where(often[:, None] > 0, w, 0.0)
    prior = np.log(np.maximum(share, 1e-6))
    for f, i in index.items():
        if f == "leaf" or f.startswith("depth="):
            w[i] -= prior
    pairs = pairs / pairs.sum(1, keepdims=True)
    return Model({f: tuple(w[i].tolist()) for f, i in index.items()}, pairs.tolist(), (root / root.sum()).tolist())


# --- labelled pages ---------------------------------------------------------------------------


class Pages:
    """Writes pages whose content is marked. Words are random; what tells are structure and names."""

    def __init__(self, seed: int) -> None:
        self.r, self.made = random.Random(seed), 0

    def words(self, lo: int, hi: int, stop: bool = True) -> str:
        n = self.r.randint(lo, hi)
        text = " ".join("".join(self.r.choices("aeinorst", k=self.r.randint(1, 8))) for _ in range(n))
        return text.capitalize() + (self.r.choice([".", ".", ".", "?", "", " |", ","]) if stop else "")

    def pick(self, *options: str) -> str:
        return self.r.choice(options)

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/x">{self.words(1, 3, False)}</a>{self.pick("</li>", "</li>", "")}' for _ in range(n))

    def named(self, tag: str, *names: str) -> str:
        """An opening tag that mostly tells its role."""
        name = self.r.choice(names)
        form = self.r.random()
        if form < 0.55:
            return f'<{tag} class="{name}{self.pick("", "", " wide", "-inner", "-1")}">'
        if form < 0.75:
            return f'<{tag} id="{name}">'
        if form < 0.85:
            return f'<{tag} class="c{self.r.randint(1, 99)} {name}">'
        return f'<{tag} class="x{self.r.randint(1, 99)}">'

    def menu(self) -> str:
        n = self.r.randint(2, 12)
        return self.pick(
            f"<nav><ul>{self.links(n)}</ul></nav>",
            f"<nav>{self.named('ul', 'menu', 'nav', 'navbar')}{self.links(n)}</ul></nav>",
            f"{self.named('div', 'menu', 'navigation', 'navbar', 'topnav', 'breadcrumbs')}<ul>{self.links(n)}</ul></div>",
            f'<div role="navigation">{"".join(f"<a href=/>{self.words(1, 2, False)}</a> " for _ in range(n))}</div>',
            f"{self.named('ol', 'breadcrumb')}{self.links(3)}</ol>",
        )

    def header(self) -> str:
        inner = self.pick(f'<div class="logo"><a href="/">{self.words(1, 3, False)}</a></div>', f"<p>{self.words(2, 8)}</p>", f"<h1>{self.words(1, 3, False)}</h1>", f"{self.words(2, 6)}")
        return self.pick(f"<header>{inner}{self.menu()}</header>", f"<header>{inner}</header>", f"{self.named('div', 'header', 'masthead', 'site-header', 'top', 'banner')}{inner}{self.menu()}</div>", self.menu())

    def footer(self) -> str:
        inner = self.pick(f"&copy; {self.words(2, 20)}", f"<p>{self.words(3, 40)}</p>{self.menu()}", f"<p>&copy; {self.words(1, 5)}</p><p>{self.words(3, 30)}</p>", f"<ul>{self.links(5)}</ul>")
        return self.pick(f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f"{self.named('div', 'footer', 'site-footer', 'copyright', 'legal', 'bottom')}{inner}</div>")

    def sidebar(self) -> str:
        inner = "".join(self.pick(f"<h3>{self.words(1, 4, False)}</h3><ul>{self.links(4)}</ul>", f"<p>{self.words(4, 40)}</p>", self.advert(), self.form()) for _ in range(self.r.randint(1, 3)))
        return self.pick(f"<aside>{inner}</aside>", f"{self.named('aside', 'sidebar', 'related', 'widget')}{inner}</aside>", f"{self.named('div', 'sidebar', 'side', 'widget', 'related', 'recommended', 'promo', 'popular')}{inner}</div>", f'<div role="complementary">{inner}</div>')

    def notice(self) -> str:
        inner = self.pick(f"<p>{self.words(5, 40)}</p>", self.words(4, 25), f"<p>{self.words(5, 20)}</p><button>ok</button>", f"{self.words(5, 20)} <a href=/>{self.words(1, 3)}</a>")
        return self.pick(f"{self.named('div', 'cookie-banner', 'cookie', 'consent', 'notice', 'alert', 'gdpr', 'popup', 'modal', 'overlay', 'paywall', 'message', 'disclaimer')}{inner}</div>", f'<div role="{self.pick("alert", "dialog", "status", "banner")}">{inner}</div>', f"{self.named('section', 'notice', 'cookies', 'cookie-notice')}{inner}</section>", f"{self.named('p', 'notice', 'alert', 'cookie')}{self.words(4, 30)}</p>", f"<dialog>{inner}</dialog>")

    def advert(self) -> str:
        inner = self.pick(self.words(2, 30), f"<p>{self.words(2, 30)}</p>", f"<a href=/>{self.words(2, 12)}</a>", f"<h4>{self.words(1, 6)}</h4><p>{self.words(3, 25)}</p>")
        return self.pick(f"{self.named('div', 'ad', 'ads', 'advert', 'advertisement', 'sponsored', 'sponsor', 'promo', 'adbox', 'banner-ad')}{inner}</div>", f"{self.named('aside', 'ad', 'advert', 'promo')}{inner}</aside>", f'<div class="ad">{inner}</div>', f"{self.named('section', 'sponsored', 'ads', 'promotion')}{inner}</section>", f"<ins class=adsby>{inner}</ins>" if "<" not in inner else f'<div id="ad-{self.r.randint(1, 9)}">{inner}</div>')

    def form(self) -> str:
        inner = self.pick(f"<label>{self.words(1, 4)}</label><input>", f"<p>{self.words(3, 20)}</p><input><button>go</button>", f"<fieldset><legend>{self.words(1, 3)}</legend><label>{self.words(1, 3)}</label></fieldset>", f"{self.words(2, 10)} <select><option>a<option>b</select>")
        return self.pick(f"<form>{inner}</form>", f"{self.named('form', 'newsletter', 'search', 'subscribe', 'login', 'comment-form')}{inner}</form>", f"{self.named('div', 'newsletter', 'subscribe', 'signup', 'search')}<form>{inner}</form></div>")

    def comments(self) -> str:
        one = lambda: self.pick(f"<p>{self.words(3, 60)}</p>", f"<h4>{self.words(1, 2, False)}</h4><p>{self.words(3, 60)}</p>", f"<div class=author>{self.words(1, 2)}</div><p>{self.words(3, 40)}</p><p>{self.words(3, 40)}</p>", f"<article><p>{self.words(3, 50)}</p></article>")
        n = self.r.randint(1, 5)
        head = self.pick("", f"<h3>{self.words(1, 3, False)}</h3>", f"<h2>{self.words(1, 3, False)}</h2>")
        return self.pick(
            f"{self.named('section', 'comments', 'discussion', 'responses', 'replies', 'comment-list')}{head}{''.join(f'<div class=comment>{one()}</div>' for _ in range(n))}</section>",
            f"{self.named('div', 'comments', 'disqus', 'thread', 'comment-section', 'replies', 'reader-comments', 'user-comments')}{head}{''.join(one() for _ in range(n))}{self.pick('', self.form())}</div>",
            f"{self.named('ol', 'comments', 'commentlist', 'comment-list')}{''.join(f'<li class=comment>{one()}</li>' for _ in range(n))}</ol>",
            f'<div id="comments">{head}{"".join(one() for _ in range(n))}</div>',
        )

    def share(self) -> str:
        return self.pick(f"{self.named('div', 'share', 'social', 'tags', 'byline', 'meta', 'author-box', 'related', 'pagination')}{self.words(1, 6)} <a href=/>{self.words(1, 2)}</a></div>", f"{self.named('ul', 'share', 'social', 'tags')}{self.links(3)}</ul>")

    def content(self) -> str:
        """Blocks of an article, each marked; now and then with an intruder between them."""
        out = []
        if self.r.random() < 0.85:
            h = f"<h1>{KNOWN}{self.words(1, 12, False)}</h1>"
            out.append(self.pick(h, h, h, f"<header>{h}</header>", f"<header>{h}<p>{KNOWN}{self.words(5, 25)}</p></header>"))
        for _ in range(self.r.choice([1, 1, 2, 3, 4, 6, 9, 15, 25])):
            kind = self.r.random()
            text = f"{KNOWN}{self.words(*self.r.choice([(1, 2), (1, 8), (5, 40), (20, 120), (60, 200)]))}"
            if kind < 0.62:
                out.append(self.pick(f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<p>{text} <a href=/>{self.words(1, 4)}</a> {self.words(1, 20)}</p>", f"<div>{text}</div>", f"<p>{text}<br>{self.words(1, 9)}</p>", f"<p><em>{text}</em></p>", f"<p><a href=/>{text}</a></p>"))
            elif kind < 0.72:
                out.append(f"<h{self.r.randint(2, 4)}>{KNOWN}{self.words(1, 8, False)}</h{self.r.randint(2, 4)}>")
            elif kind < 0.80:
                items = "".join(f"<li>{KNOWN}{self.words(1, 20)}{self.pick('</li>', '')}" for _ in range(self.r.randint(1, 6)))
                out.append(self.pick(f"<ul>{items}</ul>", f"<ol>{items}</ol>"))
            elif kind < 0.84:
                out.append(f"<blockquote>{self.pick(f'<p>{text}</p>', text)}</blockquote>")
            elif kind < 0.87:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{KNOWN}{self.words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(self.r.randint(1, 4))) + "</table>")
            elif kind < 0.90:
                out.append(self.pick(f"<pre>{text}</pre>", f"<figure><img src=x><figcaption>{text}</figcaption></figure>", f"<section><h2>{KNOWN}{self.words(1, 5)}</h2><p>{text}</p></section>", f"<dl><dt>{KNOWN}{self.words(1, 3)}<dd>{text}</dl>"))
            else:
                out.append(self.pick(self.advert(), self.advert(), self.sidebar(), self.share(), self.form(), self.notice()))
        return "".join(out)

    def page(self) -> str:
        body = self.content()
        names = ("content", "article", "post", "entry", "main", "story", "post-content", "article-body", "entry-content", "text", "body")
        if self.r.random() < 0.25:
            body += self.pick(self.comments(), self.share(), self.sidebar())
        main = self.pick(f"<article>{body}</article>", f"<article>{body}</article>", f"<main>{body}</main>", f"<main><article>{body}</article></main>", f"{self.named('div', *names)}{body}</div>", f"{self.named('section', *names)}{body}</section>", f"{self.named('article', *names)}{body}</article>", f"<div><div>{body}</div></div>", f'<div itemprop="articleBody">{body}</div>', f'<div role="main">{body}</div>', f"<table><tr><td>{self.menu()}</td><td>{body}</td></tr></table>")
        before = "".join(self.pick(self.header(), self.menu(), self.notice(), self.advert(), self.form(), self.sidebar()) for _ in range(self.r.randint(0, 4)))
        after = "".join(self.pick(self.comments(), self.sidebar(), self.advert(), self.notice(), self.share(), self.form(), self.footer()) for _ in range(self.r.randint(0, 3))) + (self.footer() if self.r.random() < 0.8 else "")
        if self.r.random() < 0.3:
            main = f"{self.named('div', 'wrapper', 'container', 'page', 'layout', 'row')}{main}{self.pick('', self.sidebar())}</div>"
        head = f"<head><title>{self.words(2, 9)}</title><style>p{{}}</style>"
        # Both tags are optional; a page without them has the same tree, whatever comes first.
        head += ("</head><body>", "</head><body>", "<body>", "</head>", "")[self.made % 5]
        self.made += 1
        return f"<!DOCTYPE html><html>{head}{before}{main}{after}" + self.pick("</body></html>", "</body></html>", "")


def fitted() -> Model:
    """The model fitted from scratch: 12 seconds or so on one core."""
    pages = Pages(SEED)
    return train([pages.page() for _ in range(PAGES)])


@lru_cache(maxsize=1)
def trained() -> Model:
    """The model as `python -m parchmill.llm.extraction` has fitted and written it; a test holds the file against a new fit."""
    told = json.loads(FITTED.read_text())
    return Model({f: tuple(w) for f, w in told["weights"].items()}, told["pairs"], told["root"])


def write_fitted() -> None:
    made = fitted()
    rounded = {f: [round(x, 5) for x in w] for f, w in sorted(made.weights.items())}
    told = {"weights": rounded, "pairs": [[round(x, 8) for x in row] for row in made.pairs], "root": [round(x, 8) for x in made.root]}
    FITTED.write_text(json.dumps(told, separators=(",", ":")).replace("],", "],\n"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html)."""
    sent = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                text = [sent.value.text(x.as_py() or "") for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


if __name__ == "__main__":
    write_fitted()
