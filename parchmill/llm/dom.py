"""A tolerant reader of HTML: the tree of its blocks, with the text runs between block borders as leaves."""

from __future__ import annotations

import re
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Elements whose content is no markup, and those whose content is never text of a page.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
UNSEEN = frozenset("head template svg annotation annotation-xml select button object audio video canvas noscript datalist".split())
#: Tags that leave a head open, besides those with content of their own.
IN_HEAD = frozenset("base basefont bgsound link meta head html".split())
#: Fixed values of the HTML standard's tree rules: what an opening tag closes, and how far up it looks.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
CELLS = frozenset("td th caption button".split())

TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"  # comment
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    """An element, or a leaf with text. parent: place in the list of nodes."""

    __slots__ = ("tag", "attributes", "parent", "text", "linked", "depth")

    def __init__(self, tag: str, attributes: str, parent: int, depth: int) -> None:
        self.tag, self.attributes, self.parent, self.depth = tag, attributes, parent, depth
        self.text, self.linked = "", 0


def parse(html: str) -> list[Node]:
    """Nodes in page order, each after its parent; the first is the root. Leaves have the tag '#'.
    An html element whose body tag is left out has a body all the same."""
    nodes = [Node("#root", "", -1, 0)]
    stack = [(0, "#root")]  # open blocks
    held: list[str] = []  # text since the last border
    linked = 0
    links = 0  # open <a>
    at, n = 0, len(html)
    bodied = False

    def imply_body() -> None:
        nonlocal bodied
        if stack[-1][1] == "html" and not bodied:
            bodied = True
            nodes.append(Node("body", "", stack[-1][0], len(stack)))
            stack.append((len(nodes) - 1, "body"))

    def flush() -> None:
        nonlocal held, linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                imply_body()
                leaf = Node("#", "", stack[-1][0], len(stack))
                leaf.text, leaf.linked = text, min(linked, len(text))
                nodes.append(leaf)
            held = []
        linked = 0

    def close(depth: int) -> None:
        flush()
        del stack[depth:]

    while at < n:
        m = TAG.search(html, at)
        end = m.start() if m else n
        if end > at:
            text = html[at:end]
            if "&" in text:
                text = unescape(text)
            held.append(text)
            if links:
                linked += len(text)
        if m is None:
            break
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name = name.lower()
        if m[1] or m[4]:
            if name in BLOCK:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][1] == name:
                        close(i)
                        break
                else:
                    flush()
                links = 0
            elif name == "a":
                links = 0
            continue
        if name in RAW or name in UNSEEN:
            if name in RAW:
                found = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = found.end() if found else n
            else:
                at = _after_head(html, at) if name == "head" else _after(html, at, name)
            continue
        if name == "br" or name == "wbr":
            if name == "br":
                held.append(" ")
            continue
        if name == "a":
            links = 1
            continue
        if name not in BLOCK:
            continue
        flush()
        links = 0
        if name == "body":
            if bodied:
                continue
            bodied = True
        elif name not in ("html", "frameset"):
            imply_body()
        rule = CLOSES.get(name)
        if rule:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][1] in rule[1]:
                    break
                if stack[i][1] in rule[0]:
                    close(i)
                    if name in ("li", "dt", "dd"):
                        break
        else:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][1] == "p":
                    close(i)
                    break
                if stack[i][1] in CELLS or stack[i][1] not in ("h1", "h2", "h3", "h4", "h5", "h6"):
                    break
        if name in VOID:
            continue
        nodes.append(Node(name, (m[3] or m[6] or "").strip(), stack[-1][0], len(stack)))
        stack.append((len(nodes) - 1, name))
    flush()
    return nodes


def _after_head(html: str, at: int) -> int:
    """The end of a head that begins before `at`: its closing tag, or the first tag or text that can't be in a head."""
    while m := TAG.search(html, at):
        if html[at : m.start()].strip():
            return at
        name = (m[2] or m[5] or "").lower()
        if m[1] or m[4]:
            if name == "head":
                return m.end()
            if name in ("body", "html", "br"):
                return m.start()
        elif name in ("script", "style", "title", "noframes"):
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, m.end())
            at = close.end() if close else len(html)
            continue
        elif name in ("noscript", "template"):
            at = _after(html, m.end(), name)
            continue
        elif name and name not in IN_HEAD:
            return m.start()
        at = m.end()
    return at


def _after(html: str, at: int, name: str) -> int:
    """The end of an unseen element that begins before `at`: its closing tag at its own level, or, for one never closed, the next block."""
    depth = 1
    for m in re.compile(rf"<(/?){name}(?=[\s/>])[^>]*>|<body(?=[\s/>])", re.I).finditer(html, at):
        if m[1] is None:
            return m.start()
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    return at


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}
