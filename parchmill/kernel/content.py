"""Runs a page's content: from its bytes to the strings it shows, each with its place on the page."""

from __future__ import annotations

import re
from binascii import unhexlify
from itertools import islice
from math import hypot
from typing import Any, NamedTuple

from parchmill.kernel.fonts import Font, Fonts
from parchmill.kernel.objects import Pdf, Stream, unescaped, unhexed


class Run(NamedTuple):
    """A shown string. (ux, uy): its direction; advance: its length in text space, of which a unit is `hlen` on the page."""

    text: str
    drawn: str
    x: float
    y: float
    ux: float
    uy: float
    size: float
    advance: float
    hlen: float
    glyphs: int
    letter: float  # a letter's width on the page, by the font alone
    may_turn: bool  # set in a font that may have right-to-left letters
    source: str


_STRING = rb"\((?:[^()\\]++|\\.)*+\)"
for _ in range(3):
    _STRING = rb"\((?:[^()\\]++|\\.|" + _STRING + rb")*+\)"
_NUMBER = rb"[+-]?(?:\d++\.?\d*+|\.\d++)"
#: After white space, a drawing operator with its numbers, which nobody looks at, or Tm with some; else a string, hex string, name,
#: number, word, array of nothing but whole bytes in hex and numbers, or bracket.
TOKEN = re.compile(
    rb"\s*+(?:(?:(?<![^\s\])>])" + _NUMBER + rb"\s++){1,6}+(?:(?:re|rg|RG|scn?|SCN?|[mlcvyhfFSsBbnWgGkKwjJdMi])\*?(?=[\s\[(/<%]|\Z)|Tm(?![A-Za-z0-9*])())"
    rb"|(" + _STRING + rb")|<([0-9A-Fa-f\s]*+)>|<<|>>|/([^\s/\[\]()<>{}%]*+)|(" + _NUMBER + rb")(?![A-Za-z])|([A-Za-z'\"][A-Za-z0-9]*\*?)"
    rb"|\[((?:\s*+(?:<(?:[0-9A-Fa-f]{2})*+>|" + _NUMBER + rb"(?![A-Za-z])))*+)\s*+\]|([\[\]])|%[^\r\n]*+|.|\Z)",
    re.S,
)
#: The bytes and numbers of such an array.
ELEMENT = re.compile(rb"<([^>]*+)>|(" + _NUMBER + rb")")
#: The BI of an inline image; strings and comments, which may say so, are matched before it.
INLINE = re.compile(_STRING + rb"|%[^\r\n]*+|(?<![A-Za-z0-9])(BI)[\s/]", re.S)
INLINE_ID, INLINE_EI = re.compile(rb"\sID\s"), re.compile(rb"\sEI(?![A-Za-z0-9])")
#: Operands kept, and graphics states.
MOST_OPERANDS, MOST_STATES = 8192, 4097
UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


class Hexed(list):
    """An array's elements as pairs: hex digits, or a number."""


class TooMuch(Exception):
    """The page shows more text than may be kept."""


def times(m: tuple, n: tuple) -> tuple:
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return (a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


def tokens(m: re.Match) -> int:
    """Of a match of TOKEN: strings, names, numbers, words and brackets in it."""
    if m.lastindex == 1:
        return len(m[0].split())
    return 2 + sum(1 for _ in ELEMENT.finditer(m[7])) if m.lastindex == 7 else int(m.lastindex is not None)


def without_images(data: bytes) -> bytes:
    """The content without inline images; a BI without its ID ends the search for them."""
    out, at, kept = [], 0, 0
    while (m := INLINE.search(data, at)) is not None:
        if not m[1]:
            at = m.end()
            continue
        begun = INLINE_ID.search(data, m.start())
        if begun is None:
            break
        end = INLINE_EI.search(data, begun.end() - 1)
        out += [data[kept : m.start()], b" "]
        at = kept = end.end() if end else len(data)
    return b"".join([*out, data[kept:]])


class Page:
    """Collects the runs of one page."""

    def __init__(self, pdf: Pdf, fonts: Fonts, word_gap: float = 0.11, most_forms: int = 20_000, most_form_bytes: int = 64 << 20) -> None:
        self.pdf, self.fonts, self.word_gap = pdf, fonts, word_gap
        self.runs: list[Run] = []
        self.room = pdf.limit // 2
        self.forms, self.form_bytes = most_forms, most_form_bytes
        self.source = "page"
        #: The axes and the size of the last string, and what follows from them.
        self.shape: tuple = ()
        self.turn = (1.0, 0.0, 1.0, 0.0)
        self.start(UNIT)

    def start(self, matrix: tuple) -> None:
        self.ctm = matrix
        self.text = self.line = UNIT
        self.font: Font | None = None
        self.size = self.char = self.word = self.leading = 0.0
        self.stretch = 1.0

    def show(self, s: bytes) -> None:
        font = self.font
        if font is None or not s:
            return
        text, width, n, spaces, drawn = font.decode(s)
        advance = (width * self.size + n * self.char + spaces * self.word) * self.stretch
        a, b, c, d, e, f = self.text
        if text:
            self.room -= len(text.encode("utf-8", "surrogatepass")) if not text.isascii() else len(text)
            if self.room < 0:
                raise TooMuch
            p, q, r, s, t, u = self.ctm
            shape = (a, b, c, d, p, q, r, s, self.size)
            if shape != self.shape:
                self.shape, (ma, mb, mc, md, _, _) = shape, times(self.text, self.ctm)
                hlen = hypot(ma, mb)
                ux, uy = (ma / hlen, mb / hlen) if hlen >= 1e-9 else (1.0, 0.0)
                hlen = hlen if hlen >= 1e-9 else 1.0
                size = abs(self.size) * hypot(mc, md)
                self.turn = ux, uy, hlen, size if size >= 1e-6 else abs(self.size) * hlen
            x, y = e * p + f * r + t, e * q + f * s + u
            ux, uy, hlen, size = self.turn
            letter = abs(width * self.size * self.stretch) * hlen / (n or 1)
            self.runs.append(Run(text, drawn, x, y, ux, uy, size, advance, hlen, n, letter, font.rtl, self.source))
        self.text = (a, b, c, d, e + advance * a, f + advance * b)

    def move(self, distance: float) -> None:
        a, b, c, d, e, f = self.text
        self.text = (a, b, c, d, e + distance * a, f + distance * b)

    def step(self, tx: float, ty: float) -> None:
        a, b, c, d, e, f = self.line
        self.text = self.line = (a, b, c, d, e + tx * a + ty * c, f + tx * b + ty * d)

    def show_kerned(self, items: list) -> None:
        """Strings with adjustments between; small ones are part of a word, so its pieces are shown as one."""
        held, kern = b"", 0.0
        for item in items:
            if isinstance(item, bytes):
                held += item
            elif isinstance(item, float):
                if held and -900.0 * self.word_gap < item <= 200.0:
                    kern += item
                    continue
                self.show(held)
                self.move(-(item + kern) * 0.001 * self.size * self.stretch)
                held, kern = b"", 0.0
        self.show(held)
        if kern:
            self.move(-kern * 0.001 * self.size * self.stretch)

    def show_hexed(self, pairs: list[tuple[bytes, bytes]]) -> None:
        """The same of pairs of hex digits or a number; the digits of what is shown as one are read at once."""
        held, kern, least = b"", 0.0, -900.0 * self.word_gap
        for digits, told in pairs:
            if not told:
                held += digits
                continue
            item = float(told)
            if held and least < item <= 200.0:
                kern += item
                continue
            if held:
                self.show(unhexlify(held))
            self.move(-(item + kern) * 0.001 * self.size * self.stretch)
            held, kern = b"", 0.0
        if held:
            self.show(unhexlify(held))
        if kern:
            self.move(-kern * 0.001 * self.size * self.stretch)

    def execute(self, data: bytes, resources: dict, depth: int = 0, active: frozenset[int] = frozenset()) -> None:
        if b"ID" in data:
            data = without_images(data)
        if len(data) > 1 << 20 and 80 * sum(map(tokens, TOKEN.finditer(data))) > self.pdf.budget:
            self.pdf.warn("A content stream holds more tokens than memoryBudget allows for; nothing of it is shown")
            return
        fonts: dict[str, Font | None] = {}
        stack: list[Any] = []
        array: list | None = None
        saved: list[tuple] = []
        for m in TOKEN.finditer(data):
            kind = m.lastindex
            if array is not None and (kind == 3 or kind == 5):  # most of what there is in arrays
                if len(array) < MOST_OPERANDS:
                    array.append(unhexed(m[3]) if kind == 3 else float(m[5]))
                continue
            if kind is None:
                word = m[0].lstrip()
                if len(word) > 1 and word[:1] not in b"<>%":
                    stack = []
                continue
            if kind == 1:
                told = [float(x) for x in m[0][:-2].split()]
                if array is not None:
                    array += told[: MOST_OPERANDS - len(array)]
                    continue
                numbers = told if len(told) == 6 else [x for x in [*stack, *told][-8:] if isinstance(x, float)]
                if len(numbers) >= 6:
                    self.text = self.line = tuple(numbers[-6:])
                stack = []
                continue
            if kind == 6:
                if array is not None:
                    continue
                op = m[6]
                last = stack[-1] if stack else None
                if op == b"Tj":
                    if isinstance(last, bytes):
                        self.show(last)
                    stack = []
                    continue
                if op == b"TJ":
                    if isinstance(last, Hexed):
                        self.show_hexed(last)
                    elif isinstance(last, list):
                        self.show_kerned(last)
                    stack = []
                    continue
                numbers = [x for x in stack[-8:] if isinstance(x, float)]
                if op in (b"Td", b"TD"):
                    if len(numbers) >= 2:
                        self.leading = -numbers[-1] if op == b"TD" else self.leading
                        self.step(numbers[-2], numbers[-1])
                elif op == b"Tm":
                    if len(numbers) >= 6:
                        self.text = self.line = tuple(numbers[-6:])
                elif op in (b"T*", b"'", b'"'):
                    if op == b'"' and len(numbers) >= 2:
                        self.word, self.char = numbers[-2:]
                    self.step(0.0, -self.leading)
                    if op != b"T*" and isinstance(last, bytes):
                        self.show(last)
                elif op == b"Tf":
                    if len(stack) >= 2 and isinstance(stack[-2], str):
                        self.size = numbers[-1] if numbers else 0.0
                        name = stack[-2]
                        if name not in fonts:
                            known = self.pdf.dict(resources.get("Font")) or {}
                            fonts[name] = self.fonts.load(known[name]) if name in known else None
                        self.font = fonts[name]
                elif op == b"BT":
                    self.text = self.line = UNIT
                elif op == b"Tc":
                    self.char = numbers[-1] if numbers else 0.0
                elif op == b"Tw":
                    self.word = numbers[-1] if numbers else 0.0
                elif op == b"Tz":
                    self.stretch = numbers[-1] / 100 if numbers else 1.0 if not stack else 0.0
                elif op == b"TL":
                    self.leading = numbers[-1] if numbers else 0.0
                elif op == b"cm":
                    if len(numbers) >= 6:
                        self.ctm = times(tuple(numbers[-6:]), self.ctm)
                elif op == b"q":
                    if len(saved) < MOST_STATES:
                        saved.append((self.ctm, self.font, self.size, self.char, self.word, self.stretch, self.leading))
                elif op == b"Q":
                    if saved:
                        self.ctm, self.font, self.size, self.char, self.word, self.stretch, self.leading = saved.pop()
                elif op == b"Do":
                    if isinstance(last, str) and depth < 12:
                        self.form(last, resources, depth, active)
                stack = []
                continue
            if kind == 7:
                if len(m[7]) < 1 << 16:
                    stack.append(Hexed(ELEMENT.findall(m[7])[:MOST_OPERANDS]))
                else:
                    stack.append(Hexed(x.groups(b"") for x in islice(ELEMENT.finditer(m[7]), MOST_OPERANDS)))
                array = None
                continue
            if kind == 8:
                if m[8] == b"[":
                    array = []
                else:
                    stack.append(array if array is not None else [])
                    array = None
                continue
            if kind == 2:
                value: Any = unescaped(m[2][1:-1])
            elif kind == 3:
                value = unhexed(m[3])
            elif kind == 4:
                value = m[4].decode("utf-8", "surrogateescape")
                if "#" in value:
                    value = re.sub("#([0-9A-Fa-f]{2})", lambda x: chr(int(x[1], 16)), value)
            else:
                value = float(m[5])
            into = array if array is not None else stack
            if len(into) < MOST_OPERANDS:
                into.append(value)
            elif array is None:
                stack = [*stack[-16:], value]

    def allowed(self) -> bool:
        if self.forms <= 0 or self.form_bytes <= 0:
            self.pdf.warn("Forms past the ceiling of one page aren't drawn")
            return False
        self.forms -= 1
        return True

    def form(self, name: str, resources: dict, depth: int, active: frozenset[int]) -> None:
        s = self.pdf.resolve((self.pdf.dict(resources.get("XObject")) or {}).get(name))
        if not isinstance(s, Stream) or s.dict.get("Subtype") != "Form" or s.num in active or not self.allowed():
            return
        data = self.pdf.stream_data(s)
        if not data:
            return
        self.form_bytes -= len(data)
        kept = (self.ctm, self.text, self.line, self.font, self.size, self.char, self.word, self.stretch, self.leading)
        self.ctm = times(self.matrix(s), self.ctm)
        self.execute(data, self.pdf.dict(s.dict.get("Resources")) or resources, depth + 1, active | {s.num})
        self.ctm, self.text, self.line, self.font, self.size, self.char, self.word, self.stretch, self.leading = kept

    def matrix(self, s: Stream) -> tuple:
        m = self.pdf.resolve(s.dict.get("Matrix"))
        values = [self.pdf.resolve(x) for x in m[:6]] if isinstance(m, list) and len(m) >= 6 else []
        return tuple(map(float, values)) if len(values) == 6 and all(isinstance(x, (int, float)) for x in values) else UNIT

    def annotation(self, s: Stream, x: float, y: float, resources: dict) -> None:
        if not self.allowed():
            return
        data = self.pdf.stream_data(s)
        if data:
            self.form_bytes -= len(data)
            size, leading = self.size, self.leading
            self.start(times(self.matrix(s), (1.0, 0.0, 0.0, 1.0, x, y)))
            self.size, self.leading = size, leading
            self.source = f"annotation {s.num}"
            self.execute(data, self.pdf.dict(s.dict.get("Resources")) or resources, 1, frozenset([s.num]))
