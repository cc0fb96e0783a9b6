"""A whole file: its pages, its metadata, and what went wrong. Nothing here raises for a bad file."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from parchmill.kernel import collections, glyphs
from parchmill.kernel.content import Page, Run, TooMuch
from parchmill.kernel.crypto import Locked
from parchmill.kernel.fonts import Fonts
from parchmill.kernel.layout import page_text
from parchmill.kernel.objects import NotPdf, Pdf, Stream

BROKEN = (ValueError, TypeError, IndexError, KeyError, AttributeError, OverflowError, RecursionError, MemoryError, ZeroDivisionError, ArithmeticError)


@dataclass(frozen=True)
class Options:
    password: str = ""
    dehyphenate: bool = True
    expand_ligatures: bool = True
    annotations: bool = True
    word_gap: float = 0.11
    memory_budget: int = 256 << 20
    glyph_list: str | None = None
    cid_tables: str | None = None


@dataclass
class Result:
    status: str
    page_count: int = 0
    encrypted: bool = False
    info: dict[str, str] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st", "\u00ad": "", "\u00a0": " ", "\u2009": " ", "\u200b": ""}
LIGATURE = re.compile(f"[{''.join(LIGATURES)}]")
#: What trimming takes off both ends.
EDGES = " \n\r\t\v\0"


def clean(text: str, ligatures: bool = True) -> str:
    if not text.isascii():
        text = text.encode("utf-8", "ignore").decode()  # halves of pairs aren't text
    if ligatures:
        text = LIGATURE.sub(lambda m: LIGATURES[m[0]], text)
    text = re.sub(r"[\x00-\x09\x0b-\x1f\x7f]", " ", text)
    if "  " in text:
        text = re.sub(r" {2,}", " ", text)
    if " \n" in text or "\n " in text:
        text = re.sub(r" *\n *", "\n", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip(EDGES)


def text_string(data: bytes) -> str:
    """A string of the document's own data: UTF-16, UTF-8, or the document encoding."""
    if data[:2] == b"\xfe\xff":
        return data[2 : 2 + (len(data) - 2 & ~1)].decode("utf-16-be", "ignore")
    if data[:3] == b"\xef\xbb\xbf":
        return data[3:].decode("utf-8", "ignore")
    table = glyphs.encoding("PDFDocEncoding")
    return "".join(table[b] for b in data)


class Document:
    """An opened file; raises NotPdf or Locked."""

    def __init__(self, data: bytes, options: Options) -> None:
        self.options = options
        self.pdf = Pdf(data, options.password, options.memory_budget)
        tables = options.cid_tables
        self.fonts = Fonts(self.pdf, options.glyph_list, (lambda ordering: collections.loaded(tables, ordering)) if tables else None)

    def root(self) -> dict:
        return self.pdf.dict(self.pdf.trailer.get("Root")) or {}

    def walk(self) -> Iterator[tuple[dict, dict]]:
        """(page, resources) in document order; of a file without a page tree, every page object by number."""
        pdf, found, seen = self.pdf, False, set()
        todo: list[tuple[Any, dict]] = [(self.root().get("Pages"), {})]
        while todo:
            ref, above = todo.pop()
            key = ref if isinstance(ref, tuple) and not isinstance(ref, Stream) else None
            if key is not None and key in seen:
                continue
            seen.add(key)
            node = pdf.dict(ref)
            if not node:
                continue
            own = pdf.dict(node.get("Resources"))
            resources = above if own is None else own
            kids = pdf.resolve(node.get("Kids"))
            if isinstance(kids, list) and node.get("Type") != "Page":
                todo += [(k, resources) for k in reversed(kids)]
            elif node.get("Type") == "Page" or "Contents" in node or isinstance(kids, list):
                found = True
                yield node, resources
        if not found:
            for num in pdf.objects_named("Page"):
                node = pdf.get(num)
                yield node, pdf.dict(node.get("Resources")) or {}

    def content(self, page: dict) -> bytes:
        pdf = self.pdf
        parts = pdf.resolve(page.get("Contents"))
        parts = parts if isinstance(parts, list) else [parts]
        out, room = [], pdf.limit
        for s in map(pdf.resolve, parts):
            if not isinstance(s, Stream):
                continue
            if room <= 0:
                pdf.warn("Content past half of memoryBudget is cut off")
                break
            data = pdf.stream_data(s) or b""
            if len(data) > room:
                pdf.warn("Content past half of memoryBudget is cut off")
            out.append(data[:room])
            room -= len(data)
        return b"\n".join(out)

    def appearances(self, page: dict) -> Iterator[tuple[Stream, float, float]]:
        """Streams of annotations that show, with the corner each stands at."""
        pdf = self.pdf
        for ref in pdf.resolve(page.get("Annots")) or []:
            a = pdf.dict(ref)
            if not a or a.get("Subtype") in ("Link", "Popup"):
                continue
            flags = pdf.resolve(a.get("F"))
            if isinstance(flags, int) and flags & 0x22:
                continue
            normal = pdf.resolve((pdf.dict(a.get("AP")) or {}).get("N"))
            if isinstance(normal, dict):
                state = pdf.resolve(a.get("AS"))
                normal = pdf.resolve(normal.get(state)) if isinstance(state, str) else None
            rect = pdf.resolve(a.get("Rect"))
            if isinstance(normal, Stream):
                r = [pdf.resolve(x) for x in rect] if isinstance(rect, list) else []
                ok = len(r) >= 4 and all(isinstance(x, (int, float)) for x in r)
                yield normal, float(min(r[0], r[2])) if ok else 0.0, float(min(r[1], r[3])) if ok else 0.0

    def runs(self, page: dict, resources: dict) -> list[Run]:
        made = Page(self.pdf, self.fonts, self.options.word_gap)
        try:
            made.execute(self.content(page), resources)
            if self.options.annotations:
                for s, x, y in self.appearances(page):
                    made.annotation(s, x, y, resources)
        except TooMuch:
            self.pdf.warn("Text past half of memoryBudget is cut off")
        return made.runs

    def text(self, runs: list[Run]) -> str:
        return clean(page_text(runs, self.options.word_gap, dehyphenate=self.options.dehyphenate), self.options.expand_ligatures)

    def page_count(self) -> int:
        n = self.pdf.resolve((self.pdf.dict(self.root().get("Pages")) or {}).get("Count"))
        return n if isinstance(n, int) and n > 0 else sum(1 for _ in self.walk())

    def info(self) -> dict[str, str]:
        pdf = self.pdf
        ref = pdf.trailer.get("Info")
        out = {}
        num, gen = (ref.num, ref.gen) if isinstance(ref, tuple) and hasattr(ref, "num") else (0, 0)
        packed = pdf.where.get(num, (0, -1))[1] >= 0
        for key, value in (pdf.dict(ref) or {}).items():
            value = pdf.resolve(value)
            if isinstance(value, bytes):
                if pdf.cipher is not None and not packed:
                    value = pdf.cipher.string(value, num, gen)
                out[str(key).encode("utf-8", "replace").decode()] = text_string(value).strip(EDGES)
        return out


def opened(data: bytes | None, options: Options) -> tuple[Document | None, Result]:
    try:
        doc = Document(data or b"", options)
        return doc, Result("OK", encrypted=doc.pdf.cipher is not None)
    except Locked:
        return None, Result("ENCRYPTED", encrypted=True)
    except (NotPdf, *BROKEN):
        return None, Result("INVALID")


def pages(data: bytes | None, options: Options, only: int | None = None) -> Iterator[tuple[int, list[Run], str]]:
    """(page number from 1, runs, text) of each page, or of one; a page that fails is empty."""
    doc, _ = opened(data, options)
    if doc is not None:
        yield from pages_of(doc, only)


def pages_of(doc: Document, only: int | range | None = None) -> Iterator[tuple[int, list[Run], str]]:
    """The pages; only: one number, or a range of them."""
    wanted = range(only, only + 1) if isinstance(only, int) else only
    number = 0
    try:
        for page, resources in doc.walk():
            number += 1
            if wanted is not None and number not in wanted:
                if number >= wanted.stop:
                    return
                continue
            try:
                runs = doc.runs(page, resources)
                text = doc.text(runs)
            except BROKEN as e:
                doc.pdf.warn(f"Page {number} failed with {type(e).__name__} and counts as empty")
                runs, text = [], ""
            yield number, runs, text
    except BROKEN as e:
        doc.pdf.warn(f"The walk of the page tree ended early with {type(e).__name__}")


def about(data: bytes | None, options: Options) -> Result:
    """Metadata alone; no content is decoded."""
    doc, result = opened(data, options)
    if doc is not None:
        try:
            result.page_count, result.info = doc.page_count(), doc.info()
        except BROKEN as e:
            doc.pdf.warn(f"Reading the metadata failed with {type(e).__name__}")
        result.warnings = list(doc.pdf.notes.values())
    return result
