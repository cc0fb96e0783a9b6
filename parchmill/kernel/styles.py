"""The same text drawn in many ways: a PDF of plain text through a chosen kind of font, way of drawing, and state of the file.

What is read back must not depend on any of them, so these files hold the reader against the text itself.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from functools import lru_cache
from itertools import groupby

from parchmill.kernel import glyphs, writer
from parchmill.kernel.layout import ACCENTS

#: Lines are 12 units apart, letters 10 units high, and the first line stands here.
LEFT, TOP, STEP, EM = 72, 800, 12, 10
#: These files are read where they are made: Flate's level that takes the least time.
FAST = 1
#: Characters of a font with one-byte codes.
MOST = 200


# --- fonts: dictionaries, further objects, and the code of each character -----------------------


@lru_cache(maxsize=1)
def named() -> dict[str, str]:
    return {text: name for name, text in sorted(glyphs.names().items(), key=lambda x: (-len(x[0]), x[0]))}


def glyph_name(ch: str) -> str:
    """A name of the glyph: the shortest of the list where it has one, else its number."""
    return named().get(ch) or (f"uni{ord(ch):04X}" if ord(ch) < 0x10000 else f"u{ord(ch):05X}")


#: Bytes as they stand in a literal string.
ESCAPED = [f"\\{b:03o}" if b < 32 or b > 126 or b in b"()\\" else chr(b) for b in range(256)]


class Face:
    """Fonts F1, F2, ... for the characters of a text; every glyph is half an em wide unless widths are told."""

    def __init__(self, kind: str, letters: list[str]) -> None:
        self.fonts: dict[str, str] = {}
        self.extra: dict[int, bytes] = {}
        self.at: dict[str, tuple[str, bytes]] = {}
        self.width: dict[str, int] = {}
        getattr(self, f"_{kind}")(letters)
        self.hexes = {ch: code.hex() for ch, (_, code) in self.at.items()}
        self.literals = {ch: "".join(ESCAPED[b] for b in code) for ch, (_, code) in self.at.items()}
        self.font = {ch: font for ch, (font, _) in self.at.items()}
        self.one = next(iter(self.fonts)) if len(self.fonts) == 1 else None
        joined = [re.escape(ch) for ch in self.at if len(ch) > 1]
        self.cut = re.compile("|".join([*joined, "."]), re.S).findall if joined else list

    def groups(self, letters: list[str]) -> list[tuple[str, list[str]]]:
        return [(f"F{1 + i // MOST}", letters[i : i + MOST]) for i in range(0, max(1, len(letters)), MOST)]

    def simple(self, letters: list[str], body, first: int = 1) -> None:
        """One-byte codes from `first` on; body(number, group, names): the rest of the font's dictionary."""
        widths = f"/FirstChar 0 /Widths [{' '.join(['500'] * 256)}]"
        for i, (name, group) in enumerate(self.groups(letters)):
            self.fonts[name] = f"/BaseFont /ABCDEF+Own {widths} " + body(300 + 10 * i, group, [glyph_name(ch) for ch in group])
            self.at |= {ch: (name, bytes([first + k])) for k, ch in enumerate(group)}

    def _differences(self, letters: list[str]) -> None:
        self.simple(letters, lambda n, group, names: f"/Subtype /Type1 /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 {' '.join('/' + x for x in names)}] >>")

    def _ligatures(self, letters: list[str]) -> None:
        """As above, with glyphs of several letters for fi, fl and ff."""
        self._differences([*letters, "fi", "fl", "ff"])

    def _type1(self, letters: list[str]) -> None:
        def body(n: int, group: list[str], names: list[str]) -> str:
            listed = "\n".join(f"dup {1 + k} /{x} put" for k, x in enumerate(names))
            self.extra[n] = writer.stream(f"%!PS-AdobeFont-1.0: Own\n/Encoding 256 array\n0 1 255 {{1 index exch /.notdef put}} for\n{listed}\nreadonly def\ncurrentfile eexec\n".encode())
            self.extra[n + 1] = f"<< /Type /FontDescriptor /Flags 4 /FontFile {n} 0 R >>".encode()
            return f"/Subtype /Type1 /FontDescriptor {n + 1} 0 R"

        self.simple(letters, body)

    def _cff(self, letters: list[str]) -> None:
        def body(n: int, group: list[str], names: list[str]) -> str:
            self.extra[n] = writer.stream(cff(names), "/Subtype /Type1C")
            self.extra[n + 1] = f"<< /Type /FontDescriptor /Flags 4 /FontFile3 {n} 0 R >>".encode()
            return f"/Subtype /Type1 /FontDescriptor {n + 1} 0 R"

        self.simple(letters, body)

    def _type3(self, letters: list[str]) -> None:
        def body(n: int, group: list[str], names: list[str]) -> str:
            self.extra[n] = writer.stream(unicode_map(group, 1, 1))
            return f"/Subtype /Type3 /FontMatrix [0.001 0 0 0.001 0 0] /ToUnicode {n} 0 R"

        self.simple(letters, body)

    def _winansi(self, letters: list[str]) -> None:
        """Latin in a standard font, whose widths are known; the rest by names."""
        codes = {ch: i for i, ch in enumerate(glyphs.encoding("WinAnsiEncoding")) if ch and (i >= 32) and not 127 <= i < 160}
        self._differences([ch for ch in letters if ch not in codes])
        self.fonts = {f"G{n}": x for n, x in self.fonts.items()} | {"F0": "/Subtype /TrueType /BaseFont /Helvetica /Encoding /WinAnsiEncoding"}
        self.at = {ch: (f"G{n}", x) for ch, (n, x) in self.at.items()} | {ch: ("F0", bytes([codes[ch]])) for ch in letters if ch in codes}

    def double(self, letters: list[str], more: str, inner: str) -> None:
        """Two-byte codes from 1 on in one composite font."""
        self.fonts["F1"] = f"/Subtype /Type0 /BaseFont /Own {more} /DescendantFonts [<< /Subtype /CIDFontType2 {inner} >>]"
        self.at = {ch: ("F1", struct.pack(">H", 1 + i)) for i, ch in enumerate(letters)}

    def _truetype(self, letters: list[str]) -> None:
        self.double(letters, "/Encoding /Identity-H", "/DW 500 /FontDescriptor 301 0 R /CIDToGIDMap /Identity")
        self.extra = {300: writer.stream(truetype(letters)), 301: b"<< /Type /FontDescriptor /FontFile2 300 0 R >>"}

    def _widths(self, letters: list[str]) -> None:
        """Widths one by one for the first half, by ranges for the rest."""
        half = len(letters) // 2
        self.width = {ch: 300 + 37 * i % 600 if i < half else 450 + 50 * (i // 7 % 5) for i, ch in enumerate(letters)}
        ranges = " ".join(f"{1 + i} {min(i + 7, len(letters))} {450 + 50 * (i // 7 % 5)}" for i in range(0, len(letters), 7))
        listed = " ".join(str(self.width[ch]) for ch in letters[:half])
        self.double(letters, "/Encoding /Identity-H /ToUnicode 300 0 R", f"/DW 1000 /W [{ranges} 1 [{listed}]]")
        self.extra[300] = writer.stream(unicode_map(letters, 1, 2))

    def _blanks(self, letters: list[str]) -> None:
        """A space has a glyph and a width, and no character."""
        self.double(letters, "/Encoding /Identity-H /ToUnicode 300 0 R", "/DW 500")
        self.extra[300] = writer.stream(unicode_map([ch if ch != " " else None for ch in letters], 1, 2))

    def _ucs2(self, letters: list[str]) -> None:
        self.double([], "/Encoding /UniGB-UTF16-H", "/DW 500")
        self.at = {ch: ("F1", ch.encode("utf-16-be")) for ch in letters}

    def _gbk(self, letters: list[str]) -> None:
        self.double([], "/Encoding /GBK2K-H", "/DW 500")
        self.at = {ch: ("F1", ch.encode("gb18030")) for ch in letters}


def unicode_map(letters: list[str | None], first: int, size: int) -> bytes:
    """Runs of characters as ranges, the others one by one."""
    rows, ranges, i = [], [], 0
    while i < len(letters):
        j = i + 1
        while letters[i] is not None and j < len(letters) and letters[j] is not None and ord(letters[j]) == ord(letters[i]) + j - i and (first + j) >> 8 == (first + i) >> 8 and ord(letters[j]) < 0x10000:
            j += 1
        code = lambda k: f"<{first + k:0{2 * size}X}>"
        if letters[i] is not None and j - i > 1:
            ranges.append(f"{code(i)} {code(j - 1)} <{letters[i].encode('utf-16-be').hex()}>")
        elif letters[i] is not None:
            rows.append(f"{code(i)} <{letters[i].encode('utf-16-be').hex()}>")
        i = j
    top = "FF" * size
    lines = "\n".join
    return f"1 begincodespacerange <{'00' * size}> <{top}> endcodespacerange\n{len(ranges)} beginbfrange\n{lines(ranges)}\nendbfrange\n{len(rows)} beginbfchar\n{lines(rows)}\nendbfchar".encode()


def truetype(letters: list[str]) -> bytes:
    """A font that has nothing but a table from characters to glyphs, which are numbered from 1."""
    rows = b"".join(struct.pack(">III", ord(ch), ord(ch), 1 + i) for i, ch in enumerate(letters))
    table = struct.pack(">HHHHI", 0, 1, 3, 10, 12) + struct.pack(">HHIII", 12, 0, 16 + len(rows), 0, len(letters)) + rows
    return struct.pack(">IHHHH", 0x10000, 1, 0, 0, 0) + b"cmap" + struct.pack(">III", 0, 28, len(table)) + table


def cff(names: list[str]) -> bytes:
    """A font program of empty glyphs with an encoding of its own: code k for glyph k."""
    def index(items: list[bytes]) -> bytes:
        if not items:
            return b"\0\0"
        ends = [1]
        for x in items:
            ends.append(ends[-1] + len(x))
        return struct.pack(">HB", len(items), 4) + b"".join(struct.pack(">I", e) for e in ends) + b"".join(items)

    def number(n: int) -> bytes:
        return b"\x1d" + struct.pack(">i", n)

    n = len(names)
    charset = b"\0" + b"".join(struct.pack(">H", 391 + i) for i in range(n))
    encoding = bytes([0, n, *range(1, n + 1)])
    glyph = index([b"\x0e"] * (n + 1))
    head = b"\x01\0\x04\x04" + index([b"Own"])
    strings = index([x.encode() for x in names]) + index([])
    top = lambda a, b, c: number(a) + b"\x0f" + number(b) + b"\x10" + number(c) + b"\x11"
    at = len(head) + len(index([top(0, 0, 0)])) + len(strings)
    return head + index([top(at, at + len(charset), at + len(charset) + len(encoding))]) + strings + charset + encoding + glyph


# --- ways of drawing: content of a page from its lines ------------------------------------------


class Page:
    """Draws the lines of one page; forms and annotations are further objects."""

    def __init__(self, face: Face, objects: dict[int, bytes], next_number: int) -> None:
        self.face, self.objects, self.number = face, objects, next_number
        self.notes: list[str] = []

    def spans(self, text: str) -> list[tuple[str, list[str]]]:
        """The text by fonts; ligatures of the face are single glyphs."""
        letters = self.face.cut(text)
        if self.face.one is not None:
            return [(self.face.one, letters)] if letters else []
        return [(font, list(group)) for font, group in groupby(letters, self.face.font.__getitem__)]

    def hex(self, letters: list[str]) -> str:
        return f"<{''.join(map(self.face.hexes.__getitem__, letters))}>"

    def literal(self, letters: list[str]) -> str:
        return f"({''.join(map(self.face.literals.__getitem__, letters))})"

    def shown(self, text: str, string=None) -> str:
        return " ".join(f"/{font} {EM} Tf {(string or self.hex)(letters)} Tj" for font, letters in self.spans(text))

    def form(self, content: str, head: str = "") -> int:
        self.number += 1
        self.objects[self.number] = writer.stream(zlib.compress(content.encode(), FAST), f"/Type /XObject /Subtype /Form /Filter /FlateDecode {head}")
        return self.number

    def plain(self, lines: list[str]) -> str:
        return "BT " + "\n".join(f"1 0 0 1 {LEFT} {TOP - STEP * i} Tm {self.shown(x, self.literal if i % 2 else None)}" for i, x in enumerate(lines) if x) + " ET"

    def moved(self, lines: list[str]) -> str:
        """Td, TD, T*, ' and \" in turn."""
        out, above = [f"BT {STEP} TL {LEFT} {TOP} Td"], 0
        for i, x in enumerate(lines):
            if not x:
                continue
            down = i - above
            for _ in range(max(0, down - 1)):
                out.append("T*")
            if down:
                first, *rest = self.spans(x)
                font, string = f"/{first[0]} {EM} Tf", self.hex(first[1])
                step = (f"0 {-STEP} Td {font} {string} Tj", f"0 {-STEP} TD {font} {string} Tj", f"T* {font} {string} Tj", f"{font} {string} '", f'{font} 0 0 {string} "')[i % 5]
                out.append(step + "".join(f" /{f} {EM} Tf {self.hex(letters)} Tj" for f, letters in rest))
            else:
                out.append(self.shown(x))
            above = i
        return "\n".join([*out, "ET"])

    def kerned(self, lines: list[str]) -> str:
        """Arrays: letters drawn together, and gaps for single spaces inside a line."""
        def array(letters: list[str], inner: str) -> str:
            gaps = {k for k in range(1, len(letters) - 1) if letters[k] == " " and letters[k - 1] != " " and letters[k + 1] != " "} if inner and " " in letters else set()
            codes = [self.face.hexes[ch] for ch in letters]
            items, at = [], 0
            for k in sorted(gaps.union(range(4, len(letters), 5))):
                items += [f"<{''.join(codes[at:k])}>", "-420"] if k in gaps else [f"<{''.join(codes[at : k + 1])}>", str(k % 9 * 8)]
                at = k + 1
            items.append(f"<{''.join(codes[at:])}>")
            return " TJ ".join(f"[{' '.join(items[i : i + 2000])}]" for i in range(0, len(items), 2000))

        out = []
        for i, x in enumerate(lines):
            if x:
                out.append(f"1 0 0 1 {LEFT} {TOP - STEP * i} Tm " + " ".join(f"/{f} {EM} Tf {array(letters, x.strip())} TJ" for f, letters in self.spans(x)))
        return "BT " + "\n".join(out) + " ET"

    def nested(self, lines: list[str]) -> str:
        """Each line in a state of its own: turned axes, scales, character and word spacing, stretched letters."""
        out = []
        for i, x in enumerate(lines):
            if x:
                y = TOP - STEP * i
                state = (f"1 0 0 1 {LEFT} {y} cm BT", f"2 0 0 2 {LEFT} {y} cm 0.5 0 0 0.5 0 0 cm BT", f"0 1 -1 0 {LEFT} {y} cm 0 -1 1 0 0 0 cm BT 120 Tz", f"1 0 0 1 {LEFT - 3} {y + 4} cm BT 0.4 Tc 1 Tw 3 -4 Td")[i % 4]
                out.append(f"q {state} {self.shown(x)} ET Q")
        return "q 9 w 1 0 0 RG 10 10 m 20 20 l S BI /W 1 /H 1 /BPC 8 ID \x00(Tj EI Q\n" + "\n".join(out)

    def forms(self, lines: list[str]) -> str:
        """Each line a form; every third one inside another."""
        out = []
        for i, x in enumerate(lines):
            if x:
                number = self.form(f"BT {self.shown(x)} ET", "/Matrix [1 0 0 1 5 0]" if i % 2 else "")
                if i % 3 == 2:
                    number = self.form(f"q 1 0 0 1 0 0 cm /X{number} Do Q")
                out.append(f"q 1 0 0 1 {LEFT - 5 * (i % 2)} {TOP - STEP * i} cm /X{number} Do Q")
        return "\n".join(out)

    def annotated(self, lines: list[str]) -> str:
        """The second half of the lines are stamps; hidden notes and links say something else."""
        half = (len(lines) + 1) // 2
        for i, x in enumerate(lines[half:], half):
            if x:
                number = self.form(f"BT {self.shown(x)} ET")
                self.notes.append(f"<< /Subtype /Stamp /Rect [{LEFT} {TOP - STEP * i} 500 {TOP - STEP * i + 10}] /AP << /N {number if i % 2 else f'<< /On {number} 0 R >>'}{' 0 R' if i % 2 else ''} >>{'' if i % 2 else ' /AS /On'} >>")
                self.notes.append(f"<< /Subtype /{'Link' if i % 2 else 'Stamp /F 2'} /Rect [0 0 9 9] /AP << /N {number} 0 R >> >>")
        return self.plain(lines[:half])

    def bold(self, lines: list[str]) -> str:
        """Every line twice, a little to the right."""
        return "BT " + "\n".join(f"1 0 0 1 {LEFT + d} {TOP - STEP * i} Tm /{f} {EM} Tf {self.hex(letters)} Tj" for i, x in enumerate(lines) if x for f, letters in self.spans(x)[:1] for d in (0, 0.3)) + " ET"

    def accented(self, lines: list[str]) -> str:
        """An accent is drawn by itself, and the letter over it."""
        marks = {mark: accent for accent, mark in reversed(ACCENTS.items())}
        out = []
        for i, x in enumerate(lines):
            if not x:
                continue
            items, held = [], ""
            for ch in x:
                apart = unicodedata.normalize("NFD", ch)
                if len(apart) == 2 and apart[1] in marks and apart[0] in self.face.at and marks[apart[1]] in self.face.at and not any(a in x for a in ACCENTS):
                    items += [held, marks[apart[1]]]
                    held = apart[0]
                else:
                    held += ch
            parts = [f"/{f} {EM} Tf [{'' if k % 2 == 0 else ''}{self.hex(letters)}{' 500' if k % 2 else ''}] TJ" for k, part in enumerate([*items, held]) for f, letters in self.spans(part)]
            out.append(f"1 0 0 1 {LEFT} {TOP - STEP * i} Tm " + " ".join(parts))
        return "BT " + "\n".join(out) + " ET"

    def spaced(self, lines: list[str]) -> str:
        """Words by themselves, at the places that the widths of the letters give; no space is drawn inside a line."""
        out = []
        for i, x in enumerate(lines):
            at = 0.0
            for part in re.findall(r"^ +| +$|[^ ]+(?: {2,}[^ ]+)*| ", x):
                if part != " " or not x.strip():
                    out.append(f"1 0 0 1 {LEFT + at:.3f} {TOP - STEP * i} Tm {self.shown(part)}")
                at += sum(self.face.width.get(ch, 500) for ch in part) * EM / 1000
        return "BT " + "\n".join(out) + " ET"


# --- states of the file -------------------------------------------------------------------------

#: A stream's length in its dictionary; a text that says so isn't meant.
LENGTH = re.compile(rb"/Length \d+(?= >>\nstream\n)")
DAMAGE = {
    "startxref": lambda pdf: re.sub(rb"startxref\n\d+", b"startxref\n999999999", pdf),
    "lengths": lambda pdf: LENGTH.sub(b"/Length 3", pdf),
    "no endstream": lambda pdf: LENGTH.sub(b"/Length 99999999", pdf).replace(b"\nendstream", b""),
    "offsets": lambda pdf: re.sub(rb"\n(\d{10}) 00000 n", lambda m: b"\n%010d 00000 n" % (int(m[1]) + 7), pdf),
    "cut": lambda pdf: pdf[: pdf.rindex(b"xref\n0 ")],
    "junk": lambda pdf: b"From: somebody\n\n" + pdf,
}


def updated(pdf: bytes, objects: dict[int, bytes]) -> bytes:
    """The file with newer versions of some objects after its end."""
    start = int(re.findall(rb"startxref\n(\d+)", pdf)[-1])
    out, rows = bytearray(pdf + b"\n"), []
    for n, body in sorted(objects.items()):
        rows.append(b"%d 1\n%010d 00000 n \n" % (n, len(out)))
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    place = len(out)
    size = max(int(x) for x in re.findall(rb"/Size (\d+)", pdf))
    return bytes(out + b"xref\n" + b"".join(rows) + b"trailer\n<< /Size %d /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (size, start, place))


def pdf_of(text: str, face: str = "differences", drawing: str = "plain", lines_a_page: int = 1_000_000, damage: str | None = None, update: bool = False) -> bytes:
    """A PDF of the text's lines: a kind of font (see Face), a way of drawing (see Page), and what is wrong with the file."""
    letters = {ch for ch in text if ch != "\n"}
    if drawing == "accented":
        letters |= set(ACCENTS) | {unicodedata.normalize("NFD", ch)[0] for ch in letters}
    chosen = Face(face, sorted(letters))
    objects: dict[int, bytes] = {}
    lines = text.split("\n")
    number, kids, drafts = 1000, [], {}
    for at in range(0, len(lines), lines_a_page):
        page = Page(chosen, objects, number + 10)
        content = getattr(page, drawing)(lines[at : at + lines_a_page])
        number = page.number + 2
        body = writer.stream(zlib.compress(content.encode("latin-1"), FAST), "/Filter /FlateDecode") if damage is None else writer.stream(content.encode("latin-1"))
        objects[number] = body
        if update:
            drafts[number], objects[number] = body, writer.stream(b"BT /F1 10 Tf (DRAFT) Tj ET")
        notes = f"/Annots [{' '.join(page.notes)}]" if page.notes else ""
        objects[number + 1] = f"<< /Type /Page /Parent 2 0 R /Contents {number} 0 R {notes} >>".encode()
        kids.append(f"{number + 1} 0 R")
        number += 2
    for i, (name, body) in enumerate(chosen.fonts.items()):
        objects[10 + i] = f"<< /Type /Font /Name /{name} {body} >>".encode()
    fonts = " ".join(f"/{name} {10 + i} 0 R" for i, name in enumerate(chosen.fonts))
    forms = " ".join(f"/X{n} {n} 0 R" for n, body in objects.items() if b"/Subtype /Form" in body)
    objects |= chosen.extra | {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: f"<< /Font << {fonts} >> /XObject << {forms} >> >>".encode()}
    objects[2] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} /Resources 3 0 R >>".encode()
    pdf = writer.assembled(dict(sorted(objects.items())))
    if update:
        pdf = updated(pdf, drafts)
    return DAMAGE[damage](pdf) if damage else pdf
