"""Fonts: what the bytes of a shown string read, how wide they are, and how many letters."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable
from typing import Any

from parchmill.kernel import glyphs, programs
from parchmill.kernel.objects import Name, Pdf, Ref, Stream

RTL = re.compile("[\u0590-\u08ff\ufb1d-\ufdff\ufe70-\ufefc]")
#: Stands for a glyph with a width and no character.
BLANK = "\x1f"
BLANK_WIDTH = 0.1

UNICODE_CMAPS = re.compile(r"Uni(?:GB|CNS|JIS|JISX0213|JISX02132004|JIS2004|JISPro|KS)-(?:UCS2|UTF16)(?:-HW)?-[HV]")
#: The codecs of named CMaps.
CODECS = {"90ms-RKSJ": "cp932", "90msp-RKSJ": "cp932", "90pv-RKSJ": "cp932", "83pv-RKSJ": "cp932", "RKSJ": "cp932", "EUC": "euc_jp", "GBK-EUC": "gbk", "GBKp-EUC": "gbk", "GBK2K": "gb18030", "GB-EUC": "gb2312", "GBpc-EUC": "gb2312", "ETen-B5": "big5", "ETenms-B5": "big5", "B5pc": "big5", "HKscs-B5": "big5", "KSC-EUC": "euc_kr", "KSCms-UHC": "cp949", "KSCms-UHC-HW": "cp949", "KSCpc-EUC": "euc_kr"}


class Filled(dict):
    """What a function gives for each code, kept."""

    def __init__(self, make: Callable[[int], Any]) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, code: int) -> Any:
        if len(self) > 65_536:
            self.clear()
        self[code] = found = self.make(code)
        return found


class Font:
    """decode(bytes) -> (text, width in ems, letters, spaces, text as drawn)."""

    def __init__(self) -> None:
        self.name, self.subtype = "", ""
        self.table: list[str] | None = None  # of a simple font
        self.map: Any = None  # of a composite one: get(code)
        self.spaces: list[tuple[int, int, int]] = []
        self.codec: str | None = None
        self.unicode = self.unmapped = self.rtl = False
        self.widths: dict[int, float] = {}
        self.wide = programs.Ranges([])
        self.default, self.scale = 0.0, 0.001
        self.memo: dict[bytes, tuple[str, float, int, int, str]] = {}
        self.letters, self.measures = Filled(self.letter), Filled(self.width)
        self.simple_widths: list[float] | None = None

    def decode(self, s: bytes) -> tuple[str, float, int, int, str]:
        got = self.memo.get(s)
        if got is None:
            got = self._simple(s) if self.table is not None else self._composite(s)
            if len(self.memo) > 1000:
                self.memo.clear()
            if len(s) <= 48:
                self.memo[s] = got
        return got

    def _simple(self, s: bytes) -> tuple[str, float, int, int, str]:
        if self.simple_widths is None:
            self.simple_widths = [self.widths.get(c, self.default) for c in range(256)]
        letters = list(map(self.table.__getitem__, s))
        width = sum(map(self.simple_widths.__getitem__, s)) * self.scale
        return self._told(letters, width, len(s), s.count(32))

    def _told(self, letters: list[str], width: float, n: int, spaces: int) -> tuple[str, float, int, int, str]:
        text = "".join(letters)
        if BLANK in text and not text.strip(BLANK):
            text, letters = "", []
        drawn = text
        if self.rtl and letters and not text.isascii() and max(map(len, letters)) > 1:
            # The line is turned around later, so the letters of one glyph are turned here to come out right.
            drawn = "".join(x[::-1] if len(x) > 1 and RTL.search(x) else x for x in letters)
        return text, width, n, spaces, drawn

    def codes(self, s: bytes) -> list[tuple[int, int]]:
        """(code, bytes) of each character of a composite font's string."""
        if not self.spaces:
            return [(int.from_bytes(s[i : i + 2], "big"), 2) for i in range(0, len(s), 2)]
        out, i = [], 0
        while i < len(s):
            for n in range(1, 5):
                code = int.from_bytes(s[i : i + n], "big")
                if i + n <= len(s) and any(k == n and lo <= code <= hi for k, lo, hi in self.spaces):
                    break
            else:
                n, code = 1, s[i]
            out.append((code, n))
            i += n
        return out

    def width(self, code: int) -> float:
        if code in self.widths:
            return self.widths[code]
        found = self.wide.find(code)
        return found[2] if found else self.default

    def letter(self, code: int) -> str:
        text = glyphs.character(code) if self.unicode else self.map.get(code) if self.map is not None else None
        if self.unicode and self.map is not None:
            text = self.map.get(code) or text
        if not text and self.map is not None and self.measures[code] * self.scale >= BLANK_WIDTH:
            text = BLANK
        return text or ""

    def _composite(self, s: bytes) -> tuple[str, float, int, int, str]:
        if self.codec:
            text = s.decode(self.codec, "ignore")
            return text, len(text) * self.default * self.scale, len(text), 0, text
        if self.spaces or len(s) & 1:
            pairs = self.codes(s)
            codes = [c for c, _ in pairs]
            spaces = sum(1 for c, n in pairs if c == 32 and n == 1)
        else:
            codes, spaces = struct.unpack(f">{len(s) // 2}H", s), 0
        return self._told(list(map(self.letters.__getitem__, codes)), sum(map(self.measures.__getitem__, codes)) * self.scale, len(codes), spaces)


class Characters:
    """A dictionary of code points as a map of codes."""

    def __init__(self, found: dict[int, int]) -> None:
        self.found = found

    def get(self, code: int) -> str | None:
        cp = self.found.get(code)
        return None if cp is None else glyphs.character(cp)


class Fonts:
    """Loads the fonts of one file."""

    def __init__(self, pdf: Pdf, glyph_list: str | None = None, collections: Any = None) -> None:
        self.pdf, self.glyph_list, self.collections = pdf, glyph_list, collections
        self.loaded: dict[Any, Font] = {}

    def load(self, ref: Any) -> Font:
        key = ref.num if isinstance(ref, Ref) else id(ref)
        if key in self.loaded:
            return self.loaded[key]
        try:
            d = self.pdf.dict(ref) or {}
            made = self.composite(d) if d.get("Subtype") == "Type0" else self.simple(d)
            made.subtype = str(d.get("Subtype", ""))
            base = self.pdf.resolve(d.get("BaseFont"))
            made.name = re.sub(r"^[A-Z]{6}\+", "", str(base)) if isinstance(base, Name) else ""
            if made.unmapped:
                self.pdf.warn(f"The font {made.name or '(unnamed)'} maps no code to a character, so that its strings read as nothing", f"unmapped {made.name}")
        except (ValueError, TypeError, IndexError, KeyError, OverflowError, RecursionError):
            made = Font()
            made.table = list(glyphs.encoding("WinAnsiEncoding"))
        if made.table is not None:
            made.rtl = bool(RTL.search("".join(made.table)))
        else:
            made.rtl = True  # told by its text, string by string
        if len(self.loaded) >= 1024:
            self.loaded.clear()
        self.loaded[key] = made
        return made

    def real(self, value: Any, default: float = 0.0) -> float:
        value = self.pdf.resolve(value)
        return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else default

    def to_unicode(self, d: dict) -> programs.CMap | None:
        s = self.pdf.resolve(d.get("ToUnicode"))
        if not isinstance(s, Stream):
            return None
        data = self.pdf.stream_data(s) or b""
        if b"begin" not in data:  # compressed, and not declared so
            from parchmill.kernel.filters import inflate

            data = inflate(data, self.pdf.limit) or data
        made = programs.CMap(data, max(1 << 16, self.pdf.budget // 32))
        if made.partial:
            self.pdf.warn("Entries of a character map past its share of memoryBudget are ignored")
        return made if made else None

    def simple(self, d: dict) -> Font:
        pdf, font = self.pdf, Font()
        base = pdf.resolve(d.get("BaseFont"))
        base = re.sub(r"^[A-Z]{6}\+", "", str(base)) if isinstance(base, Name) else ""
        about = pdf.dict(d.get("FontDescriptor")) or {}
        symbolic = int(self.real(about.get("Flags"))) & 4
        told = pdf.resolve(d.get("Encoding"))
        named, differences = (str(told), {}) if isinstance(told, Name) else (None, {})
        if isinstance(told, dict):
            inner = pdf.resolve(told.get("BaseEncoding"))
            named = str(inner) if isinstance(inner, Name) else None
            code = 0
            for item in pdf.resolve(told.get("Differences")) or []:
                item = pdf.resolve(item)
                if isinstance(item, Name):
                    differences[code] = str(item)
                    code += 1
                elif isinstance(item, (int, float)):
                    code = int(item)
        table = None
        if named is None:
            lower = base.lower()
            if lower.startswith("symbol"):
                named = "Symbol"
            elif "dingbats" in lower:
                named = "ZapfDingbats"
            elif d.get("Subtype") == "TrueType":
                named = "WinAnsiEncoding"
            else:
                table = self.built_in(about)
                named = "WinAnsiEncoding" if symbolic and table is None and not differences else "StandardEncoding"
        table = list(table or glyphs.encoding(named))
        real_names = made_up = 0
        numbered = []
        for code, name in differences.items():
            if not 0 <= code < 256:
                continue
            text = glyphs.known(name, self.glyph_list)
            if text is not None:
                table[code] = text
                real_names += text != ""
                continue
            made_up += 1
            if (m := re.fullmatch(r"(?:[A-Za-z]{1,2}|cid|glyph|index)(\d+)", name)) and int(m[1]) == code:
                numbered.append(code)
            elif not table[code] and (m := re.fullmatch(r"[A-Za-z]{1,2}([0-9A-Fa-f]{2})", name)) and int(m[1], 16) == code:
                table[code] = glyphs.encoding("WinAnsiEncoding")[code]
        tex = glyphs.cork() if numbered and max(numbered) > 127 else glyphs.OT1
        for code in numbered:
            table[code] = tex.get(code, table[code])
        cmap = self.to_unicode(d)
        if cmap is not None:
            table = [cmap.get(code) or text for code, text in enumerate(table)]
        font.unmapped = cmap is None and made_up > 8 and not real_names
        type3 = d.get("Subtype") == "Type3"
        if type3:
            matrix = pdf.resolve(d.get("FontMatrix"))
            first = self.real(matrix[0]) if isinstance(matrix, list) and matrix else 0.0
            font.scale = abs(first) or 0.001
        font.default = self.real(about.get("MissingWidth"))
        widths = pdf.resolve(d.get("Widths"))
        if isinstance(widths, list):
            first = int(self.real(d.get("FirstChar")))
            font.widths = {first + i: self.real(w) for i, w in enumerate(widths)}
            table = [BLANK if not text and font.widths.get(code, 0.0) * font.scale >= BLANK_WIDTH else text for code, text in enumerate(table)]
        else:
            fixed = "courier" in base.lower()
            metrics = glyphs.TIMES if "times" in base.lower() else glyphs.HELVETICA
            font.widths = {32 + i: 600.0 if fixed else float(w) for i, w in enumerate(metrics)}
            font.default = 600.0 if fixed else 500.0
        font.table = table
        return font

    def built_in(self, about: dict) -> list[str] | None:
        """The encoding that an embedded Type 1 or CFF program has of its own."""
        names = None
        s = self.pdf.resolve(about.get("FontFile"))
        if isinstance(s, Stream):
            names = programs.type1_encoding(self.pdf.stream_data(s, limit=65536, quiet=True) or b"")
        s = self.pdf.resolve(about.get("FontFile3"))
        if isinstance(s, Stream) and not names:
            names = programs.cff_encoding(self.pdf.stream_data(s, quiet=True) or b"")
        if not names:
            return None
        table = list(glyphs.encoding("StandardEncoding"))
        for code, name in names.items():
            text = glyphs.known(name, self.glyph_list)
            if text is not None:
                table[code] = text
        return table

    def composite(self, d: dict) -> Font:
        pdf, font = self.pdf, Font()
        font.default = 1000.0
        inner = pdf.resolve(d.get("DescendantFonts"))
        inner = (pdf.dict(inner[0]) or {}) if isinstance(inner, list) and inner else {}
        font.default = self.real(inner.get("DW"), 1000.0)
        self.cid_widths(font, pdf.resolve(inner.get("W")))
        told = pdf.resolve(d.get("Encoding"))
        identity = isinstance(told, Name) and told in ("Identity-H", "Identity-V")
        if isinstance(told, Stream):
            font.spaces = programs.CMap(pdf.stream_data(told) or b"").spaces[:16]
        elif isinstance(told, Name) and not identity:
            if UNICODE_CMAPS.fullmatch(told):
                font.unicode = True
            else:
                font.codec = CODECS.get(re.sub(r"-[HV]$", "", told))
        cmap = self.to_unicode(d)
        if cmap is not None:
            font.map, font.codec = cmap, None
            if not isinstance(told, Stream) and not font.unicode and not identity:
                font.spaces = cmap.spaces[:16]
        elif isinstance(x := pdf.resolve(d.get("ToUnicode")), Name) and x in ("Identity-H", "Identity-V"):
            font.unicode = True
        elif not font.unicode and not font.codec:
            font.map = self.fallback(inner) if identity else None
            font.unmapped = font.map is None
        return font

    def fallback(self, inner: dict) -> Any:
        pdf = self.pdf
        system = pdf.dict(inner.get("CIDSystemInfo")) or {}
        ordering = pdf.resolve(system.get("Ordering"))
        if self.collections is not None and isinstance(ordering, bytes) and (found := self.collections(ordering.decode("latin-1"))) is not None:
            return found
        s = pdf.resolve((pdf.dict(inner.get("FontDescriptor")) or {}).get("FontFile2"))
        if not isinstance(s, Stream):
            return None
        found = programs.glyph_characters(pdf.stream_data(s, quiet=True) or b"")
        order = pdf.resolve(inner.get("CIDToGIDMap"))
        if found and isinstance(order, Stream):
            to = pdf.stream_data(order) or b""
            found = {cid: found[g] for cid in range(len(to) // 2) if (g := int.from_bytes(to[2 * cid : 2 * cid + 2], "big")) in found}
        return Characters(found) if found else None

    def cid_widths(self, font: Font, w: Any) -> None:
        """Widths listed one by one, and those of ranges; of ranges that overlap the later counts."""
        if not isinstance(w, list):
            return
        wide, i = [], 0
        while i + 1 < len(w):
            first, second = self.pdf.resolve(w[i]), self.pdf.resolve(w[i + 1])
            if not isinstance(first, int):
                i += 1
            elif isinstance(second, list):
                for k, x in enumerate(second):
                    font.widths[first + k] = self.real(x)
                i += 2
            elif i + 2 < len(w):
                if isinstance(second, int) and second >= first:
                    wide.append((first, second, self.real(w[i + 2])))
                i += 3
            else:
                break
        font.wide = programs.Ranges(wide[::-1])
