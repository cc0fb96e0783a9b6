"""What embedded font programs say about their characters: CMaps, TrueType cmap tables, CFF and Type 1 encodings."""

from __future__ import annotations

import re
import struct
from bisect import bisect_right

from parchmill.kernel.glyphs import character, encoding
from parchmill.kernel.objects import unhexed

#: A range this wide or narrower is spelled out.
NARROW = 512


def utf16(data: bytes) -> str:
    """UTF-16 text; one byte is a code point, a byte left over is ignored, and a half of a pair alone is dropped."""
    if len(data) == 1:
        return character(data[0])
    return data[: len(data) & ~1].decode("utf-16-be", "ignore")


class Ranges:
    """Ranges of codes of which the first in the list that holds a code counts, flattened once and searched by halves."""

    def __init__(self, ranges: list[tuple[int, int, object]]) -> None:
        self.starts: list[int] = []
        self.found: list[object] = []
        import heapq

        order = sorted(range(len(ranges)), key=lambda i: ranges[i][0])
        edges = sorted({x for lo, hi, _ in ranges if lo <= hi for x in (lo, hi + 1)})
        heap: list[tuple[int, int]] = []
        at = 0
        for edge in edges:
            while at < len(order) and ranges[order[at]][0] <= edge:
                heapq.heappush(heap, (order[at], ranges[order[at]][1]))
                at += 1
            while heap and heap[0][1] < edge:
                heapq.heappop(heap)
            best = heap[0][0] if heap else None
            if not self.found or self.found[-1] != best:
                self.starts.append(edge)
                self.found.append(best)
        self.ranges = ranges

    def find(self, code: int) -> tuple[int, int, object] | None:
        i = bisect_right(self.starts, code) - 1
        return None if i < 0 or self.found[i] is None else self.ranges[self.found[i]]


class CMap:
    """Codes to text. spaces: (bytes, low, high) of its code spaces."""

    def __init__(self, data: bytes, most: int = 8 << 20) -> None:
        self.spaces: list[tuple[int, int, int]] = []
        self.exact: dict[int, str] = {}
        wide: list[tuple[int, int, object]] = []
        hexes = rb"<([0-9A-Fa-f\s]*)>"
        room = most
        for m in re.finditer(rb"begincodespacerange(.*?)(?:endcodespacerange|\Z)", data, re.S):
            for a, b in re.findall(hexes + rb"\s*" + hexes, m[1]):
                lo, hi = unhexed(a), unhexed(b)
                if lo and len(lo) == len(hi) <= 4 and len(self.spaces) < 4096:
                    self.spaces.append((len(lo), int.from_bytes(lo, "big"), int.from_bytes(hi, "big")))
        self.spaces = sorted(set(self.spaces))
        for m in re.finditer(rb"begin(bfchar|bfrange)(.*?)(?:end\1|\Z)", data, re.S):
            if m[1] == b"bfchar":
                for a, b in re.findall(hexes + rb"\s*" + hexes, m[2]):
                    room -= 64
                    if room > 0:
                        self.exact[int.from_bytes(unhexed(a)[:4], "big")] = self._clean(utf16(unhexed(b)[:256]))
                continue
            for a, b, one, many in re.findall(hexes + rb"\s*" + hexes + rb"\s*(?:" + hexes + rb"|\[(.*?)\])", m[2], re.S):
                lo, hi = int.from_bytes(unhexed(a)[:4], "big"), int.from_bytes(unhexed(b)[:4], "big")
                if many:
                    for i, x in enumerate(re.findall(hexes, many)[: max(0, hi - lo + 1)]):
                        room -= 64
                        if room > 0:
                            self.exact[lo + i] = self._clean(utf16(unhexed(x)[:256]))
                elif hi - lo < NARROW:
                    for code in range(lo, hi + 1):
                        room -= 64
                        if room > 0:
                            self.exact[code] = self._stepped(unhexed(one)[:256], code - lo)
                else:
                    wide.append((lo, hi, unhexed(one)[:256]))
        self.partial = room <= 0
        self.wide = Ranges(wide)

    @staticmethod
    def _clean(text: str) -> str:
        return "" if text in ("\0", "\ufffd") else text

    def _stepped(self, base: bytes, step: int) -> str:
        text = utf16(base)
        return self._clean(text[:-1] + character(ord(text[-1]) + step)) if text else ""

    def get(self, code: int) -> str | None:
        if code in self.exact:
            return self.exact[code]
        found = self.wide.find(code)
        return self._stepped(found[2], code - found[0]) if found else None

    def __bool__(self) -> bool:
        return bool(self.exact or self.wide.ranges)


def sfnt_table(data: bytes, tag: bytes) -> bytes | None:
    if len(data) < 12:
        return None
    for i in range(min(struct.unpack_from(">H", data, 4)[0], (len(data) - 12) // 16)):
        if data[12 + 16 * i : 16 + 16 * i] == tag:
            at, n = struct.unpack_from(">II", data, 20 + 16 * i)
            return data[at : at + n]
    return None


def glyph_characters(font: bytes) -> dict[int, int]:
    """Glyph -> code point by a TrueType font's cmap: ordinary characters before private ones, then the lowest.

    Empty if there is no usable table, or most of what it has is private.
    """
    table = sfnt_table(font, b"cmap")
    if not table or len(table) < 4:
        return {}
    #: Which (platform, encoding) is taken first.
    order = [(3, 10), (0, None), (3, 1), (3, 0), (1, 0)]
    best, rank = None, 99
    for i in range(min(struct.unpack_from(">H", table, 2)[0], (len(table) - 4) // 8)):
        platform, kind, at = struct.unpack_from(">HHI", table, 4 + 8 * i)
        for r, (p, k) in enumerate(order):
            if platform == p and k in (None, kind) and r < rank and at + 4 <= len(table):
                best, rank = at, r
    if best is None:
        return {}
    roman, symbol = rank == 4, rank == 3
    out: dict[int, int] = {}
    private = total = 0
    for code, glyph in _mapped(table, best):
        if roman:
            text = encoding("MacRomanEncoding")[code] if code < 256 else ""
            if not text:
                continue
            code = ord(text)
        elif symbol and 0xF020 <= code <= 0xF0FF:
            code -= 0xF000
        if not glyph or code < 32 or not character(code):
            continue
        hidden = 0xE000 <= code < 0xF900
        total, private = total + 1, private + hidden
        old = out.get(glyph)
        if old is None or (hidden, code) < (0xE000 <= old < 0xF900, old):
            out[glyph] = code
    return {} if not total or 2 * private > total else out


def _mapped(t: bytes, at: int):
    steps = 262_144
    kind = struct.unpack_from(">H", t, at)[0]
    if kind == 0:
        for code, glyph in enumerate(t[at + 6 : at + 262]):
            yield code, glyph
    elif kind == 6 and at + 10 <= len(t):
        first, n = struct.unpack_from(">HH", t, at + 6)
        for i in range(min(n, (len(t) - at - 10) // 2)):
            yield first + i, struct.unpack_from(">H", t, at + 10 + 2 * i)[0]
    elif kind == 12 and at + 16 <= len(t):
        for i in range(min(struct.unpack_from(">I", t, at + 12)[0], (len(t) - at - 16) // 12)):
            lo, hi, glyph = struct.unpack_from(">III", t, at + 16 + 12 * i)
            for code in range(lo, min(hi, lo + 65535) + 1):
                steps -= 1
                if steps < 0 or glyph + code - lo > 65535:
                    break
                yield code, glyph + code - lo
    elif kind == 4 and at + 14 <= len(t):
        n = struct.unpack_from(">H", t, at + 6)[0] // 2
        if at + 16 + 8 * n > len(t):
            return
        ends, starts, deltas, offsets = (struct.unpack_from(f">{n}H", t, at + 14 + k) for k in (0, 2 * n + 2, 4 * n + 2, 6 * n + 2))
        for i in range(n):
            place = at + 16 + 6 * n + 2 * i
            for code in range(starts[i], ends[i] + 1):
                steps -= 1
                if steps < 0:
                    return
                if code == 0xFFFF:
                    continue
                if offsets[i]:
                    p = place + offsets[i] + 2 * (code - starts[i])
                    glyph = struct.unpack_from(">H", t, p)[0] if p + 2 <= len(t) else 0
                    glyph = glyph + deltas[i] & 0xFFFF if glyph else 0
                else:
                    glyph = code + deltas[i] & 0xFFFF
                if glyph:
                    yield code, glyph


#: The strings that CFF fonts share, up to the last of ISOAdobe.
SHARED = """.notdef space exclam quotedbl numbersign dollar percent ampersand quoteright parenleft parenright asterisk plus
comma hyphen period slash zero one two three four five six seven eight nine colon semicolon less equal greater question at
A B C D E F G H I J K L M N O P Q R S T U V W X Y Z bracketleft backslash bracketright asciicircum underscore quoteleft
a b c d e f g h i j k l m n o p q r s t u v w x y z braceleft bar braceright asciitilde exclamdown cent sterling fraction
yen florin section currency quotesingle quotedblleft guillemotleft guilsinglleft guilsinglright fi fl endash dagger
daggerdbl periodcentered paragraph bullet quotesinglbase quotedblbase quotedblright guillemotright ellipsis perthousand
questiondown grave acute circumflex tilde macron breve dotaccent dieresis ring cedilla hungarumlaut ogonek caron emdash AE
ordfeminine Lslash Oslash OE ordmasculine ae dotlessi lslash oslash oe germandbls""".split()


class BadFont(ValueError):
    pass


def cff_encoding(data: bytes) -> dict[int, str] | None:
    """Code -> glyph name of a CFF font's own encoding; None for one without, or that can't be read."""
    try:
        if data[:4] == b"OTTO":
            data = sfnt_table(data, b"CFF ") or b""
        return _cff(data)
    except (BadFont, struct.error, IndexError, UnicodeDecodeError):
        return None


def _index(d: bytes, at: int) -> tuple[list[tuple[int, int]], int]:
    n = struct.unpack_from(">H", d, at)[0]
    if not n:
        return [], at + 2
    size = d[at + 2]
    if not 1 <= size <= 4 or at + 3 + (n + 1) * size > len(d):
        raise BadFont
    offs = [int.from_bytes(d[at + 3 + i * size : at + 3 + (i + 1) * size], "big") for i in range(n + 1)]
    base = at + 2 + (n + 1) * size
    if offs[0] != 1 or any(a > b for a, b in zip(offs, offs[1:], strict=False)) or base + offs[-1] > len(d):
        raise BadFont
    return [(base + a, base + b) for a, b in zip(offs, offs[1:], strict=False)], base + offs[-1]


def _top(d: bytes) -> dict[int, list[float]]:
    out, stack, i = {}, [], 0
    while i < len(d):
        b = d[i]
        i += 1
        if b <= 21:
            if b == 12:
                b, i = 1200 + d[i], i + 1
            out[b], stack = stack, []
        elif b == 28:
            stack.append(struct.unpack_from(">h", d, i)[0])
            i += 2
        elif b == 29:
            stack.append(struct.unpack_from(">i", d, i)[0])
            i += 4
        elif b == 30:
            while i < len(d) and d[i] & 15 != 15 and d[i] >> 4 != 15:
                i += 1
            i += 1
            stack.append(0.0)
        elif 32 <= b <= 246:
            stack.append(b - 139)
        elif b <= 254:
            stack.append((b - 247) * 256 + d[i] + 108 if b < 251 else -(b - 251) * 256 - d[i] - 108)
            i += 1
    return out


def _cff(d: bytes) -> dict[int, str] | None:
    if len(d) < 4 or d[0] != 1:
        raise BadFont
    _, at = _index(d, d[2])
    tops, at = _index(d, at)
    strings, _ = _index(d, at)
    if not tops:
        raise BadFont
    top = _top(d[tops[0][0] : tops[0][1]])
    if 1230 in top:
        return None
    code_at, set_at = (int((top.get(k) or [0])[0]) for k in (16, 15))
    if code_at == 1:
        return None
    if code_at == 0:
        return {}
    glyphs, _ = _index(d, int((top.get(17) or [0])[0]))
    n = len(glyphs)
    if code_at >= len(d) or code_at < 4:
        raise BadFont
    # charset: the name of each glyph
    if set_at == 0:
        sids = list(range(min(n, 229)))
    elif set_at in (1, 2):
        return None
    else:
        sids, p, kind = [0], set_at + 1, d[set_at]
        while len(sids) < n:
            if kind == 0:
                sids.append(struct.unpack_from(">H", d, p)[0])
                p += 2
            elif kind in (1, 2):
                first, left = struct.unpack_from(">HB" if kind == 1 else ">HH", d, p)
                p += 3 if kind == 1 else 4
                sids += range(first, first + min(left + 1, n - len(sids)))
            else:
                raise BadFont

    def name(sid: int) -> str:
        if sid < len(SHARED):
            return SHARED[sid]
        i = sid - 391
        return d[strings[i][0] : strings[i][1]].decode("latin-1") if 0 <= i < len(strings) else ""

    out, kind, p, glyph = {}, d[code_at] & 127, code_at + 2, 1
    for _ in range(d[code_at + 1]):
        if kind == 0:
            codes, p = [d[p]], p + 1
        elif kind == 1:
            codes, p = range(d[p], d[p] + d[p + 1] + 1), p + 2
        else:
            raise BadFont
        for code in codes:
            if code < 256 and glyph < len(sids):
                out[code] = name(sids[glyph])
            glyph += 1
    if d[code_at] & 128:
        for i in range(d[p]):
            code, sid = struct.unpack_from(">BH", d, p + 1 + 3 * i)
            out[code] = name(sid)
    return {k: v for k, v in out.items() if v}


def type1_encoding(head: bytes) -> dict[int, str]:
    """Code -> glyph name from the clear text of a Type 1 font."""
    return {int(a): b.decode("latin-1") for a, b in re.findall(rb"dup\s+(\d{1,3})\s*/([^\s/()<>\[\]{}%]+)\s+put", head) if int(a) < 256}
