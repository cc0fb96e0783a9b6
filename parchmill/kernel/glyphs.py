"""Characters of glyph names and of the simple encodings.

Most names follow a rule: the letter, then the accent, as the Unicode name has them. Only what no rule gives is
listed. A full list can be supplied as a file of `name;HEX HEX` lines, which then comes first.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: Names that don't follow from a rule.
SIGNS = """
space 20 exclam 21 quotedbl 22 numbersign 23 dollar 24 percent 25 quotesingle 27 parenleft 28 parenright 29 plus 2B
hyphen 2D period 2E slash 2F less 3C equal 3D greater 3E question 3F at 40 bracketleft 5B backslash 5C bracketright 5D
asciicircum 5E underscore 5F grave 60 braceleft 7B bar 7C braceright 7D asciitilde 7E exclamdown A1 cent A2
sterling A3 currency A4 yen A5 brokenbar A6 section A7 dieresis A8 copyright A9 ordfeminine AA guillemotleft AB
logicalnot AC softhyphen AD registered AE degree B0 plusminus B1 twosuperior B2 threesuperior B3 acute B4 mu B5
paragraph B6 periodcentered B7 onesuperior B9 ordmasculine BA guillemotright BB onequarter BC onehalf BD
threequarters BE questiondown BF AE C6 Eth D0 multiply D7 Thorn DE germandbls DF ae E6 eth F0 divide F7 thorn FE
dotlessi 131 OE 152 oe 153 florin 192 circumflex 2C6 dotaccent 2D9 ring 2DA tilde 2DC hungarumlaut 2DD endash 2013
emdash 2014 quoteleft 2018 quoteright 2019 quotesinglbase 201A quotedblleft 201C quotedblright 201D quotedblbase 201E
daggerdbl 2021 ellipsis 2026 perthousand 2030 guilsinglleft 2039 guilsinglright 203A fraction 2044 Euro 20AC
trademark 2122 minus 2212 partialdiff 2202 summation 2211 product 220F radical 221A approxequal 2248 notequal 2260
lessequal 2264 greaterequal 2265 Delta 2206 Omega 2126 arrowleft 2190 arrowup 2191 arrowright 2192 arrowdown 2193
arrowboth 2194 universal 2200 existential 2203 emptyset 2205 element 2208 notelement 2209 suchthat 220B
proportional 221D logicaland 2227 logicalor 2228 similar 223C congruent 2245 equivalence 2261 propersubset 2282
propersuperset 2283 reflexsubset 2286 reflexsuperset 2287 circleplus 2295 circlemultiply 2297 perpendicular 22A5
dotmath 22C5 nbspace 20 visiblespace 20 ellipsismath 22EF Lslash 141 lslash 142 Oslash D8 oslash F8 IJ 49,4A ij 69,6A
ff 66,66 fi 66,69 fl 66,6C ffi 66,66,69 ffl 66,66,6C sfthyphen 2D hyphenchar 2D dotlessj 237 ng 14B Ng 14A
circlecopyrt A9 bulletmath 2219 minusplus 2213 negationslash 2F mapsto 21A6 owner 220B triangle 25B3 ceilingleft 2308
ceilingright 2309 floorleft 230A floorright 230B bardbl 2016 latticetop 22A4 turnstileleft 22A2 turnstileright 22A3
similarequal 2243 lessmuch 226A greatermuch 226B follows 227B arrowdblboth 21D4 epsilon1 3F5 theta1 3D1 pi1 3D6
rho1 3F1 sigma1 3C2 phi1 3D5 vector 20D7 tie 2040 star 22C6 diamondmath 22C4 openbullet 25E6 angbracketleft 27E8
angbracketright 27E9 natural 266E sharp 266F flat 266D
"""
EMPTY = frozenset(["compwordmark", "cwm", "perthousandzero", ".notdef", ""])
ACCENTS = {"ACUTE": "acute", "GRAVE": "grave", "CIRCUMFLEX": "circumflex", "TILDE": "tilde", "DIAERESIS": "dieresis", "RING ABOVE": "ring", "CARON": "caron", "CEDILLA": "cedilla", "OGONEK": "ogonek", "MACRON": "macron", "BREVE": "breve", "DOT ABOVE": "dotaccent", "DOUBLE ACUTE": "hungarumlaut", "STROKE": "slash", "DOT BELOW": "dotbelow", "HOOK ABOVE": "hookabove", "HORN": "horn", "TONOS": "tonos", "DIALYTIKA": "dieresis", "COMMA BELOW": "commaaccent"}
GREEK = {"FINAL SIGMA": "sigma1", "LAMDA": "lambda"}


@lru_cache(maxsize=4)
def names(list_file: str | None = None) -> dict[str, str]:
    out: dict[str, str] = {}
    for cp in (*range(0x41, 0x5B), *range(0x61, 0x7B)):
        out[chr(cp)] = chr(cp)
    for cp in (*range(0x21, 0x100), *range(0x2C6, 0x2DE), *range(0x2020, 0x2040), *range(0x2200, 0x2300)):
        said = unicodedata.name(chr(cp), "").removeprefix("DIGIT ").lower()
        if said.isalpha():  # zero, comma, dagger, infinity
            out.setdefault(said, chr(cp))
    for cp in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0x370, 0x400), *range(0x5D0, 0x5EB)):
        said = unicodedata.name(chr(cp), "")
        if m := re.fullmatch(r"LATIN (CAPITAL|SMALL) LETTER ([A-Z]{1,2})(?: WITH (.+))?", said):
            letter = m[2] if m[1] == "CAPITAL" else m[2].lower()
            marks = [ACCENTS.get(x) for x in m[3].split(" AND ")] if m[3] else [""]
            if all(x is not None for x in marks):
                out.setdefault(letter + "".join(marks), chr(cp))
        elif m := re.fullmatch(r"GREEK (CAPITAL|SMALL) LETTER ([A-Z ]+?)(?: WITH ([A-Z ]+))?", said):
            marks = [ACCENTS.get(x) for x in reversed(m[3].split(" AND "))] if m[3] else [""]
            letter = GREEK.get(m[2], m[2].lower())
            if all(x is not None for x in marks):
                out.setdefault((letter.capitalize() if m[1] == "CAPITAL" else letter) + "".join(marks), chr(cp))
        elif m := re.fullmatch(r"HEBREW LETTER ([A-Z ]+)", said):
            out.setdefault(m[1].lower().replace(" ", ""), chr(cp))
            out.setdefault(f"afii{57664 + cp - 0x5D0}", chr(cp))
    for i in range(32):  # Cyrillic by the numbers of the old registry: capitals, then small letters, io after ie
        big, small = 0x410 + i, 0x430 + i
        out[f"afii{10017 + i + (i > 5)}"], out[f"afii{10065 + i + (i > 5)}"] = chr(big), chr(small)
    out["afii10023"], out["afii10071"] = "Ё", "ё"
    words = SIGNS.split()
    for name, hexes in zip(words[::2], words[1::2], strict=True):
        out[name] = "".join(chr(int(x, 16)) for x in hexes.split(","))
    if list_file:
        with open(list_file, encoding="ascii") as lines:
            for line in lines:
                if not line.startswith("#") and ";" in line:
                    name, _, codes = line.strip().partition(";")
                    out.setdefault(name, "".join(chr(int(x, 16)) for x in codes.split()))
    return out


def known(name: str, list_file: str | None = None) -> str | None:
    """The text of a glyph name, '' for one that stands for nothing, None for an unknown one."""
    table = names(list_file)
    if name in EMPTY:
        return ""
    if name in table:
        return table[name]
    stem = name.partition(".")[0]
    if stem != name:
        return known(stem, list_file) if stem else ""
    if "_" in name:
        parts = [known(p, list_file) for p in name.split("_")]
        return None if None in parts else "".join(parts)
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)", name):
        return "".join(character(int(m[1][i : i + 4], 16)) for i in range(0, len(m[1]), 4))
    if m := re.fullmatch(r"u([0-9A-F]{4,6})", name):
        return character(int(m[1], 16))
    return None


def character(cp: int) -> str:
    return chr(cp) if 0 <= cp < 0x110000 and not 0xD800 <= cp < 0xE000 else ""


# --- encodings: strings of the characters from a code on; a gap is U+0000 -----------------------

GAP = "\0"
#: StandardEncoding from A1, PDFDocEncoding from 80, and the letters and signs of Symbol.
STANDARD_A1 = "¡¢£⁄¥ƒ§¤'“«‹›ﬁﬂ\0–†‡·\0¶•‚„”»…‰\0¿\0`´ˆ˜¯˘˙¨\0˚¸\0˝˛ˇ—" + GAP * 16 + "Æ\0ª\0\0\0\0ŁØŒº\0\0\0\0\0æ\0\0\0ı\0\0łøœß"
DOCUMENT_80 = "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž\0€"
SYMBOL_AT = {0x41: "ΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ", 0x61: "αβχδεφγηιϕκλμνοπθρστυϖωξψζ", 0x22: "∀", 0x24: "∃", 0x27: "∋", 0x2D: "−", 0x40: "≅", 0x5C: "∴", 0x5E: "⊥", 0x7E: "∼", 0xA3: "≤", 0xA5: "∞", 0xB1: "±", 0xB3: "≥×∝∂•÷≠≡≈…", 0xD6: "√⋅", 0xE5: "∑", 0xF2: "∫"}


@lru_cache(maxsize=16)
def encoding(name: str) -> tuple[str, ...]:
    """The 256 characters of a simple encoding; '' where it has none."""
    t = [""] * 256
    if name == "ZapfDingbats":
        t[32] = " "
        return tuple(t)
    for i in range(32, 127):
        t[i] = chr(i)
    t[9] = t[10] = t[13] = " "

    def lay(at: int, text: str) -> None:
        for i, ch in enumerate(text):
            if ch != GAP:
                t[at + i] = ch

    if name == "MacRomanEncoding":
        roman = bytes(range(128, 256)).decode("mac_roman")
        lay(128, roman.replace("€", "¤").replace("\uf8ff", GAP))
    elif name == "StandardEncoding":
        lay(0x27, "’")
        lay(0x60, "‘")
        lay(0xA1, STANDARD_A1)
    elif name == "Symbol":
        for at, text in SYMBOL_AT.items():
            lay(at, text)
    elif name == "PDFDocEncoding":
        lay(0xA1, "".join(map(chr, range(0xA1, 0x100))))
        lay(0x80, DOCUMENT_80)
    else:
        lay(0xA0, "".join(map(chr, range(0xA0, 0x100))))
        for i in range(0x80, 0xA0):
            t[i] = bytes([i]).decode("cp1252", "ignore")
    return tuple(t)


#: TeX's text encodings where they differ from ASCII and Latin-1.
OT1 = {11: "ff", 12: "fi", 13: "fl", 14: "ffi", 15: "ffl", 16: "ı", 25: "ß", 26: "æ", 27: "œ", 28: "ø", 29: "Æ", 30: "Œ", 31: "Ø", 34: "”", 92: "“", 123: "–", 124: "—"}
CORK_80 = "ĂĄĆČĎĚĘĞĹĽŁŃŇŊŐŔŘŚŠŞŤŢŰŮŸŹŽŻĲİđ§ăąćčďěęğĺľłńňŋőŕřśšşťţűůÿźžżĳ¡¿£"
CORK_LOW = {16: "“", 17: "”", 18: "„", 19: "«", 20: "»", 21: "–", 22: "—", 25: "ı", 27: "ff", 28: "fi", 29: "fl", 30: "ffi", 31: "ffl", 0xD7: "Œ", 0xF7: "œ", 0xDF: "SS", 0xFF: "ß"}


@lru_cache(maxsize=1)
def cork() -> dict[int, str]:
    return {0x80 + i: ch for i, ch in enumerate(CORK_80)} | {i: chr(i) for i in range(0xC0, 0x100)} | CORK_LOW


#: Widths of the codes 32 to 126 in two standard fonts.
HELVETICA = [int(x) for x in "278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556 333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584".split()]
TIMES = [int(x) for x in "250 333 408 500 500 833 778 180 333 333 500 564 250 333 250 278 500 500 500 500 500 500 500 500 500 500 278 278 564 564 564 444 921 722 667 667 722 611 556 722 722 333 389 722 611 889 722 722 556 722 667 556 611 722 722 944 722 722 611 333 278 333 469 500 333 444 500 444 500 444 333 500 500 278 278 500 278 778 500 500 500 500 333 389 278 500 500 722 500 500 444 480 200 480 541".split()]
