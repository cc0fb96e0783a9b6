import random
import struct
import zlib

import pytest

from parchmill.kernel import bidi, crypto, filters, glyphs, objects, programs
from parchmill.kernel.objects import Ref


def test_values():
    got, _ = objects.parse(b"<< /Name /A#20B /Int 12 /Neg -3.5 /Ref 7 0 R /Arr [1 (two) <33>] /T true /N null % c\n/S (a(b)c) >>", 0)
    assert got == {"Name": "A B", "Int": 12, "Neg": -3.5, "Ref": Ref(7, 0), "Arr": [1, b"two", b"3"], "T": True, "N": None, "S": b"a(b)c"}
    assert objects.parse(b"<< /A 1 ) /B [1 2 > /C 3 >>", 0)[0]["A"] == 1


def test_filters():
    assert filters.ascii85(b"FCfN8~>") == b"test" and filters.ascii_hex(b"74 65 73 74>") == b"test"
    assert filters.run_length(b"\xfd\x61\x00\x62\x80", 99) == b"aaaab"
    assert filters.predicted(b"\x02\x01\x02\x03\x02\x01\x01\x01", {"Predictor": 12, "Columns": 3}) == b"\x01\x02\x03\x02\x03\x04"
    assert filters.predicted(b"\1\1\1\1", {"Predictor": 2, "Columns": 4}) == b"\1\2\3\4"
    data = random.Random(1).randbytes(3000) + b"text " * 2000
    packed = zlib.compress(data)
    got = filters.inflate(packed[:-500], 1 << 20)
    assert data.startswith(got) and len(got) > 2000
    assert filters.inflate(zlib.compress(data)[2:-4], 1 << 20) == data


def test_ciphers():
    assert crypto.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    key, block = bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert crypto.cbc_encrypt(key, block, bytes(16)).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert crypto.cbc_encrypt(bytes(range(32)), block, bytes(16)).hex() == "8ea2b7ca516745bfeafc49904b496089"
    data = random.Random(2).randbytes(160)
    assert crypto.cbc_decrypt(key, crypto.cbc_encrypt(key, data, key), key, padded=False) == data


def test_glyph_names():
    assert [glyphs.known(x) for x in ("Eacute", "f_f_i", "uni20AC", "a.sc", "g123", ".notdef", "Scaron", "alpha", "afii10017", "Lslash", "u1F600")] == ["É", "ffi", "€", "a", None, "", "Š", "α", "А", "Ł", "😀"]


@pytest.mark.parametrize(("name", "code", "want"), [("WinAnsiEncoding", 0x80, "€"), ("MacRomanEncoding", 0x8E, "é"), ("StandardEncoding", 0x27, "’"), ("StandardEncoding", 0xFB, "ß"), ("StandardEncoding", 0xE1, "Æ"), ("PDFDocEncoding", 0xA0, "€"), ("Symbol", 0x61, "α"), ("ZapfDingbats", 65, ""), ("MacRomanEncoding", 0xDB, "¤"), ("MacRomanEncoding", 0xF0, "")])
def test_encodings(name, code, want):
    assert glyphs.encoding(name)[code] == want and len(glyphs.encoding(name)) == 256


def test_ranges_match_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        rows = [(lo, lo + rng.randint(0, 20), i) for i in range(rng.randint(0, 15)) for lo in [rng.randint(0, 60)]]
        made = programs.Ranges(rows)
        for code in range(-2, 90):
            want = next((r for r in rows if r[0] <= code <= r[1]), None)
            assert made.find(code) == want


def test_cmap_ranges():
    made = programs.CMap(b"4 beginbfrange <0000> <0FFF> <0100> <0800> <17FF> <0200> <2000> <2FFF> <0300> <0020> <0022> <0061> endbfrange 1 beginbfchar <0010> <0058> endbfchar")
    assert [made.get(c) for c in (0x10, 0x20, 0x22, 0x40, 0x900, 0x1000, 0x2010, 0x1800)] == ["X", "a", "c", chr(0x140), chr(0xA00), chr(0xA00), chr(0x310), None]


def cmap_table(sub):
    return struct.pack(">HHHHI", 0, 1, 3, 1, 12) + sub


def test_truetype_cmap():
    sub = struct.pack(">HHHHHHH", 4, 32, 0, 4, 0, 0, 0) + struct.pack(">HH", 67, 0xFFFF) + b"\0\0" + struct.pack(">HH", 65, 0xFFFF) + struct.pack(">HH", (1 - 65) & 0xFFFF, 1) + struct.pack(">HH", 0, 0)
    table = cmap_table(sub)
    font = struct.pack(">IHHHH", 0x10000, 1, 0, 0, 0) + b"cmap" + struct.pack(">III", 0, 28, len(table)) + table
    assert programs.glyph_characters(font) == {1: 65, 2: 66, 3: 67}
    for n in range(len(font)):
        try:
            programs.glyph_characters(font[:n])
        except struct.error:
            pass


R = lambda s: s[::-1]
SHALOM, OLAM = "שלום", "עולם"


@pytest.mark.parametrize(
    ("drawn", "read"),
    [
        (R(OLAM) + " " + R(SHALOM), SHALOM + " " + OLAM),
        ("?" + R(SHALOM), SHALOM + "?"),
        ("2014 " + R("בשנת"), "בשנת" + " 2014"),
        ("12:50 " + R("בשעה") + " 2023-06-15 " + R("ביום"), "ביום" + " 2023-06-15 " + "בשעה" + " 12:50"),
        (R("בקובץ") + " Hello World " + R("כתוב"), "כתוב" + " Hello World " + "בקובץ"),
        (R("תקן") + " ISO 9001 " + R("לפי"), "לפי" + " ISO 9001 " + "תקן"),
        (")4()" + "ב" + "(15 " + R("סעיף"), "סעיף" + " 15(" + "ב" + ")(4)"),
        ("(4)(" + "ב" + ")15 " + R("סעיף"), "סעיף" + " 15(" + "ב" + ")(4)"),
        ("The word " + R(SHALOM) + " means peace", "The word " + SHALOM + " means peace"),
        ("ﻡﻼﺳ", "سلام"),
        ("١٢٣ مقر", "رقم ١٢٣"),
        (R("דהו") + " 50% " + R("אבג"), "אבג" + " 50% " + "דהו"),
        ("$5.00 " + R("דהו"), "דהו" + " $5.00"),
        ("٣٫٥ مقر", "رقم ٣٫٥"),
        ("Hello, world 42", "Hello, world 42"),
    ],
)
def test_reading_order(drawn, read):
    assert bidi.logical(drawn) == read
