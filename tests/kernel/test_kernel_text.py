import random

import pytest

from parchmill.kernel import document, writer
from parchmill.kernel.document import Options


def text_of(pdf, sep="\n\n", **options):
    return sep.join(t for _, _, t in document.pages(pdf, Options(**options)))


def one(content, **kw):
    return text_of(writer.build([content], **kw))


TJ = "BT /F1 10 Tf 72 700 Td {} ET"
CMAP = b"""1 begincodespacerange <00> <FF> endcodespacerange
2 beginbfchar <41> <0416> <42> <00660069> endbfchar
2 beginbfrange <43> <45> <0061> <50> <51> [<0031> <0032>] endbfrange
beginbfrange <zz garbage endbfrange"""


@pytest.mark.parametrize(
    ("content", "want"),
    [
        ("[(W)80(or)-15(ld)-300(pe)10(ace)] TJ", "World peace"),
        ("12 TL (An exam-) Tj T* (ple of text) Tj T* (Next line) Tj", "An example of text\nNext line"),
        (r"(a \(nested\) \101\\) Tj <20486921> Tj", "a (nested) A\\ Hi!"),
        ("[(caf\264)333(e)] TJ", "café"),
        ("12 TL (the end) Tj 0 -12 Td [(\264)333(ecole is out)] TJ", "the end\nécole is out"),
        ("(te) Tj BI /W 1 ID \x00(Tj\xff EI (xt) Tj", "text"),
        (" ".join(["1"] * 8000) + " m (path) Tj", "path"),
        ("(bold) Tj 1 0 0 1 72 700 Tm (bold) Tj", "bold"),
        ("(one) Tj 40 0 Td (two) Tj -40 -14 Td (three) Tj", "one two\nthree"),
    ],
)
def test_content(content, want):
    assert one(TJ.format(content)) == want


@pytest.mark.parametrize(
    ("drawn", "want"),
    [
        ([("a", 72), ("a", 72.3)], "a"),
        ([("i", 72), ("i", 72.3)], "i"),
        ([("^", 72), ("^", 72.3)], "^"),
        ([("a^", 72), ("a^", 72.3)], "a^"),
        ([("i", 72), ("i", 74.22)], "ii"),
        ([("i", 72), ("i", 73.8)], "ii"),
        ([("ab", 72), ("ac", 72.3)], "ab ac"),
    ],
)
def test_short_texts_drawn_twice(drawn, want):
    """Helvetica's i is 2.22 wide at this size, a 5.56: two in a row are no echo, even a little tight."""
    assert one("BT /F1 10 Tf " + " ".join(f"1 0 0 1 {x} 700 Tm ({t}) Tj" for t, x in drawn) + " ET") == want


def test_positions():
    assert one("BT /F1 10 Tf 1 0 0 1 72 700 Tm (Hello) Tj 1 0 0 1 99.78 700 Tm (wor) Tj 1 0 0 1 113.67 700 Tm (ld) Tj ET") == "Hello world"


def test_two_pages_and_count():
    pdf = writer.build(["BT /F1 12 Tf (Hello world) Tj ET", "BT /F1 12 Tf (Second page) Tj ET"])
    assert [(n, t) for n, _, t in document.pages(pdf, Options())] == [(1, "Hello world"), (2, "Second page")]
    assert [(n, t) for n, _, t in document.pages(pdf, Options(), only=2)] == [(2, "Second page")]
    assert list(document.pages(pdf, Options(), only=9)) == []
    assert document.about(pdf, Options()).page_count == 2


def test_to_unicode_and_differences():
    fonts = {"F1": "/Subtype /Type1 /BaseFont /X /ToUnicode 100 0 R"}
    assert one(TJ.format("(ABCDEPQ) Tj"), fonts=fonts, extra={100: writer.stream(CMAP)}) == "Жfiabc12"
    fonts = {"F1": "/Subtype /Type1 /BaseFont /X /Encoding << /Differences [1 /Eacute /f_f_i] >>"}
    assert one(TJ.format("(\\001\\002x) Tj"), fonts=fonts) == "Éffix"


def test_composite_font_and_undeclared_compression():
    import zlib

    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <65E5> <0002> <672C> endbfchar"
    fonts = {"F1": "/Subtype /Type0 /BaseFont /X /Encoding /Identity-H /ToUnicode 100 0 R /DescendantFonts [<< /DW 1000 >>]"}
    for data in (cmap, zlib.compress(cmap)):
        assert one(TJ.format("<00010002> Tj"), fonts=fonts, extra={100: writer.stream(data)}) == "日本"


def test_form():
    form = writer.stream(b"BT /F1 10 Tf (inside form) Tj ET", "/Type /XObject /Subtype /Form /BBox [0 0 9 9]")
    assert one("BT /F1 10 Tf 72 700 Td (page) Tj ET q 1 0 0 1 72 600 cm /Fm1 Do Q", extra={96: form}) == "page\ninside form"


def test_gap_glyph():
    widths = " ".join(["250"] + ["500"] * 94)
    fonts = {"F1": f"/Subtype /Type1 /BaseFont /X /FirstChar 2 /Widths [250 {' '.join(['0'] * 29)} {widths}]"}
    assert one(TJ.format("(Perceived\\002Ease\\002of\\002Use) Tj"), fonts=fonts) == "Perceived Ease of Use"


@pytest.mark.parametrize("packing", list(writer.PACKINGS))
@pytest.mark.parametrize("modern", [False, True])
def test_round_trip(packing, modern):
    text = "First line, with ümlauts\nand 漢字 too\n\nlast (line) \\ of three"
    pdf = writer.from_text(text, packing, modern=modern)
    assert text_of(pdf) == "First line, with ümlauts\nand 漢字 too\nlast (line) \\ of three"


@pytest.mark.parametrize("kind", ["rc4", "aes"])
def test_encrypted_round_trip(kind):
    pdf = writer.from_text("secret text", encrypt=kind)
    assert text_of(pdf) == "secret text" and document.about(pdf, Options()).encrypted


def test_damage():
    pdf = writer.build([TJ.format("(still read) Tj")])
    bad = pdf[: pdf.rindex(b"startxref")] + b"startxref\n999999\n%%EOF"
    assert text_of(bad) == "still read" and document.about(bad, Options()).warnings
    assert text_of(pdf[: pdf.index(b"xref\n0")]) == "still read"
    assert text_of(pdf.replace(b"/Length 4", b"/Length 3")) == "still read"
    assert document.about(b"just some text", Options()).status == "INVALID"
    assert document.about(None, Options()).status == "INVALID"


def test_info():
    pdf = writer.build([TJ.format("(x) Tj")], info="<< /Title ( A title ) /Author <FEFF00C9> /Pages 3 >>")
    assert document.about(pdf, Options()).info == {"Title": "A title", "Author": "É"}


def test_ceilings():
    small = Options(memory_budget=4 << 20)
    import zlib

    bomb = writer.stream(zlib.compress(b" " * (8 << 20)), "/Filter /FlateDecode")
    pdf = writer.build([TJ.format("(fine) Tj")] * 2)
    objs = writer.objects([b"", TJ.format("(fine) Tj").encode()])
    objs[31] = bomb
    pdf = writer.assembled(objs)
    doc = document.Document(pdf, small)
    assert [t for _, _, t in document.pages_of(doc)] == ["", "fine"]
    assert sum("unpacks to more than" in w for w in doc.pdf.notes.values()) == 1
    forms = {96 + i: writer.stream(b"/Fm%d Do " % (i + 2) * 3 if i < 11 else b"BT /F1 1 Tf (x) Tj ET", "/Subtype /Form") for i in range(12)}
    doc = document.Document(writer.build(["/Fm1 Do"], extra=forms), Options())
    list(document.pages_of(doc))
    assert sum("Forms past the ceiling" in w for w in doc.pdf.notes.values()) == 1


def test_never_raises():
    rng = random.Random(7)
    for pdf in (writer.from_text("Some text\nof two lines", "flate", modern=True), writer.build([TJ.format("[(W)80(or)] TJ")]), writer.from_text("x y", encrypt="aes")):
        for n in range(0, len(pdf), 7):
            list(document.pages(pdf[:n], Options()))
            document.about(pdf[:n], Options())
        for _ in range(250):
            bad = bytearray(pdf)
            for _ in range(rng.randint(1, 6)):
                bad[rng.randrange(len(bad))] = rng.randrange(256)
            list(document.pages(bytes(bad), Options()))
            document.about(bytes(bad), Options())
