"""Cases of damage, annotations and ceilings, by built files."""

import zlib

import pytest

from parchmill.kernel import document, writer
from parchmill.kernel.document import Options

READ = "BT /F1 10 Tf 72 700 Td (still read) Tj ET"


def texts(pdf, **options):
    doc = document.Document(pdf, Options(**options))
    return [t for _, _, t in document.pages_of(doc)], list(doc.pdf.notes.values())


def xref_stream_file(head):
    """A page whose cross-reference stream has the given entries in place of the right ones."""
    pdf = writer.build([READ], modern=True)
    return pdf.replace(b"/W [1 4 2]", head) if len(head) else pdf


@pytest.mark.parametrize("head", [b"/W [0 0 0]", b"/W [1 9 9]", b"/W []", b"/W [1 4 2] /Index [0]", b"/W [-1 4 2]", b"/W [1 (x) 2]"])
def test_broken_cross_reference_stream(head):
    assert texts(xref_stream_file(head))[0] == ["still read"]


def test_table_without_a_catalog():
    pdf = writer.build([READ]).replace(b"/Root 1 0 R", b"/Root 9 0 R")
    got, notes = texts(pdf)
    assert got == ["still read"] and notes


def test_annotations():
    stamp = writer.stream(b"BT /F1 10 Tf (APPROVED) Tj ET", "/Type /XObject /Subtype /Form")
    link = writer.stream(b"BT /F1 10 Tf (LINK) Tj ET", "/Type /XObject /Subtype /Form")
    objects = writer.objects([b"BT /F1 10 Tf 72 700 Td (Body) Tj ET"], extra={200: stamp, 201: link})
    annots = b"/Annots [<< /Subtype /Stamp /Rect [100 500 200 520] /AP << /N 200 0 R >> >> << /Subtype /Link /Rect [0 0 9 9] /AP << /N 201 0 R >> >> << /Subtype /Stamp /F 2 /Rect [0 0 9 9] /AP << /N 201 0 R >> >> << /Subtype /Widget /AS /On /Rect [0 0 9 9] /AP << /N << /Off 201 0 R >> >> >>]"
    objects[30] = objects[30].replace(b"/Resources", annots + b" /Resources")
    pdf = writer.assembled(objects)
    assert texts(pdf)[0] == ["Body\nAPPROVED"]
    assert texts(pdf, annotations=False)[0] == ["Body"]


def test_streams_without_an_end():
    pdf = writer.build(["BT /F1 10 Tf 72 700 Td (one) Tj ET", "BT /F1 10 Tf 72 700 Td (two) Tj ET", "BT /F1 10 Tf 72 700 Td (three) Tj ET"])
    parts = pdf.split(b"\nendstream")
    pdf = parts[0] + parts[1] + parts[2] + b"\nendstream" + parts[3]
    import re

    pdf = re.sub(rb"/Length \d+", b"/Length 999", pdf)
    assert texts(pdf)[0] == ["one", "two", "three"]


def test_options():
    pdf = writer.build(["BT /F1 10 Tf 72 700 Td 12 TL (exam-) Tj T* (ple) Tj ET"])
    assert texts(pdf)[0] == ["example"] and texts(pdf, dehyphenate=False)[0] == ["exam-\nple"]
    pdf = writer.build(["BT /F1 10 Tf 72 700 Td (a) Tj 8 0 Td (b) Tj ET"])
    assert texts(pdf)[0] == ["a b"] and texts(pdf, word_gap=0.5)[0] == ["ab"]
    fonts = {"F1": "/Subtype /Type1 /BaseFont /X /Encoding << /Differences [1 /uniFB01] >>"}
    pdf = writer.build(["BT /F1 10 Tf (\\001x) Tj ET"], fonts)
    assert texts(pdf)[0] == ["fix"] and texts(pdf, expand_ligatures=False)[0] == ["ﬁx"]


def test_one_code_that_is_a_long_text():
    long = "0041" * 100
    cmap = f"1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfchar <41> <{long}> endbfchar".encode()
    fonts = {"F1": "/Subtype /Type1 /BaseFont /X /ToUnicode 100 0 R"}
    pdf = writer.build([b"BT /F1 1 Tf (" + b"A" * 20_000 + b") Tj ET"], fonts, {100: writer.stream(cmap)})
    got, notes = texts(pdf, memory_budget=4 << 20)
    assert len(got[0]) < 2_000_000 and any("half of memoryBudget" in n for n in notes)


def test_dense_content():
    pdf = writer.build([b"()Tj " * 230_000 + b"BT /F1 10 Tf (late) Tj ET"])
    got, notes = texts(pdf, memory_budget=8 << 20)
    assert got == [""] and any("more tokens than" in n for n in notes)
    assert texts(pdf, memory_budget=1 << 30)[0] == ["late"]


def test_drawing_is_stepped_over():
    lines = "".join(f"{i} {i} m {i + 1} {i} l S\n" for i in range(20_000))
    got, notes = texts(writer.build([lines + "BT /F1 10 Tf (vector page) Tj ET"]), memory_budget=8 << 20)
    assert got == ["vector page"] and not notes


def test_unclosed_inline_images():
    assert texts(writer.build(["BI /W 1 " * 8000 + "BT /F1 10 Tf (still readable) Tj ET"]))[0] == ["still readable"]


def test_many_warnings_are_capped():
    fonts = {f"F{i}": "/Subtype /Type0 /BaseFont /X%d /Encoding /Identity-H /DescendantFonts [<< >>]" % i for i in range(150)}
    objects = writer.objects([b"BT " + b" ".join(b"/F%d 1 Tf <0001> Tj" % i for i in range(150)) + b" ET"], fonts)
    # fonts are numbered from 10 on, over the pages' numbers: put the page elsewhere
    page, content = b"", b""
    names = " ".join(f"/F{i} {500 + i} 0 R" for i in range(150))
    objs = {1: objects[1], 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: f"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << {names} >> >> >>".encode(), 4: writer.stream(b"BT " + b" ".join(b"/F%d 1 Tf <0001> Tj" % i for i in range(150)) + b" ET")}
    objs |= {500 + i: f"<< /Type /Font {b} >>".encode() for i, b in enumerate(fonts.values())}
    _, notes = texts(writer.assembled(objs))
    assert len(notes) == 101 and notes[-1] == "Further warnings of this file are not kept"


def test_owner_password_and_wrong_password():
    pdf = writer.build(["BT /F1 10 Tf (kept) Tj ET"], encrypt=writer.lock("aes", "user"))
    assert document.about(pdf, Options()).status == "ENCRYPTED"
    assert texts(pdf, password="user")[0] == ["kept"] == texts(pdf, password="owner")[0]


def test_resources_are_inherited_and_circles_end():
    objs = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 2 0 R] /Count 9 /Resources << /Font << /F1 10 0 R >> >> >>", 3: b"<< /Type /Pages /Kids [4 0 R 5 0 R] >>", 4: b"<< /Type /Page /Contents 6 0 R >>", 5: b"<< /Type /Page /Contents [6 0 R 7 0 R] >>", 6: writer.stream(b"BT /F1 10 Tf 72 700 Td (first) Tj ET"), 7: writer.stream(b"BT /F1 10 Tf 72 600 Td (second) Tj ET"), 10: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"}
    assert texts(writer.assembled(objs))[0] == ["first", "first\nsecond"]
    assert document.about(writer.assembled(objs), Options()).page_count == 9


def test_large_object_streams_are_cut_by_the_budget():
    objs = writer.objects([READ.encode()]) | {i: b"<< /N %d >>" % i for i in range(100, 5100)}
    doc = document.Document(writer.assembled(objs, modern=True), Options(memory_budget=1 << 20))
    assert sum(isinstance(doc.pdf.get(i), dict) for i in range(100, 5100)) in range(3000, 3300)


def test_widths():
    fonts = {"F1": "/Subtype /Type0 /BaseFont /X /Encoding /Identity-H /DescendantFonts [<< /DW 1000 /W [0 1000 300 10 [500 510 520] 500 1500 400 40 45 777] >>]"}
    from parchmill.kernel.fonts import Fonts
    from parchmill.kernel.objects import Pdf

    pdf = Pdf(writer.build([READ], fonts))
    font = Fonts(pdf).load(__import__("parchmill.kernel.objects", fromlist=["Ref"]).Ref(10, 0))
    assert [font.width(c) / 1000 for c in (0, 10, 13, 40, 500, 1501)] == [0.3, 0.5, 0.3, 0.777, 0.4, 1.0]


def test_aes_256():
    """Revision 6, written here by the published algorithm."""
    import hashlib

    from parchmill.kernel import crypto

    key, salts = bytes(range(32)), (b"12345678", b"abcdefgh")
    user = crypto.hash_r6(b"pw", salts[0], b"", 6) + salts[0] + salts[1]
    wrapped = crypto.cbc_encrypt(crypto.hash_r6(b"pw", salts[1], b"", 6), key, bytes(16))
    data = b"BT /F1 10 Tf (modern secret) Tj ET"
    pad = 16 - len(data) % 16
    iv = hashlib.md5(b"iv").digest()
    body = iv + crypto.cbc_encrypt(key, data + bytes([pad]) * pad, iv)
    objs = writer.objects([data])
    objs[31] = writer.stream(body)
    told = f"/Filter /Standard /V 5 /R 6 /Length 256 /P -4 /O <{bytes(48).hex()}> /U <{user.hex()}> /UE <{wrapped.hex()}> /OE <{bytes(32).hex()}> /CF << /StdCF << /CFM /AESV3 >> >> /StmF /StdCF /StrF /StdCF"
    pdf = writer.assembled(objs, {"dict": told, "id": b"x" * 16, "stream": lambda n, b: b})
    assert texts(pdf, password="pw")[0] == ["modern secret"]
    assert document.about(pdf, Options(password="no")).status == "ENCRYPTED"
    assert zlib.crc32(key)


def test_objects_inside_of_streams_are_not_the_files():
    inner = writer.build(["BT /F1 10 Tf 72 700 Td (an attachment) Tj ET"])
    pdf = writer.build([READ], extra={200: writer.stream(inner, "/Type /EmbeddedFile")})
    got, notes = texts(pdf[: pdf.rindex(b"xref\n0 ")])
    assert got == ["still read"] and len(notes) == 1


@pytest.mark.parametrize("end", [b"\nendstream\nendobj", b"endstream\nendobj", b" endstream endobj", b"\nendobj", b" endobj", b"endstreamendobj"])
def test_ends_of_streams_without_their_length(end):
    pdf = writer.build([READ, READ.replace("still", "then")]).replace(b"/Length 4", b"/Length 1").replace(b"\nendstream\nendobj", end)
    got, notes = texts(pdf)
    assert got == ["still read", "then read"] and any("Length" in n for n in notes)
    right = writer.build([READ])
    assert texts(right) == (["still read"], [])
