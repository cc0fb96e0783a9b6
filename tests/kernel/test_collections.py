import pytest

from parchmill.kernel import collections, document, writer
from parchmill.kernel.document import Options

KNOWN = {843: "あ", 1125: "亜", 7: "アパート", 9: "アパート", 11: "𠮷"}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "Japan1.bin").write_bytes(collections.written(KNOWN))
    (tmp_path / "GB1.bin").write_bytes(b"YCD1damaged")
    collections.loaded.cache_clear()
    return str(tmp_path)


def test_round_trip_and_damage(folder):
    made = collections.loaded(folder, "Japan1\0")
    assert dict(made.rows()) == KNOWN and made.get(0) is None and made.get(10**6) is None
    assert all(collections.loaded(folder, x) is None for x in ("GB1", "CNS1", "Japan2", "../Japan1", ""))
    data = collections.written(KNOWN)
    for n in range(len(data)):
        cut = collections.read(data[:n])
        assert cut is None or dict(cut.rows()) == KNOWN
    assert collections.merged({1: "a"}, {1: "b", 2: "c"}) == {1: "a", 2: "c"}


@pytest.mark.parametrize("extra", ["", "/ToUnicode 100 0 R"])
def test_a_font_without_a_map_is_read_from_its_collection(folder, extra):
    inner = "<< /Subtype /CIDFontType0 /DW 1000 /CIDSystemInfo << /Registry (Adobe) /Ordering (Japan1) /Supplement 2 >> >>"
    fonts = {"F1": f"/Subtype /Type0 /BaseFont /X /Encoding /Identity-H /DescendantFonts [{inner}] {extra}"}
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <034B> <0058> endbfchar"
    pdf = writer.build(["BT /F1 10 Tf 72 720 Td <034B0465> Tj ET"], fonts, {100: writer.stream(cmap)})
    text = [t for _, _, t in document.pages(pdf, Options(cid_tables=folder))]
    assert text == (["X"] if extra else ["あ亜"])
    if not extra:
        doc = document.Document(pdf, Options())
        assert [t for _, _, t in document.pages_of(doc)] == [""] and any("maps no code" in w for w in doc.pdf.notes.values())


def test_command_line(tmp_path, capsys):
    from parchmill.__main__ import main

    (tmp_path / "a.pdf").write_bytes(writer.from_text("one\ntwo", lines_a_page=1))
    (tmp_path / "b.pdf").write_bytes(b"nothing")
    assert main(["--stats", str(tmp_path / "a.pdf")]) == 0
    out = capsys.readouterr()
    assert out.out == "one\ftwo\f" and out.err.startswith("2 pages, ")
    assert main([str(tmp_path / "b.pdf"), str(tmp_path / "none.pdf")]) == 1
