import pandas as pd
import pytest
from pyspark.sql import functions as F

from parchmill.kernel import writer
from parchmill.operators import layout
from parchmill.sources import pdf
from parchmill.streaming import pdf as streaming


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    where = tmp_path_factory.mktemp("files")
    for i in range(6):
        (where / f"{i}.pdf").write_bytes(writer.from_text(f"Page one of {i}\nmore\nPage two of {i}", "flate", 2))
    (where / "bad.pdf").write_bytes(b"no document at all")
    (where / "locked.pdf").write_bytes(writer.build(["BT ET"], encrypt=writer.lock("rc4", "secret")))
    (where / "notes.txt").write_text("not listed")
    return str(where)


def name(df):
    return df.withColumn("name", F.element_at(F.split("path", "/"), -1))


def test_pages_of_files(spark, folder):
    got = {(r.name, r.page_no): r.text for r in name(pdf.extract_pages(pdf.files(spark, folder))).collect()}
    assert len(got) == 12 and got["3.pdf", 1] == "Page one of 3\nmore" and got["3.pdf", 2] == "Page two of 3"


def test_status_and_modes(spark, folder):
    files = pdf.files(spark, folder)
    got = {r.name: r for r in name(pdf.pdf_info(files)).collect()}
    assert {k: v.status for k, v in got.items() if v.status != "OK"} == {"bad.pdf": "INVALID", "locked.pdf": "ENCRYPTED"}
    assert got["0.pdf"].page_count == 2
    assert pdf.extract_documents(files, mode="DROPMALFORMED").count() == 6
    with pytest.raises(Exception, match="INVALID|ENCRYPTED"):
        pdf.extract_documents(files, mode="FAILFAST").collect()
    assert {r.name: r.status for r in name(pdf.pdf_info(files, password="secret")).collect()}["locked.pdf"] == "OK"


def test_filters_reach_the_scan_and_content_is_pruned(spark, folder):
    plan = pdf.extract_pages(pdf.files(spark, folder)).filter("length > 3")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(length,3)" in plan
    assert "content" not in pdf.files(spark, folder).select("path")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_stream_equals_batch(spark, folder, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    streaming.run_once(streaming.page_stream(spark, folder), out, state)
    streaming.run_once(streaming.page_stream(spark, folder), out, state)
    want = sorted(map(tuple, pdf.extract_pages(pdf.files(spark, folder)).select("path", "page_no", "text").collect()))
    assert sorted(map(tuple, spark.read.parquet(out).select("path", "page_no", "text").collect())) == want


def test_sql_names(spark, folder):
    pdf.register(spark)
    pdf.files(spark, folder).createOrReplaceTempView("pdf_files")
    assert spark.sql("select page_no, text from pdf_files, lateral pdf_pages(content) where path like '%/2.pdf' order by page_no").collect()[1].text == "Page two of 2"
    assert spark.sql("select pdf_page_count(content) n, pdf_text(content) t from pdf_files where path like '%/1.pdf'").first().n == 2
    assert spark.sql("select count(*) n from pdf_files, lateral pdf_runs(content)").first().n == 18
    assert spark.sql("select glyph_to_unicode('Eacute') g, nfkc('ﬁ') k, bidi_logical('abc') b").first().asDict() == {"g": "É", "k": "fi", "b": "abc"}


def test_windows_equal_the_fold(spark):
    content = "BT /F1 10 Tf 72 700 Td (one) Tj 40 0 Td (two) Tj (same) Tj -40 -14 Td (three ) Tj 30 0 Td (four) Tj 1 0 0 1 72 500 Tm (bold) Tj 1 0 0 1 72 500 Tm (bold) Tj ET"
    df = spark.createDataFrame([(1, bytearray(writer.build([content])))], "id long, content binary")
    runs = pdf.extract_runs(df)
    keys = ["id", "page_no"]
    text = layout.page_texts(layout.lines(layout.glue(runs, keys), keys), keys).first().text
    assert text == pdf.extract_pages(df).first().text


def test_one_page_beyond_the_last(spark):
    df = spark.createDataFrame([(bytearray(writer.from_text("a\nb", lines_a_page=1)),), (None,)], "content binary")
    assert sorted(r.t for r in df.select(pdf.page_text(F.col("content"), 2).alias("t")).collect()) == ["", "b"]
    assert [r.t for r in df.select(pdf.page_text(F.col("content"), 0).alias("t")).collect()] == ["", ""]


def test_pages_spread_over_tasks(spark, folder):
    files = pdf.files(spark, folder)
    want = sorted(map(tuple, pdf.extract_pages(files).select("path", "page_no", "text").collect()))
    assert sorted(map(tuple, pdf.extract_pages_spread(files, "path", partitions=4).collect())) == want


def test_dimensions(spark, tmp_path):
    from parchmill.kernel import collections
    from parchmill.sources import dimensions

    (tmp_path / "KR.bin").write_bytes(collections.written({5000: "꺪"}))
    assert dimensions.collection(spark, str(tmp_path)).collect() == [("KR", 5000, "꺪")]
    assert dimensions.encodings(spark).filter("name = 'WinAnsiEncoding' and code = 128").first().text == "€"
    assert dimensions.standard_widths(spark).filter("font = 'Helvetica' and code = 32").first().width == 278
    assert dimensions.presentation_forms(spark).filter("form = 'ﻟ'").first().text == "ل"
    assert dimensions.glyph_names(spark).filter("name = 'Eacute'").first().text == "É"


def test_sinks_and_observation(spark, folder, tmp_path):
    from parchmill.sources import sinks

    pages = name(pdf.extract_pages(pdf.files(spark, folder)))
    seen, told = sinks.observed(pages)
    sinks.write_parquet(seen, str(tmp_path / "parquet"), by="page_no")
    assert told.get["pages"] == 12 and spark.read.parquet(str(tmp_path / "parquet")).filter("page_no = 2").count() == 6
    sinks.write_text(pages, ["name"], str(tmp_path / "text"))
    rows = [r.value for r in spark.read.option("lineSep", "\0").text(str(tmp_path / "text")).collect()]
    assert "Page one of 0\nmore\fPage two of 0\f" in rows and len(rows) == 6
    sinks.write_json(pages.select("name", "text"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 12


def test_sniff(spark, folder):
    got = {r.name: r.ok for r in name(pdf.files(spark, folder)).select("name", pdf.looks_like_pdf(F.col("content")).alias("ok")).collect()}
    assert not got["bad.pdf"] and got["0.pdf"] and got["locked.pdf"]


def drawn_in_batches(spark, **how):
    """Bytes of text that the writer gets at once, and of files that the reader gets at once."""
    from pyspark.sql import functions as F

    @F.pandas_udf("long")
    def at_once(series: pd.Series) -> pd.Series:
        return pd.Series([int(series.str.len().sum())] * len(series))

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    line = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(9)), lambda k: F.md5(F.concat(F.col("doc_id").cast("string"), k.cast("string")))))
    docs = spark.range(300, numPartitions=1).withColumnRenamed("id", "doc_id").withColumn("text", F.array_join(F.array_repeat(line, 120), "\n"))
    made = pdf.styled(docs, **{k: F.lit(v) if k == "damage" else v for k, v in how.items()})
    files = made.coalesce(1).select("doc_id", at_once("content").alias("n")).agg(F.max("n"), F.count("n")).first()
    texts = docs.select(at_once("text").alias("n")).agg(F.max("n")).first()
    return files, texts[0], docs.count()


STYLED = {
    "pdf_font_widths": {"face": "widths", "drawing": "spaced"},
    "pdf_draw_accented": {"drawing": "accented"},
    "pdf_draw_kerned": {"face": "truetype", "drawing": "kerned"},
    "pdf_font_blanks": {"face": "blanks"},
    "pdf_draw_annotated": {"face": "truetype", "drawing": "annotated"},
    "pdf_font_cff": {"face": "cff"},
    "pdf_font_ligatures": {"face": "ligatures"},
    "pdf_font_type3": {"face": "type3"},
    "pdf_damaged": {"damage": "lengths"},
    "pdf_draw_forms": {"face": "truetype", "drawing": "forms"},
    "pdf_font_differences": {"face": "differences"},
    "pdf_font_truetype": {"face": "truetype"},
}


@pytest.mark.parametrize("name", STYLED)
def test_files_go_to_python_by_bytes(spark, name):
    (files, n), texts, all_rows = drawn_in_batches(spark, **STYLED[name])
    assert n == all_rows and texts < 5 << 20 and files < 6 << 20


#: Queries that make files only to read them.
IN_ONE_WORKER = ["pdf_draw_accented", "pdf_draw_kerned", "pdf_font_blanks", "pdf_draw_annotated", "pdf_font_cff", "pdf_font_ligatures", "pdf_font_type3", "pdf_damaged", "pdf_draw_forms", "pdf_font_differences", "pdf_font_truetype"]


@pytest.mark.parametrize("name", IN_ONE_WORKER)
def test_files_are_read_in_the_worker_that_makes_them(spark, name):
    from parchmill.plans import queries

    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1


def test_told_of_files_without_rows_or_content(spark):
    files = spark.createDataFrame([(1, None), (2, bytearray(b"none"))], "id int, content binary")
    found = pdf.extract_documents(files)
    assert sorted((r.id, r.status, r.page_count, r.text) for r in found.collect()) == [(1, "INVALID", 0, ""), (2, "INVALID", 0, "")]
    assert found.filter("id = 2 and status = 'INVALID'").select("id").collect()[0].id == 2
    assert pdf.extract_documents(files.limit(0)).count() == 0 and pdf.pdf_info(files, mode="DROPMALFORMED").count() == 0


@pytest.mark.parametrize("name", IN_ONE_WORKER[1:])
def test_letters_cost_no_call_each(name):
    """Files are made and read by strings, not letter by letter. Kerned arrays are cut every few letters."""
    import cProfile

    from parchmill.kernel import document, styles

    text = "\n".join(f"Line {i} of a text of some words, some of which (these) are odd: office, x\\y, öäü." * 25 for i in range(16))

    def both():
        return [t for _, _, t in document.pages(styles.pdf_of(text, **STYLED[name]), document.Options())]

    assert both() == [text]
    profile = cProfile.Profile()
    profile.runcall(both)
    assert sum(s.callcount for s in profile.getstats()) < (12 if name == "pdf_draw_kerned" else 1) * len(text)


def test_escapes_and_arrays_of_numbers():
    from parchmill.kernel.objects import Ref, parse, unescaped

    assert unescaped(rb"\134000\050\101b") == b"\\000(Ab"
    assert unescaped(rb"\534\1\12a\\0\n\x" + b"\\\r\n\\\n\\\\\\") == b"\\\x01\na\\0\nx\\"
    assert parse(b"[1 20  3 ]x", 0) == ([1, 20, 3], 10) and parse(b"[1 0 R 2]", 0)[0] == [Ref(1, 0), 2]
    assert parse(b"[ ]", 0)[0] == [] and parse(b"[1 2 3 4]", 0, [2]) == ([1, 2], 6)


def shown(content: bytes) -> list[tuple]:
    """The runs of a page of its own content in a font of two-byte codes."""
    from parchmill.kernel import content as drawn
    from parchmill.kernel import document, styles

    doc = document.Document(styles.pdf_of("abcdef", "truetype"), document.Options())
    _, resources = next(doc.walk())
    page = drawn.Page(doc.pdf, doc.fonts)
    page.execute(b"/F1 10 Tf " + content, resources)
    return [tuple(r) for r in page.runs]


def test_arrays_of_hex_are_read_at_once():
    """A space in a hex string sends an array the longer way, which must show the same."""
    from parchmill.kernel.content import MOST_OPERANDS, TOKEN

    for inner in (b"<0001> 8 <0002>-420<0003>", b"<0001>5-6<> 300 <00020003> -900 -900", b"", b"7", b"<0001> 1.2.3 <0002>", b"-300<0001>200 201<0002>" * 9):
        long = b"[" + inner + b"<0 >]"
        short = b"[" + inner + b"<00>]"
        assert shown(b"1 0 0 1 7 9 Tm " + short + b" TJ <0004> Tj") == shown(b"1 0 0 1 7 9 Tm " + long + b" TJ <0004> Tj")
    assert shown(b"[[<0001>] TJ <0002> Tj")[0][0] == "a" and shown(b"[<0001> 1 0 0 1 5 5 Tm <0002>] TJ")[0][0] == "ab"
    many = b"[" + b"1 " * (MOST_OPERANDS - 1) + b"<0001><0002>] TJ"
    assert [r[0] for r in shown(many)] == ["a"]
    assert shown(b"3 4 Tm <0001> Tj")[0][2:4] == (0, 0) and shown(b"9 1 0 0 1 7 8 Tm <0001> Tj")[0][2:4] == (7, 8)
    assert sum(1 for _ in TOKEN.finditer(b"1 0 0 1 72 800 Tm [" + b"<0001> 8 " * 99 + b"] TJ")) <= 4


def test_tokens_of_arrays_count_against_the_budget():
    """An array that is read at once weighs as its strings, numbers and brackets do."""
    from parchmill.kernel.content import TOKEN, tokens

    assert sum(map(tokens, TOKEN.finditer(b"1 0 0 1 72 800 Tm [<0001> 8 <0002>-420<>] TJ /F1 (a) <<>> 0 0 1 rg"))) == 17
