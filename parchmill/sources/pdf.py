"""PDF files as tables.

`files` and `stream_files` list files; `extract_pages`, `extract_runs`, `extract_documents` and `pdf_info` take any
DataFrame with a binary column. The kernel runs as an Arrow-fed pandas UDF under `inline`, so that Catalyst pushes filters
on the other columns to the scan and reads no column that isn't asked for. A row is a file; nothing is shuffled.

A damaged, locked or foreign file is a row with a status. mode: PERMISSIVE keeps such rows, DROPMALFORMED leaves them
out, FAILFAST raises. Nulls are INVALID. Ceilings follow from memoryBudget alone, so results don't depend on the executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.kernel import document
from parchmill.kernel.document import Options
from parchmill.sources.tables import small_batches

PAGES = "array<struct<page_no:int,text:string,warnings:array<string>>>"
RUN = "page_no int, seq int, text string, drawn string, x double, y double, ux double, uy double, size double, advance double, hlen double, glyphs int, rtl boolean, source string"
INFO = "status string, page_count int, is_encrypted boolean, info map<string,string>, warnings array<string>"
FILE = "path string, modificationTime timestamp, length long, content binary"


def options(**given) -> Options:
    """Options by the names of the reader: password, dehyphenate, expandLigatures, annotations, wordGap, memoryBudget, glyphList, cidTables (a folder)."""
    names = {"expandLigatures": "expand_ligatures", "wordGap": "word_gap", "memoryBudget": "memory_budget", "glyphList": "glyph_list", "cidTables": "cid_tables"}
    return Options(**{names.get(k, k): v for k, v in given.items()})


def files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """path, modificationTime, length, content of the files; content is only read if it is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def looks_like_pdf(content: Column) -> Column:
    """Whether the bytes have a PDF header at their start, or an object anywhere: a built-in filter ahead of the kernel."""
    return F.contains(F.substring(content, 1, 1024), F.lit(b"%PDF-")) | F.contains(content, F.lit(b" obj"))


def stream_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """The same as a stream of the files that arrive."""
    return spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", glob).load(path)


def _pages_udf(opts: Options, page_no: int | None):
    @F.pandas_udf(PAGES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for content in batches:
            out = []
            for data in content:
                doc, _ = document.opened(None if data is None else bytes(data), opts)
                rows = []
                if doc is not None:
                    said = 0
                    for number, _, text in document.pages_of(doc, page_no):
                        notes = list(doc.pdf.notes.values())
                        rows.append({"page_no": number, "text": text, "warnings": notes[said:]})
                        said = len(notes)
                out.append(rows)
            yield pd.Series(out)

    return run


def extract_pages(df: DataFrame, content: str = "content", page_no: int | None = None, **opts) -> DataFrame:
    """The other columns of df with page_no, text and warnings of each page; page_no reads one page, and steps over the others."""
    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c != content and c not in ("page_no", "text", "warnings")]
    return df.select(*keep, F.inline(_pages_udf(options(**opts), page_no)(F.col(content))))


def extract_pages_spread(df: DataFrame, key: str, content: str = "content", partitions: int | None = None, pages_each: int = 100, **opts) -> DataFrame:
    """(key, page_no, text) with the pages of one file read by many tasks, for files of thousands of pages.

    The first pass counts pages; then a file is sent and opened once for every `pages_each` of its pages, so this pays off where
    these cost more than the file's transfer.
    """
    chosen = options(**opts)

    @F.pandas_udf("array<struct<page_no:int,text:string>>")
    def some(contents: pd.Series, firsts: pd.Series, counts: pd.Series) -> pd.Series:
        out = []
        for data, first, count in zip(contents, firsts, counts, strict=True):
            doc, _ = document.opened(bytes(data), chosen)
            wanted = range(int(first), min(int(first) + pages_each, int(count) + 1))
            found = {n: t for n, _, t in document.pages_of(doc, wanted)} if doc else {}
            out.append([{"page_no": n, "text": found.get(n, "")} for n in wanted])
        return pd.Series(out)

    counted = pdf_info(df.select(key, content, F.col(content).alias("_c")), "_c", **opts).filter("status = 'OK' and page_count > 0")
    numbered = counted.select(key, content, "page_count", F.explode(F.sequence(F.lit(1), "page_count", F.lit(pages_each))).alias("_first"))
    numbered = numbered.repartition(partitions, key, "_first") if partitions else numbered.repartition(key, "_first")
    return numbered.select(key, F.inline(some(content, "_first", "page_count")))


def page_text(content: Column, page_no: int, **opts) -> Column:
    """The text of one page, '' beyond the last."""
    found = _pages_udf(options(**opts), page_no)(content)
    return F.coalesce(F.get(F.transform(found, lambda p: p["text"]), F.lit(0)), F.lit(""))


def extract_runs(df: DataFrame, content: str = "content", empty_pages: bool = False, **opts) -> DataFrame:
    """The other columns of df with every shown string and its place: the table that layout works on.

    empty_pages: a page without strings has a row too, with page_no alone.
    """
    chosen = options(**opts)
    fields = [f.split(" ", 1) for f in RUN.split(", ")]

    @F.pandas_udf("array<struct<" + ",".join(f"{n}:{t}" for n, t in fields) + ">>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from parchmill.kernel.fonts import RTL

        for series in batches:
            out = []
            for data in series:
                rows = []
                for number, runs, _ in document.pages(None if data is None else bytes(data), chosen):
                    rows += [{"page_no": number, "seq": i, "text": r.text, "drawn": r.drawn, "x": r.x, "y": r.y, "ux": r.ux, "uy": r.uy, "size": r.size, "advance": r.advance, "hlen": r.hlen, "glyphs": r.glyphs, "rtl": bool(RTL.search(r.text)), "source": r.source} for i, r in enumerate(runs)]
                    if empty_pages and not runs:
                        rows.append(dict.fromkeys((n for n, _ in fields)) | {"page_no": number})
                out.append(rows)
            yield pd.Series(out)

    small_batches(df.sparkSession)
    taken = {n for n, _ in fields}
    return df.select(*[c for c in df.columns if c != content and c not in taken], F.inline(run(F.col(content))))


def _told(df: DataFrame, content: str, chosen: Options, whole: bool, separator: str, mode: str) -> DataFrame:
    # A function of a batch, not of an iterator: Spark runs it in the Python worker of the function that writes `content`, if there is one,
    # so a task has one worker, and files that are made only to be read never go through the JVM.
    @F.pandas_udf("status string, page_count int, is_encrypted boolean, info map<string,string>, warnings array<string>" + ", text string" * whole)
    def run(series: pd.Series) -> pd.DataFrame:
        rows = []
        for data in series:
            data = None if data is None else bytes(data)
            if whole:
                doc, result = document.opened(data, chosen)
                text = ""
                if doc is not None:
                    try:
                        result.page_count, result.info = doc.page_count(), doc.info()
                    except document.BROKEN:
                        pass
                    text = separator.join(t for _, _, t in document.pages_of(doc))
                    result.warnings = list(doc.pdf.notes.values())
            else:
                result, text = document.about(data, chosen), ""
            if mode == "FAILFAST" and result.status != "OK":
                raise ValueError(f"a file is {result.status}")
            rows.append((result.status, result.page_count, result.encrypted, result.info, result.warnings, text))
        frame = pd.DataFrame(rows, columns=["status", "page_count", "is_encrypted", "info", "warnings", "text"])
        return frame if whole else frame.drop(columns="text")

    small_batches(df.sparkSession)
    names = ["status", "page_count", "is_encrypted", "info", "warnings", *(["text"] if whole else [])]
    keep = [c for c in df.columns if c != content and c not in names]
    # The explode keeps filters on what is told from running the function twice; a select of its own lets the function meet the one it reads from.
    out = df.select(*keep, run(F.col(content)).alias("_d")).select(*keep, F.explode(F.array("_d")).alias("_d")).select("*", "_d.*").drop("_d")
    return out.filter("status = 'OK'") if mode == "DROPMALFORMED" else out


def pdf_info(df: DataFrame, content: str = "content", mode: str = "PERMISSIVE", **opts) -> DataFrame:
    """The other columns of df with status, page_count, is_encrypted, info and warnings; no page is read."""
    return _told(df, content, options(**opts), False, "", mode)


def extract_documents(df: DataFrame, content: str = "content", separator: str = "\n\n", mode: str = "PERMISSIVE", **opts) -> DataFrame:
    """pdf_info and the whole text, pages joined by the separator, empty ones too."""
    return _told(df, content, options(**opts), True, separator, mode)


def spread(df: DataFrame) -> DataFrame:
    """df in at least two tasks a core: reading a PDF costs far more than moving it, and a scan of one small file is one task."""
    small_batches(df.sparkSession)
    wanted = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def synthetic(docs: DataFrame, text: str = "text", packing: str = "flate", lines_a_page: int = 50, **more) -> DataFrame:
    """docs with its text column turned into a PDF in `content`."""
    @F.pandas_udf("binary")
    def write(series: pd.Series) -> pd.Series:
        from parchmill.kernel import writer

        return series.map(lambda t: writer.from_text(t or "", packing, lines_a_page, **more))

    return spread(docs).withColumn("content", write(F.col(text))).drop(text)


def styled(docs: DataFrame, text: str = "text", face: str = "differences", drawing: str = "plain", damage: Column | None = None, **more) -> DataFrame:
    """The same through a kind of font, a way of drawing and a state of the file: see `kernel.styles`."""
    @F.pandas_udf("binary")
    def write(series: pd.Series, states: pd.Series) -> pd.Series:
        from parchmill.kernel import styles

        return pd.Series([styles.pdf_of(t or "", face, drawing, damage=None if s is None or s != s else s, **more) for t, s in zip(series, states, strict=True)])

    return spread(docs).withColumn("content", write(F.col(text), F.lit(None).cast("string") if damage is None else damage)).drop(text)


def register(spark: SparkSession) -> None:
    """SQL names: functions pdf_info, pdf_page_count, pdf_text, bidi_logical, glyph_to_unicode, nfkc; tables pdf_pages, pdf_runs."""
    from pyspark.sql.functions import udtf

    from parchmill.functions import text as text_functions

    chosen = Options()

    @F.pandas_udf("map<string,string>")
    def info(series: pd.Series) -> pd.Series:
        return series.map(lambda d: document.about(None if d is None else bytes(d), chosen).info)

    @F.pandas_udf("int")
    def count(series: pd.Series) -> pd.Series:
        return series.map(lambda d: document.about(None if d is None else bytes(d), chosen).page_count)

    @F.pandas_udf("string")
    def whole(series: pd.Series) -> pd.Series:
        return series.map(lambda d: "\n\n".join(t for _, _, t in document.pages(None if d is None else bytes(d), chosen)))

    class Pages:
        def eval(self, content: bytes):
            for number, _, text in document.pages(content, chosen):
                yield number, text

    class Runs:
        def eval(self, content: bytes):
            for number, runs, _ in document.pages(content, chosen):
                for i, r in enumerate(runs):
                    yield number, i, r.text, r.x, r.y, r.size, r.source

    for name, f in (("pdf_info", info), ("pdf_page_count", count), ("pdf_text", whole), ("bidi_logical", text_functions.bidi_udf()), ("glyph_to_unicode", text_functions.glyph_udf()), ("nfkc", text_functions.nfkc_udf())):
        spark.udf.register(name, f)
    spark.udtf.register("pdf_pages", udtf(Pages, returnType="page_no int, text string"))
    spark.udtf.register("pdf_runs", udtf(Runs, returnType="page_no int, seq int, text string, x double, y double, size double, source string"))
