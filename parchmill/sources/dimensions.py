"""The fixed tables of the kernel as DataFrames: small, and bounded by what they describe."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.kernel import bidi, collections, glyphs

ENCODINGS = ("WinAnsiEncoding", "MacRomanEncoding", "StandardEncoding", "PDFDocEncoding", "Symbol", "ZapfDingbats")


def encodings(spark: SparkSession) -> DataFrame:
    """(name, code, text) of the simple encodings."""
    return spark.createDataFrame([(n, i, t) for n in ENCODINGS for i, t in enumerate(glyphs.encoding(n)) if t], "name string, code int, text string")


def standard_widths(spark: SparkSession) -> DataFrame:
    """(font, code, width) of the standard fonts."""
    rows = [(font, 32 + i, float(w)) for font, ws in (("Helvetica", glyphs.HELVETICA), ("Times", glyphs.TIMES), ("Courier", [600] * 95)) for i, w in enumerate(ws)]
    return spark.createDataFrame(rows, "font string, code int, width double")


def glyph_names(spark: SparkSession, list_file: str | None = None) -> DataFrame:
    return spark.createDataFrame(sorted(glyphs.names(list_file).items()), "name string, text string")


def presentation_forms(spark: SparkSession) -> DataFrame:
    """(form, text): presentation forms and their letters, from Unicode's compatibility decompositions."""
    return spark.createDataFrame([(chr(k), v) for k, v in sorted(bidi.forms().items())], "form string, text string")


def collection(spark: SparkSession, path: str) -> DataFrame:
    """(ordering, cid, text) of the collection files under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path)

    @F.pandas_udf("array<struct<cid:int,text:string>>")
    def rows(content):
        found = (collections.read(bytes(b)) for b in content)
        return pd.Series([[{"cid": c, "text": t} for c, t in x.rows()] if x else [] for x in found])

    return files.select(F.regexp_extract("path", r"([^/]+)\.bin$", 1).alias("ordering"), F.inline(rows("content")))
