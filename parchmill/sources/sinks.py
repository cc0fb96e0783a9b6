"""Where results go: text with a form feed after each page, JSON, Parquet; and what a run counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from parchmill.operators.layout import document_texts


def write_text(pages: DataFrame, keys: list[str], path: str, mode: str = "error") -> None:
    """One text file row a document: its pages in order, a form feed after every one. pages: (keys, page_no, text)."""
    whole = document_texts(pages.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("\f"))), keys, "")
    whole.select("text").write.mode(mode).option("lineSep", "\0").text(path)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def write_parquet(df: DataFrame, path: str, by: str | None = None, mode: str = "error") -> None:
    """Parquet, parted by a column of few values if one is named."""
    out = df.write.mode(mode)
    (out.partitionBy(by) if by else out).parquet(path)


def observed(pages: DataFrame, name: str = "pages") -> tuple[DataFrame, Observation]:
    """pages as they are, and an observation of the pages, characters and warnings that pass when an action runs."""
    seen = Observation(name)
    return pages.observe(seen, F.count(F.lit(1)).alias("pages"), F.sum(F.length("text")).alias("chars"), F.sum(F.size("warnings")).alias("warnings")), seen
