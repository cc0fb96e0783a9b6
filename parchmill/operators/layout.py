"""Layout of runs with window functions: what SQL can say of lines and words.

It is exact for pages without accents drawn over letters, repeated fake-bold strings and right-to-left lines; the kernel's fold
takes these into account.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def glue(runs: DataFrame, keys: list[str], word_gap: float = 0.11, line_gap: float = 0.5) -> DataFrame:
    """runs (keys, seq, text, x, y, ux, uy, size, advance, hlen, source) with `glue`: what stands before each run."""
    w = Window.partitionBy(*keys).orderBy("seq")
    for c in ("x", "y", "ux", "uy", "size", "source", "text"):
        runs = runs.withColumn(f"_before_{c}", F.lag(c).over(w))
    ex, ey = (F.lag(F.col(c) + F.col(f"u{c}") * F.col("advance") * F.col("hlen")).over(w) for c in ("x", "y"))
    runs = runs.withColumn("_end_x", F.when(F.col("source") == F.col("_before_source"), ex).otherwise(-1e9)).withColumn("_end_y", F.when(F.col("source") == F.col("_before_source"), ey).otherwise(-1e9))
    dx, dy = F.col("x") - F.col("_end_x"), F.col("y") - F.col("_end_y")
    along, off, ref = dx * F.col("_before_ux") + dy * F.col("_before_uy"), F.abs(dy * F.col("_before_ux") - dx * F.col("_before_uy")), F.greatest("size", "_before_size")
    same_spot = (F.col("text") == F.col("_before_text")) & (F.abs(F.col("x") - F.col("_before_x")) + F.abs(F.col("y") - F.col("_before_y")) < 0.2 * ref)
    rule = (
        F.when(F.col("_before_x").isNull(), "")
        .when((off > line_gap * ref) | (F.col("ux") * F.col("_before_ux") + F.col("uy") * F.col("_before_uy") < 0.9), "\n")
        .when(along > word_gap * ref, " ")
        .when((along < -0.5 * ref) & same_spot, "drop")
        .when(along < -0.5 * ref, " ")
        .otherwise("")
    )
    return runs.withColumn("glue", rule).drop(*(f"_before_{c}" for c in ("x", "y", "ux", "uy", "size", "source", "text")), "_end_x", "_end_y")


def lines(glued: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_no, text): runs joined to lines."""
    w = Window.partitionBy(*keys).orderBy("seq")
    kept = glued.filter("glue <> 'drop'").withColumn("line_no", F.sum(F.when(F.col("glue") == "\n", 1).otherwise(0)).over(w))
    before = F.lag("text").over(w)
    space = (F.col("glue") == " ") & ~F.startswith("text", F.lit(" ")) & ~F.coalesce(F.endswith(before, F.lit(" ")), F.lit(False))
    piece = F.concat(F.when(space, " ").otherwise(""), "text")
    kept = kept.withColumn("_piece", piece)
    return kept.groupBy(*keys, "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "_piece"))), lambda p: p["_piece"]), "").alias("text"))


def page_texts(line_rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): lines joined to pages."""
    return line_rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda p: p["text"]), "\n").alias("text"))


def document_texts(pages: DataFrame, keys: list[str], separator: str = "\n\n") -> DataFrame:
    """(keys, text): pages joined in order, empty ones too."""
    return pages.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text")))), lambda p: p["text"]), separator).alias("text"))
