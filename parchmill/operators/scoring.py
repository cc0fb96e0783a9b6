"""Word bags and how well one recovers another: DataFrame operations; only texts that have to be normalised pass through Python."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmill.functions.text import is_normal, words


def tokens(df: DataFrame, keys: list[str], text: str = "text", normalised: bool = False) -> DataFrame:
    """(keys, word, n): the word bag of each row's key. The word counts are added up before they are shuffled.

    Built-in functions alone count texts of characters that compatibility normalisation leaves as they are; the other rows are
    normalised first, by a pandas UDF, as Spark has no function for it. Keys may have any names.
    """
    inner = [f"_key{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(k).alias(i) for k, i in zip(keys, inner, strict=True)), F.col(text).alias("_text"))
    found = lambda part, done: part.select(*inner, F.explode(words(F.col("_text"), done)).alias("_word"))
    bag = found(rows, True) if normalised else found(rows.filter(is_normal(F.col("_text"))), True).union(found(rows.filter(~is_normal(F.col("_text"))), False))
    counted = bag.groupBy(*inner, "_word").agg(F.count(F.lit(1)).alias("_n"))
    return counted.select(*(F.col(i).alias(k) for k, i in zip(keys, inner, strict=True)), F.col("_word").alias("word"), F.col("_n").alias("n"))


def score(reference: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ref_n, cand_n, common, recall, precision) of two word bags; a missing candidate recovers nothing.

    One shuffle a side: the join is by key and word, the sums by key.
    """
    both = reference.withColumnRenamed("n", "r").join(candidate.withColumnRenamed("n", "c"), [*keys, "word"], "full_outer")
    r, c = F.coalesce("r", F.lit(0)), F.coalesce("c", F.lit(0))
    sums = both.groupBy(*keys).agg(F.sum(r).alias("ref_n"), F.sum(c).alias("cand_n"), F.sum(F.least(r, c)).alias("common"))
    return sums.filter("ref_n > 0").select(*keys, "ref_n", "cand_n", "common", (F.col("common") / F.col("ref_n")).alias("recall"), F.when(F.col("cand_n") > 0, F.col("common") / F.col("cand_n")).otherwise(0.0).alias("precision"))


def word_diff(reference: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, word, missing, extra) where the bags differ."""
    both = reference.withColumnRenamed("n", "r").join(candidate.withColumnRenamed("n", "c"), [*keys, "word"], "full_outer")
    r, c = F.coalesce("r", F.lit(0)), F.coalesce("c", F.lit(0))
    return both.select(*keys, "word", F.greatest(r - c, F.lit(0)).alias("missing"), F.greatest(c - r, F.lit(0)).alias("extra")).filter("missing > 0 or extra > 0")


def top_words(bag: DataFrame, k: int = 45) -> DataFrame:
    return bag.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(k)


def percentile_floor(value: Column, p: float, n: Column) -> Column:
    """sorted[floor((n - 1) p)], not interpolated; values of one group only."""
    return F.element_at(F.array_sort(F.collect_list(value)), (F.floor((n - 1) * F.lit(p)) + 1).cast("int"))


def percentile_rank(df: DataFrame, keys: list[str], value: str, p: float, name: str, accuracy: int = 10_000) -> DataFrame:
    """(keys, name): the same for groups of any size, exactly; nulls don't count.

    A sketch, whose ranks err by n / accuracy at most, brackets the value; rows under the bracket are counted, and those within it,
    a few of each `accuracy` rows of the group, are ranked. A group of up to 4 x accuracy rows is ranked whole.
    """
    inner = [f"_key{i}" for i in range(len(keys))]
    rows = df.filter(F.col(value).isNotNull()).select(*(F.col(k).alias(i) for k, i in zip(keys, inner, strict=True)), F.col(value).alias("_v"))
    ends = [max(0.0, p - 2 / accuracy), min(1.0, p + 2 / accuracy)]
    sketch = rows.groupBy(*inner).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", ends, accuracy).alias("_ends"))
    sketch = sketch.select(*(F.col(i).alias(f"_of{i}") for i in inner), (F.floor((F.col("_n") - 1) * F.lit(p)) + 1).alias("_rank"), F.when(F.col("_n") > 4 * accuracy, F.col("_ends")[0]).alias("_lo"), F.when(F.col("_n") > 4 * accuracy, F.col("_ends")[1]).alias("_hi"))
    same = [F.col(i).eqNullSafe(F.col(f"_of{i}")) for i in inner]
    each = rows.join(sketch, reduce(and_, same)).filter("_hi is null or _v <= _hi")
    # Equal values are one row with a count, so that a value which fills the bracket is no more than that.
    each = each.groupBy(*inner, "_rank", F.when(F.col("_lo").isNull() | (F.col("_v") >= F.col("_lo")), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy(*inner).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    found = each.withColumn("_upto", upto).filter("_upto >= _rank and _upto - _m < _rank")
    return found.select(*(F.col(i).alias(k) for k, i in zip(keys, inner, strict=True)), F.col("_v").alias(name))


def cohort_summary(scores: DataFrame) -> DataFrame:
    """Per cohort (all; long or short by 50 words; ordinary, where a column of that name is true): documents, mean and word-weighted
    recall, counts at the marks, mean precision, median recall; with a column mb also its median, 90th percentile and maximum, and
    with a column seconds its sum, median and maximum."""
    has = set(scores.columns)
    ordinary = F.when(F.col("ordinary"), F.lit("ordinary")) if "ordinary" in has else F.lit(None).cast("string")
    cohorts = F.array(F.lit("all"), F.when(F.col("ref_n") >= 50, F.lit("long")).otherwise(F.lit("short")), ordinary)
    rows = scores.filter("ref_n >= 10").withColumn("cohort", F.explode(F.filter(cohorts, lambda c: c.isNotNull())))
    more = [F.max("mb").alias("most_mb")] * ("mb" in has) + [F.sum("seconds").alias("total_seconds"), F.max("seconds").alias("most_seconds")] * ("seconds" in has)
    out = rows.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("documents"),
        F.round(F.avg("recall"), 9).alias("mean_recall"),
        F.round(F.sum("common") / F.sum("ref_n"), 9).alias("weighted_recall"),
        F.sum(F.when(F.col("recall") >= 0.95, 1).otherwise(0)).alias("at_95"),
        F.sum(F.when(F.col("recall") >= 0.80, 1).otherwise(0)).alias("at_80"),
        F.sum(F.when(F.col("recall") < 0.50, 1).otherwise(0)).alias("under_50"),
        F.round(F.avg("precision"), 9).alias("mean_precision"),
        *more,
    )
    ranks = [("recall", 0.5, "median_recall")] + [("mb", 0.5, "median_mb"), ("mb", 0.9, "p90_mb")] * ("mb" in has) + [("seconds", 0.5, "median_seconds")] * ("seconds" in has)
    for value, p, name in ranks:
        out = out.join(percentile_rank(rows, ["cohort"], value, p, name), "cohort", "left")
    return out
