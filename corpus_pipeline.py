"""A training-data pipeline over `documents`: five stages, each of which works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.llm import decontamination, jaccard, packing, quality, suffixes
from parchmill.llm.common import stored
from parchmill.llm.queries import BYTE_BPE, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling rejects go; of rows that share a doc_id all go, or none."""
    found = quality.select(docs, table(spark, sf_dir, "labels")).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = stored(found.filter("not kept").select("doc_id"))
    return without(docs, gone)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents whose ids aren't in `gone`; texts are only moved where the ids are too many to send around."""
    ids = F.broadcast(gone) if gone.count() <= jaccard.MOST_IDS else gone
    return docs.join(ids, docs["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document of the least id stays; of rows that share an id, or have
    none (these come first), the one whose text's hash is the least. Documents without words are near to nothing and stay."""
    rows, stands_for = suffixes.sole_ids(docs, COLUMNS[2:])
    rows = rows.withColumnRenamed("id", "doc_id")
    found = jaccard.near_duplicates(rows, k=5, num=80, den=100)
    kept = without(rows, stored(found.filter("doc_id > component_id").select("doc_id").distinct()))
    if stands_for is None:
        return kept
    return kept.withColumnRenamed("doc_id", "id").join(stands_for, "id").select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 100 bytes that also start earlier are cut out of the texts, by whole characters; texts of which nothing is left go."""
    cut = suffixes.without_repeats(docs, keep=["lang", "source"])
    text = F.col("kept")
    return cut.filter((F.col("n_cut") == 0) | (F.trim(text) != "")).select("doc_id", text.alias("text"), "lang", "source", F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontamination.find(docs, table(spark, sf_dir, "benchmark"), keep=["text", "lang", "source", "n_chars"])
    return found.filter("n_hit = 0").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences of 1024 tokens."""
    return packing.pack(docs, BYTE_BPE, capacity=1024, end_id=0)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", suffix_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packed),
]
#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`, each stage written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
