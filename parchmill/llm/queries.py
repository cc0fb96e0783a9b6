"""The registered queries of this subpackage, one an operator, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.llm import decontamination, extraction, jaccard, lm, media, packing, quality, sharding, suffixes, tokencount
from parchmill.llm.common import small_batches

BYTE_BPE = {"json_path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, capacity=1024, end_id=0)


def decontaminated(docs: DataFrame, benchmark: DataFrame, most_indexed: int = decontamination.MOST_INDEXED) -> DataFrame:
    found = decontamination.find(docs, benchmark, most_indexed)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removal_digests(table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's wave lies among other bytes, under a wrong type: it is carved out, and its type told, before it is read."""
    kept = media.texts_as_media(table(spark, sf_dir, "documents"))
    mixed = kept.select("doc_id", "n_bytes", F.concat(F.lit(b"RIFF, not yet: "), "media", F.lit(b"GIF89a, but no picture")).alias("media"), F.lit("image/gif").alias("declared"))
    return media.media_features(mixed, "declared")


QUERIES = {f.__name__: f for f in (op1_packing, op2_decontamination, op3_jaccard_join, op4_lm_score, op5_token_counts, op6_quality, op7_extraction, op8_sharding, op9_suffix_dedup, op10_media)}
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: SQL of the operators that it can express; the others are tested against brute-force versions.
ORACLES = {
    "op2_decontamination": f"""with d as (select doc_id, coalesce(regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) as w from documents),
i as (select item_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark where text is not null),
s as (select item_id, w, least(10, len(w)) as size from i where len(w) > 0),
v as (select item_id, size, w, unnest(range(1, len(w) - size + 2)) as a from s),
windows as (select distinct cast(item_id as varchar) as item, size, array_to_string(w[a:a + size - 1], ' ') as win from v),
x as (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as a from d, (select distinct size from s) where len(w) >= size),
hits as (select doc_id, a, size, item from (select doc_id, a, size, array_to_string(w[a:a + size - 1], ' ') as win from x) join windows using (size, win)),
inside as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(a, a + size)) as p from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed from (select distinct doc_id, item from hits) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join inside using (doc_id) left join items using (doc_id)""",
    "op3_jaccard_join": f"""with recursive d as (select doc_id, coalesce(regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+'), []) as w from documents),
s as (select distinct doc_id, array_to_string(w[a:a + 2], ' ') as shingle from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as a from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.shingle = y.shingle and x.doc_id < y.doc_id group by all),
l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 90 * (na.n + nb.n - c)),
e as (select a, b from l union all select b, a from l),
r(doc_id, other) as (select doc_id, doc_id from d union select r.doc_id, e.b from r join e on r.other = e.a)
select r.doc_id, coalesce(max(n), 0) as n_shingles, min(other) as component_id from r left join n on n.doc_id = r.doc_id group by r.doc_id""",
}
