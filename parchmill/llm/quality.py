"""Quality classifier by importance resampling (operator 6).

Two generative models of hashed n-grams are counted: one of target text (labelled good), one of raw text
(all rows). A document's log importance weight is the sum over its n-grams of the log ratio of their
probabilities. The n-grams are words and word pairs, and words and pairs of word shapes (runs of capital and
small letters, digits and each sign), where a word equal to the one before has a shape of its own.

Selection is Gumbel top-k over the weights: Gumbel noise from a hash of the id and the seed, times `temperature`, is added, and
the k largest keys stay, which draws k rows without replacement in proportion to exp(weight / temperature). A weight counts from a
zero per n-gram, the threshold that parts the labelled rows at least cost, so that length alone decides nothing: a long text's
evidence outweighs the noise, and of the short ones with little evidence a part is drawn. k is given, or it is the number of rows at or over
the threshold. The k-th key is found exactly by counting keys in ever finer ranges; ties fall to the smaller id.

Target rows are a bounded sample of the labels (`most_labels`, by a hash of the id); the raw counts and the weights
cover all rows. Null and empty texts have no n-grams: weight 0. Null labels don't count. Rows that share an
id share its label. Without target rows every weight is 0 and all rows stay. An id must be a number or null. Toxic rows are no target, and
they don't count as bad either: toxicity is not what this model tells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.llm.common import _BYTE, SPACED, _pow, blocks, mix, sequences, stored, words

#: Buckets of hashed n-grams, labelled rows to fit by, noise scale and its seed.
BUCKETS, MOST_LABELS, TEMPERATURE, SEED = 1 << 17, 20_000, 1.0, 1
#: Bad rows that may stay rather than lose one good row.
COST = 10.0

SHAPE = np.full(256, 1, np.uint8)
SHAPE[65:91] = 2
SHAPE[48:58] = 3
for _i in [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]:
    SHAPE[_i] = _i
AGAIN = np.uint64(0x7F4A7C159E3779B9)


def shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word's shape: its classes of characters, those in a row once."""
    if not len(start):
        return np.zeros(0, np.uint64)
    kind = SHAPE[data]
    turn = np.ones(len(data), bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn[start] = True
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    turn &= np.cumsum(edge[:-1], dtype=np.int8) > 0
    n = np.add.reduceat(turn, start, dtype=np.int64)
    first = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(first, n)
    return mix(np.add.reduceat(_BYTE[kind[turn]] * _pow(int(n.max()))[place], first) + n.astype(np.uint64))


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a block's n-grams, and the document of each."""
    h, s, e, woff = words(data, off, SPACED)
    doc = sequences(woff)
    shape = shapes(data, s, e)
    pair = np.zeros(len(h), bool)
    pair[1:] = doc[1:] == doc[:-1]
    at = np.flatnonzero(pair)
    shape[at[h[at] == h[at - 1]]] ^= AGAIN
    grams = [h, mix(h[at - 1] * np.uint64(3) + h[at]), mix(shape + np.uint64(1)), mix(shape[at - 1] * np.uint64(5) + shape[at])]
    return (np.concatenate(grams) >> np.uint64(40)).astype(np.int64) % BUCKETS, np.concatenate([doc, doc[at], doc, doc[at]])


class Models:
    """Log ratios of the target's and the raw text's probability of each bucket."""

    def __init__(self, target: np.ndarray, raw: np.ndarray) -> None:
        # Each count is smoothed by the raw share of its bucket, so that a bucket the target hasn't seen is not endless.
        share = (raw + 1.0) / (raw.sum() + len(raw))
        mass = 0.02 * target.sum() + 1.0
        self.ratio = np.log((target + mass * share) / (target.sum() + mass)) - np.log(share) if target.sum() else np.zeros(len(raw))


def sampled_labels(labels: DataFrame, most: int) -> dict[int, int]:
    """doc_id -> 1 (good: quality 1, not toxic) or 0 (quality 0) of at most `most` labels."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    return {r["doc_id"]: 1 if r["quality"] else 0 for r in rows if not r["quality"] or not r["toxic"]}


def fit(docs: DataFrame, marks: dict[int, int]) -> Models:
    """Counts both models over all rows of docs (doc_id, text); 2 x BUCKETS sums come to the driver."""
    sent = docs.sparkSession.sparkContext.broadcast(marks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch, data, off in blocks(batches):
            bucket, doc = features(data, off)
            total[1] += np.bincount(bucket, minlength=BUCKETS)
            good = np.array([sent.value.get(i) == 1 for i in batch.column("doc_id").to_pylist()], bool)
            total[0] += np.bincount(bucket[good[doc]], minlength=BUCKETS)
        for model in range(2):
            for at in range(0, BUCKETS, 4096):
                yield pa.RecordBatch.from_arrays([pa.array([model], pa.int32()), pa.array([at], pa.int32()), pa.array([total[model, at : at + 4096].tobytes()], pa.binary())], ["model", "at", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for model, at, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                got = np.frombuffer(x.as_buffer(), np.int64)
                sums[model, at] = sums[model, at] + got if (model, at) in sums else got.copy()
        for (model, at), x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.int32()), pa.array([at], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["model", "at", "counts"])

    schema = "model int, at int, counts binary"
    total = np.zeros((2, BUCKETS), np.int64)
    summed = docs.select("doc_id", "text").mapInArrow(count, schema).repartition(2 * BUCKETS // 4096, "model", "at").mapInArrow(add, schema)
    for r in summed.collect():
        total[r["model"], r["at"] : r["at"] + 4096] = np.frombuffer(r["counts"], np.int64)
    return Models(total[0], total[1])


def weights(docs: DataFrame, models: Models) -> DataFrame:
    """(doc_id, n_grams, weight): the log importance weight of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(models.ratio)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in blocks(batches):
            bucket, doc = features(data, off)
            n = len(off) - 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.bincount(doc, minlength=n)), pa.array(np.round(np.bincount(doc, sent.value[bucket], n), 6), pa.float64())], ["doc_id", "n_grams", "weight"])

    return docs.select("doc_id", "text").mapInArrow(weigh, "doc_id long, n_grams long, weight double")


def threshold(weight: np.ndarray, good: np.ndarray, cost: float) -> float:
    """The cut of least cost on labelled rows, where a good row lost costs `cost` bad rows kept; in the middle of its gap."""
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(weight, kind="stable")
    w, g = weight[order], good[order]
    lost = np.concatenate([[0], np.cumsum(g)])
    kept = np.concatenate([np.cumsum(~g[::-1])[::-1], [0]])
    at = int(np.argmin(cost * lost + kept))
    return -np.inf if at == 0 else np.inf if at == len(w) else float((w[at - 1] + w[at]) / 2)


def top_k(keyed: DataFrame, k: int) -> DataFrame:
    """(doc_id, weight, key) with `kept`: whether the row is among the k largest keys; equal keys by doc_id, then equal rows whole.

    The cut is narrowed by counts of 4096 ranges a round, so the driver sees 4096 numbers at a time.
    """
    n = keyed.count()
    if k >= n:
        return keyed.withColumn("kept", F.lit(True))
    if k <= 0:
        return keyed.withColumn("kept", F.lit(False))

    def nth(rows: DataFrame, name: str, k: int) -> tuple[float, int]:
        """The k-th largest value, and how many rows of it are within the k."""
        lo, hi = rows.agg(F.min(name), F.max(name)).first()
        while lo < hi:
            step = (hi - lo) / 4096
            part = F.least(F.lit(4095), F.floor((F.col(name) - F.lit(lo)) / F.lit(step)).cast("int"))
            inside = rows.filter(F.col(name).between(lo, hi))
            ranges = {r["p"]: r for r in inside.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("a"), F.max(name).alias("b")).collect()}
            for p in sorted(ranges, reverse=True):
                if k <= ranges[p]["n"]:
                    lo, hi = ranges[p]["a"], ranges[p]["b"]
                    break
                k -= ranges[p]["n"]
        return lo, k

    key, left = nth(keyed, "key", k)
    tied = keyed.filter(F.col("key") == key).select((-F.coalesce(F.col("doc_id"), F.lit(0))).alias("minus"))
    last, _ = nth(tied, "minus", left)
    return keyed.withColumn("kept", (F.col("key") > key) | ((F.col("key") == key) & (-F.coalesce(F.col("doc_id"), F.lit(0)) >= last)))


def select(docs: DataFrame, labels: DataFrame, k: int | None = None, temperature: float = TEMPERATURE, seed: int = SEED, most_labels: int = MOST_LABELS, cost: float = COST) -> DataFrame:
    """doc_id, n_grams, weight, key and kept of each row of docs (doc_id, text); labels: (doc_id, quality, toxic)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = sampled_labels(labels, most_labels)
    weighed = stored(weights(docs, fit(docs, marks)))
    of = docs.sparkSession.createDataFrame(list(marks.items()), "doc_id long, good int")
    # Rows that share an id share a label; one of each is enough to set the threshold by, so at most `most_labels` rows come.
    first = F.min(F.struct(F.xxhash64("weight", "n_grams"), "weight", "n_grams")).alias("r")
    seen = weighed.join(F.broadcast(of), "doc_id").groupBy("doc_id", "good").agg(first).select("r.weight", "r.n_grams", "good").collect()
    good = np.array([r["good"] == 1 for r in seen], bool)
    cut = threshold(np.array([r["weight"] / max(1, r["n_grams"]) for r in seen]), good, cost)
    above = F.col("weight") - F.lit(cut if np.isfinite(cut) else 0.0) * F.col("n_grams")
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    keyed = stored(weighed.withColumn("key", above + F.lit(temperature) * -F.log(-F.log(uniform))))
    if k is None:
        k = keyed.filter(above >= 0).count() if np.isfinite(cut) else keyed.count()
    return top_k(keyed, k)
