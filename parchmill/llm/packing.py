"""Packing of tokenised documents into fixed windows by best-fit decreasing (operator 1).

A document's ids are cut into full windows and a rest. Best-fit decreasing only needs the lengths, and
there are at most `capacity` of those, so the packing is computed exactly on the histogram of lengths:
equal windows are kept as runs, and a segment tree indexed by remaining capacity finds the tightest open
run. The plan is a table of segments whose size depends on the capacity, not on the data; each piece then
finds its place from its rank among the pieces of its length.

Ids are those of the tokenizer's file as it is: the string of a special token in a text is that token's id.
Null text is an empty document: one piece that holds the end id. Rows with equal doc_id are separate
documents. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.llm.common import stored, with_rank


class OpenWindows:
    """Runs of open windows by remaining capacity, under a segment tree of which capacities have any."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]

    def _mark(self, left: int) -> None:
        i = left + self.size
        self.some[i] = bool(self.runs[left])
        while i > 1:
            i //= 2
            self.some[i] = self.some[2 * i] or self.some[2 * i + 1]

    def add(self, left: int, first: int, n: int) -> None:
        if n and left:
            self.runs[left].append((first, n))
            self._mark(left)

    def tightest(self, need: int) -> tuple[int, int, int] | None:
        """Takes the run with the least remaining capacity of at least `need`: (remaining, first window, windows)."""
        i = need + self.size
        if not self.some[i]:
            while i > 1 and (i & 1 or not self.some[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.some[2 * i] else 2 * i + 1
        left = i - self.size
        first, n = self.runs[left].pop()
        self._mark(left)
        return left, first, n


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """For each length the segments (first rank, end rank, first window, pieces a window, offset of the first piece)."""
    windows, opened = OpenWindows(capacity), 0
    plan: dict[int, list[tuple[int, int, int, int, int]]] = {}
    for length in sorted(counts, reverse=True):
        n, done, segments = counts[length], 0, []
        while done < n:
            found = windows.tightest(length)
            left, first, many = found or (capacity, opened, -1)
            each = left // length
            used = -(-(n - done) // each)
            if many < 0:
                many = used
                opened += used
            used = min(used, many)
            put = min(n - done, used * each)
            full, over = divmod(put, each)
            segments.append((done, done + put, first, each, capacity - left))
            windows.add(left - each * length, first, full)
            if over:
                windows.add(left - over * length, first + full, 1)
            windows.add(left, first + used, many - used)
            done += put
        plan[length] = segments
    return plan


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def plain_encoder(json_path: str):
    """The tokenizer as the file has it, and the strings that it takes as one id of their own wherever they stand in a text."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(json_path)
    return made, tuple(t.content for t in made.get_added_tokens_decoder().values())


def token_ids(text: str, json_path: str, ranks_path: str, pattern: str) -> np.ndarray:
    """The ids of the tokenizer in `json_path`. The rank file holds the same vocabulary and is several times as fast; a text
    that holds an added token, or that the fast engine refuses (megabytes of white space), takes the plain way."""
    plain, added = plain_encoder(json_path)
    if not any(t in text for t in added):
        try:
            return encoder(ranks_path, pattern).encode_to_numpy(text, allowed_special=set(), disallowed_special=())
        except BaseException as e:  # a panic of the engine isn't an Exception
            if not isinstance(e, Exception) and type(e).__name__ != "PanicException":
                raise
    return np.array(plain.encode(text, add_special_tokens=False).ids, np.uint32)


def pieces(docs: DataFrame, tokenizer: dict[str, str], capacity: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, and the ids themselves if asked for."""
    schema = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(5 + with_ids)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(token_ids(text.as_py() or "", **tokenizer), end_id).astype("<u4")
                for at in range(0, len(ids), capacity):
                    part = ids[at : at + capacity]
                    for col, x in zip(cols, (doc, at, len(part), zlib.crc32(part.tobytes()), len(ids), part.astype(np.int32)), strict=False):
                        col.append(x)
                if len(cols[0]) >= 20_000:
                    yield made(cols)
                    cols = [[] for _ in cols]
            yield made(cols)

    def made(cols: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(cols)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: dict[str, str], capacity: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Packs documents (doc_id, text) into windows of `capacity` ids.

    tokenizer: json_path, ranks_path and pattern of one byte-level vocabulary. One row a piece, with its
    sequence_id and its offset there; offsets of a sequence are gapless from 0. with_ids adds the ids.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer, capacity, end_id, with_ids))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan = best_fit_decreasing(counts, capacity)
    segments = spark.createDataFrame([(k, v) for k, v in plan.items()], "length int, segments array<struct<lo:long,hi:long,first:long,each:long,at:long>>")
    ranked = with_rank(cut, ["length"], ["doc_id", "start", "ids_crc32", "doc_tokens"], "_rank", F.struct("doc_id", "start"))
    placed = ranked.join(F.broadcast(segments), "length").withColumn("_s", F.filter("segments", lambda s: (s["lo"] <= F.col("_rank")) & (F.col("_rank") < s["hi"]))[0]).withColumn("_t", F.col("_rank") - F.col("_s.lo"))
    return placed.select(
        "doc_id",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.col("_s.first") + F.expr("_t div _s.each")).alias("sequence_id"),
        (F.col("_s.at") + F.expr("_t % _s.each") * F.col("length")).alias("offset"),
        *(["ids"] if with_ids else []),
    )
