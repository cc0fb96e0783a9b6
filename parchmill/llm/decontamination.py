"""Benchmark decontamination by winnowing (operator 2).

Fingerprints are the hashes of K consecutive words; of each W consecutive ones the least is kept, on the
training side and on the benchmark side alike. K + W - 1 words make a window, so two texts that share a
window share a kept fingerprint of it: none is missed. Each shared fingerprint is extended to the windows
that hold it, and their words are compared as bytes, so no hash decides. Items shorter than a window are
one window of their own length; these are looked up at every word.

The index of the benchmark is built and broadcast only if the benchmark has at most `most_indexed` windows, which are counted first.
Beyond, the fingerprints of both sides are joined, and each document is compared with the items that it met.

Null and empty texts have no words: no hits. Equal doc_ids are separate documents. Items without words
have no windows; repeated items each count, under their own ids. Null ids are ids like others, a null item_id
the first of a document's items. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.llm.common import ALNUM, LOWER, blocks, grams, stored, within, words

#: Words of a window, of a fingerprint, and fingerprints of which one is kept.
WINDOW, K = 10, 5
W = WINDOW - K + 1
#: Windows that a broadcast index may hold: about 400 bytes each in every Python worker.
MOST_INDEXED = 250_000


def kept(g: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Positions of the fingerprints that winnowing keeps; off: first word of each document."""
    n = len(g) - W + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, at = g[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, W):
        less = g[j : j + n] < least
        np.copyto(least, g[j : j + n], where=less)
        at[less] = j
    first = np.flatnonzero(within(off, WINDOW, n))
    return np.unique(first + at[first])


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, a: int, b: int) -> bytes:
    """Words a to b, a space between two."""
    return b" ".join(data[s:e].tobytes() for s, e in zip(start[a:b], end[a:b], strict=True))


class Index:
    """Windows of items by their words, and the fingerprints that lead to them."""

    def __init__(self, items: list[tuple[object, str | None]]) -> None:
        self.windows: dict[bytes, set] = {}
        self.short: dict[int, np.ndarray] = {}
        marks, short = [np.zeros(0, np.uint64)], {}
        for item, text in items:
            data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            h, s, e, off = words(data, np.array([0, len(data)]), ALNUM)
            size = min(WINDOW, len(h))
            if not size:
                continue
            for a in range(len(h) - size + 1):
                self.windows.setdefault(joined(data, s, e, a, a + size), set()).add(item)
            if size < WINDOW:
                short.setdefault(size, []).append(grams(h, size))
            else:
                g = grams(h, K)
                marks.append(g[kept(g, off)])
        self.marks = np.unique(np.concatenate(marks))
        self.short = {m: np.unique(np.concatenate(g)) for m, g in short.items()}

    def hits(self, data: np.ndarray, h: np.ndarray, s: np.ndarray, e: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, set]]:
        """(first word, end word, items) of each occurrence of a window in documents whose words begin at off."""
        g = grams(h, K)
        p = kept(g, off)
        found = p[np.isin(g[p], self.marks)] if len(self.marks) else p[:0]
        first = np.searchsorted(off, found, "right") - 1
        tried = -1
        for q, d in zip(found.tolist(), first.tolist(), strict=True):
            for a in range(max(q - W + 1, tried + 1, int(off[d])), min(q, int(off[d + 1]) - WINDOW) + 1):
                tried = a
                if items := self.windows.get(joined(data, s, e, a, a + WINDOW)):
                    yield a, a + WINDOW, items
        for m, known in self.short.items():
            g = grams(h, m)
            at = np.flatnonzero(within(off, m, len(g)))
            for a in at[np.isin(g[at], known)].tolist():
                if items := self.windows.get(joined(data, s, e, a, a + m)):
                    yield a, a + m, items


def judge(index: Index, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, list, list]]:
    """For each document of a block: words, hit words, items, and the hit spans as byte offsets (start, end)."""
    data = LOWER[data]
    h, s, e, woff = words(data, off, ALNUM)
    cover = np.zeros(len(h) + 1, np.int32)
    items: dict[int, set] = {}
    hits = list(index.hits(data, h, s, e, woff))
    if hits:
        owner = np.searchsorted(woff, [a for a, _, _ in hits], "right") - 1
        for (a, b, found), d in zip(hits, owner.tolist(), strict=True):
            cover[a] += 1
            cover[b] -= 1
            items.setdefault(d, set()).update(found)
    inside = np.cumsum(cover)[:-1] > 0
    for d in range(len(off) - 1):
        a, b = woff[d], woff[d + 1]
        spans = []
        if d in items:
            at = np.flatnonzero(np.diff(np.concatenate([[0], inside[a:b].view(np.int8), [0]])))
            spans = [(int(s[a + x] - off[d]), int(e[a + y - 1] - off[d])) for x, y in zip(at[::2], at[1::2], strict=True)]
        yield int(b - a), int(inside[a:b].sum()), list(items.get(d, ())), spans


SCHEMA = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def _verdicts(results: list[tuple[int, int, list, list]]) -> list[pa.Array]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    n, hit, items, spans = zip(*results, strict=True)
    return [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([sorted(x, key=lambda i: (i is not None, i or "")) for x in items], pa.list_(pa.string())), pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], span)]


def find(docs: DataFrame, benchmark: DataFrame, most_indexed: int = MOST_INDEXED, keep: list[str] | None = None) -> DataFrame:
    """For each row of docs (doc_id, text): n_words, n_hit, items (ids as strings, sorted) and the hit spans in bytes.

    keep: further columns of docs to carry. benchmark: (item_id, text).
    """
    spark = docs.sparkSession
    keep = ["doc_id", *(keep or [])]
    docs = docs.select(*keep, *([] if "text" in keep else ["text"]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    windows = _lengths(items).filter("n > 0").agg(F.sum(F.greatest(F.col("n") - F.lit(WINDOW - 1), F.lit(1)))).first()[0] or 0
    if windows > most_indexed:
        return _joined(docs, items, keep, fields)
    some = items.filter(F.col("text").rlike("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"))  # a word, and so a window, each
    sent = spark.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in some.collect()]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + _verdicts(list(judge(sent.value, data, off))), [*keep, "n_words", "n_hit", "items", "spans"])

    return docs.mapInArrow(scan, f"{fields}, {SCHEMA}")


def _lengths(items: DataFrame) -> DataFrame:
    """(item_id, n): the number of words of each item."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(np.diff(words(LOWER[data], off, ALNUM)[3]), pa.int64())], ["item_id", "n"])

    return items.select("item_id", "text").mapInArrow(count, "item_id string, n long")


def _marks(rows: DataFrame, key: str, lengths: list[int]) -> DataFrame:
    """(key, size, mark): the distinct fingerprints by which a row can meet another; size: 0, or the words of a short item."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in blocks(batches):
            h, _, _, woff = words(LOWER[data], off, ALNUM)
            g = grams(h, K)
            p = kept(g, woff)
            found = [(0, p, g[p])]
            for m in lengths:
                g = grams(h, m)
                at = np.flatnonzero(within(woff, m, len(g)))
                found.append((m, at, g[at]))
            for m, at, values in found:
                owner = np.searchsorted(woff, at, "right") - 1
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(owner)), pa.array(np.full(len(at), m, np.int32)), pa.array(values.view(np.int64))], ["key", "size", "mark"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, "text").mapInArrow(emit, f"key {kind}, size int, mark long").distinct()


def _joined(docs: DataFrame, items: DataFrame, keep: list[str], fields: str) -> DataFrame:
    """The way for a benchmark of any size. A document is compared with the items it shares a fingerprint with."""
    # Ids may be null or shared, so rows are joined by numbers of their own.
    docs, items = stored(docs.withColumn("_row", F.monotonically_increasing_id())), stored(items.withColumn("_item", F.monotonically_increasing_id()))
    lengths = sorted(r[0] for r in _lengths(items).filter(f"n > 0 and n < {WINDOW}").select("n").distinct().collect())  # at most WINDOW - 1 rows
    item_marks = _marks(items, "_item", lengths).withColumnRenamed("key", "_item")
    met = _marks(docs, "_row", lengths).join(item_marks, ["size", "mark"]).select(F.col("key").alias("_row"), "_item").distinct()
    sets = met.join(items, "_item").groupBy("_row").agg(F.collect_list(F.struct("item_id", "text")).alias("_items"))
    both = docs.join(sets, "_row", "left").drop("_row")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in blocks(batches):
            results = []
            for d, met_items in enumerate(batch.column("_items").to_pylist()):
                index = Index([(x["item_id"], x["text"]) for x in met_items or []])
                results += judge(index, data[off[d] : off[d + 1]], off[d : d + 2] - off[d])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + _verdicts(results), [*keep, "n_words", "n_hit", "items", "spans"])

    return both.mapInArrow(scan, f"{fields}, {SCHEMA}")
