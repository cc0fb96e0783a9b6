"""What the operators share: shared-folder tables, exact salted ranks, and vectorised words.

Words are found on UTF-8 bytes. Both word classes in use keep every byte of 0x80 and above, so a run
of word bytes is a run of word characters, and no text is ever decoded to be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchmill.sources import tables
from parchmill.sources.tables import BATCH_BYTES, small_batches  # noqa: F401

#: Bytes of text that are worked on at once; a longer document is a block of its own.
BLOCK = 2 << 20
#: Windows of an exact rank over all classes, and rows that are worth a window of their own.
WINDOWS, ROWS_A_WINDOW = 1 << 16, 1_000
#: Rows that are worth a task of their own where rows are narrow.
ROWS_A_TASK = 50_000


def stored(df: DataFrame) -> DataFrame:
    """`df` written as a table in the shared folder and read again: lineage ends here."""
    small_batches(df.sparkSession)
    return tables.stored(df)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sized(df: DataFrame, rows: int) -> DataFrame:
    """`df`, of at most about `rows` narrow rows, in no more tasks than they are worth."""
    return df.coalesce(max(1, min(partitions(df.sparkSession), -(-rows // ROWS_A_TASK))))


def with_rank(df: DataFrame, classes: list[str], order: list[str], name: str, salt: Column) -> DataFrame:
    """Adds the exact rank (from 0, gapless) of each row within its class.

    A class may hold a third of all rows, so it is dealt by a hash of `salt` over as many windows as it has rows for, and each
    window starts at the sum of the counts before it. `classes` must take a bounded number of values: the tables of
    counts and of starts are broadcast, and have a row a class, and at most WINDOWS rows more. `df` is read more than once:
    pass a stored table.
    """
    total = df.count()
    width = max(ROWS_A_WINDOW, total // WINDOWS)
    sizes = df.groupBy(*classes).agg(F.ceil(F.count(F.lit(1)) / F.lit(width)).cast("int").alias("_windows"))
    df = df.join(F.broadcast(sizes), classes).withColumn("_salt", F.pmod(F.xxhash64(salt), F.col("_windows")).cast("int"))
    keys = [*classes, "_salt"]
    before = Window.partitionBy(*classes).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_k", F.row_number().over(within)).join(F.broadcast(starts), keys).withColumn(name, F.col("_start") + F.col("_k") - 1)
    return sized(ranked.drop("_windows", "_salt", "_k", "_start"), total)


# --- words ------------------------------------------------------------------------------------

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x20\x09-\x0D]+
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0x5851F42D4C957F2D)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (public splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h *= M1
    h ^= h >> np.uint64(27)
    h *= M2
    h ^= h >> np.uint64(31)
    return h


def powers(n: int, base: int = 0x100000001B3) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


_POW = [powers(1 << 10)]


def _pow(n: int) -> np.ndarray:
    if len(_POW[0]) < n:
        _POW[0] = powers(max(n, 2 * len(_POW[0])))
    return _POW[0]


def words(data: np.ndarray, off: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word of the documents data[off[i]:off[i+1]], and each document's first word."""
    hs, ss, es = [], [], []
    n, at = len(data), 0
    while at < n:
        to = min(n, at + 2 * BLOCK)
        while to < n and word[data[to - 1]] and word[data[to]]:
            room = word[data[to : to + BLOCK]]
            to = to + int(np.argmin(room)) if not room.all() else min(n, to + BLOCK)
        h, s, e = _words(data[at:to], off[(off >= at) & (off <= to)] - at, word)
        hs.append(h)
        ss.append(s + at)
        es.append(e + at)
        at = to
    if not hs:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(off), np.int64)
    start = np.concatenate(ss)
    return np.concatenate(hs), start, np.concatenate(es), np.searchsorted(start, off)


def _words(data: np.ndarray, bounds: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = LOWER[data]
    is_word = word[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(is_word[1:], is_word[:-1], out=edge[1:-1])
    edge[bounds] = True
    starts = np.flatnonzero(is_word & edge[:-1])
    ends = np.flatnonzero(is_word & edge[1:]) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    lens = ends - starts
    first = np.cumsum(lens) - lens
    place = np.arange(first[-1] + lens[-1])
    place -= np.repeat(first, lens)
    value = _BYTE[data[is_word]]
    value *= _pow(int(lens.max()))[place]
    return mix(np.add.reduceat(value, first) + lens.astype(np.uint64)), starts, ends


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words of one run of words; those over a document's end are the caller's to drop."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[i : i + n]
    return mix(out)


def within(off: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n positions begin k items that end within their document."""
    ok = np.ones(n, bool)
    for j in range(1, k):
        at = off[1:] - j
        at = at[(at >= off[:-1]) & (at < n) & (at >= 0)]
        ok[at] = False
    return ok


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows in blocks of about BLOCK bytes of text, each with its bytes and offsets. Null text is empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(text)
        col = col.cast(pa.binary()) if not pa.types.is_large_string(col.type) else col.cast(pa.large_binary())
        col = col.fill_null(b"") if col.null_count else col
        kind = np.int64 if pa.types.is_large_binary(col.type) else np.int32
        off = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        raw = col.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        i = 0
        while i < len(col):
            j = max(i + 1, int(np.searchsorted(off, off[i] + BLOCK, "right")) - 1)
            j = min(j, len(col))
            yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


def per_document(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of the values of each document."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[off[1:]] - total[off[:-1]]


def sequences(off: np.ndarray) -> np.ndarray:
    """The document number of each item."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))
