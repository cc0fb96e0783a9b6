"""Language-model scoring with a log-frequency Bloom filter (operator 4).

Counts of words and of word pairs are gathered over all training documents: each task counts its blocks,
deals the counts by ranges of the hash, and one task a range adds them up, chunk by chunk. There is a range for every PART_BYTES
of text, so none grows with the input. A count c is quantised to a level, 1 + floor(log(c) / log(1.25)) for words and
floor(log2(c)) for pairs. An n-gram goes into the filter once for every level from that of a count of one up to its own, and the level
is read back by probing level after level until one is absent; an n-gram that isn't there is a level below that of a count of one.
Each range has a segment of the filter of its own, of BITS_EACH bits an entry, filled where the range was added up.

Segments of `most_bits` bits together at most are broadcast. Larger filters stay where they are: each bundle of documents is kept as its
distinct words and their order, its distinct n-grams are sent to the segments of their ranges, and levels come back.
The segments are the same either way, and so are the scores. The model takes account of the rate of false positives:

    P(w | v) = a * C(vw) / (C(v) + f V) + (1 - a) * (C(w) + 0.5) / (N + 0.5 (V + 1))

C: the counts as the filters return them; f: what a pair that isn't in the filter counts on average, so that f V is
what false positives add after v, and the probabilities after v sum to about one at most. How much a text repeats known pairs differs
from text to text, so the weight a isn't one number: a text's probability is the mean of its probabilities under each of WEIGHTS.
The add-half unigram base uses exact counts, which are broadcast or come back together with the levels.

A pair is known by its range and REST bits of its hash; two of the millions of a range agree in these less often than the
filter errs. Words are known by 64 bits.

A document's tokens are its words and one end. Null text is empty: one end. Null doc_id counts as the empty
string in the choice of training rows. Equal doc_ids are separate rows. Without training rows, the only
mass is that of unknown words. Other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.llm.common import SPACED, blocks, mix, partitions, sequences, stored, words

END, START = np.uint64(0x1D8E4E27C47D124F), np.uint64(0x6A09E667F3BCC909)
WEIGHTS = (0.0, 0.1, 0.5, 0.9)
#: Base of the quantisation and level of a count of one, for words and for pairs; bits for each entry of a filter, and probes.
SCALES = ((1.25, 1), (2.0, 0))
BITS_EACH, PROBES = 24, 12
#: Entries past the first level take this many times fewer probes: what is in the filter is in it truly, and an error
#: there only raises a count by one level.
FEWER = 3
#: Bits of a pair's hash within its range, and bytes of a word and of a pair as they move.
REST, WIDTH = 40, (8, 5)
#: Bits of filters, and distinct words, that are broadcast.
MOST_BITS, MOST_WORDS = 1 << 27, 6_000_000
#: Tokens that a task counts together before it deals them out; counts that a task holds before it adds them.
TOGETHER, FOLD = 4_000_000, 1_000_000
#: Bytes of text worth a range of hashes, and bytes of documents that ask together.
PART_BYTES, BUNDLE = 64 << 20, 16 << 20


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a block, an end after each document, and each document's first token."""
    h, _, _, woff = words(data, off, SPACED)
    toff = woff + np.arange(len(woff))
    out = np.empty(toff[-1], np.uint64)
    ends = toff[1:] - 1
    out[ends] = END
    rest = np.ones(len(out), bool)
    rest[ends] = False
    out[rest] = h
    return out, toff


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of the top 32 bits, so that sorted hashes are sorted by part."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def pairs(t: np.ndarray, toff: np.ndarray, parts: int) -> np.ndarray:
    """For each token the pair of the one before (START at a document's beginning) and itself: its part, then REST bits of its hash."""
    before = np.empty_like(t)
    before[1:] = t[:-1]
    before[toff[:-1]] = START
    h = mix(before * np.uint64(0x9E3779B97F4A7C15) + t)
    return part_of(h, parts).astype(np.uint64) << np.uint64(REST) | h & np.uint64((1 << REST) - 1)


def by_part(kind: int, x: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, first, end) of sorted words (kind 0) or pairs (1)."""
    p = part_of(x, parts) if not kind else (x >> np.uint64(REST)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else p
    return zip(p[first].tolist(), first.tolist(), [*first[1:].tolist(), len(p)], strict=True)


def planes(x: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each number, all first bytes first: sorted and small numbers then compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(raw: pa.Buffer | bytes, width: int) -> np.ndarray:
    from_bytes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((from_bytes.shape[1], 8), np.uint8)
    out[:, :width] = from_bytes.T
    return out.view("<u8").ravel()


def squeezed(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(1).compress(raw)


def widened(raw: pa.Buffer) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def in_training(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % 5 != 1 for x in ids], bool)


def ngrams(kind: int, part: int, raw: pa.Buffer) -> np.ndarray:
    x = unplanes(raw, WIDTH[kind])
    return x | np.uint64(part << REST) if kind else x


def gathered(docs: DataFrame, parts: int) -> DataFrame:
    """(kind, part, hashes, counts): each task's counts of words (kind 0) and pairs (1) of training rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        n = 0
        for batch, data, off in blocks(batches):
            t, toff = tokens(data, off)
            train = np.repeat(in_training(batch.column("doc_id").to_pylist()), np.diff(toff))
            held[0].append(t[train])
            held[1].append(pairs(t, toff, parts)[train])
            n += int(train.sum())
            if n >= TOGETHER:
                yield from dealt(held)
                held, n = [[], []], 0
        yield from dealt(held)

    def dealt(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for kind, found in enumerate(held):
            if not found:
                continue
            values, counts = np.unique(np.concatenate(found), return_counts=True)
            found.clear()
            rows = [(kind, p, planes(values[a:b], WIDTH[kind]), planes(counts[a:b], 4)) for p, a, b in by_part(kind, values, parts)]
            yield made(rows, [pa.int32(), pa.int32(), pa.binary(), pa.binary()], ["kind", "part", "hashes", "counts"])

    return docs.select("doc_id", "text").mapInArrow(count, "kind int, part int, hashes binary, counts binary")


def made(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


COUNTED = "kind int, part int, hashes binary, counts binary, segment binary, n_set long, n long, total long, top int"


def added_up(dealt: DataFrame) -> DataFrame:
    """One row a part: the sums of the counts of words, the filled segment, its set bits, n-grams, their occurrences and highest level."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size, least = None, [], 0, FOLD
        for batch in batches:
            for kind, part, h, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if (kind, part) != key:
                    if key:
                        yield total(*key, *folded(held))
                    key, held, size, least = (kind, part), [], 0, FOLD
                held.append((ngrams(kind, part, h.as_buffer()), unplanes(c.as_buffer(), 4).astype(np.int64)))
                size += len(held[-1][0])
                if size > least:
                    held = [folded(held)]
                    size = len(held[0][0])
                    least = 2 * size + FOLD
        if key:
            yield total(*key, *folded(held))

    def folded(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        h, c = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        order = np.argsort(h, kind="stable")
        h, c = h[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return h[first], np.add.reduceat(c, first)

    def total(kind: int, part: int, h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        q = levels(c, *SCALES[kind])
        segment = segment_of(kind, h, q)
        row = (kind, part, None if kind else planes(h, 8), None if kind else planes(c, 8), segment.tobytes(), int(np.bitwise_count(segment).sum(dtype=np.int64)), len(h), int(c.sum()), int(q.max()))
        return made([row], [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()], [x.split()[0] for x in COUNTED.split(", ")])

    dealt = dealt.repartition(partitions(dealt.sparkSession), "kind", "part").sortWithinPartitions("kind", "part")
    return dealt.mapInArrow(add, COUNTED)


def levels(c: np.ndarray, base: float, first: int) -> np.ndarray:
    return first + np.floor(np.log(c) / math.log(base) + 1e-9).astype(np.int64)


def count_at(level: np.ndarray, base: float, first: int) -> np.ndarray:
    """The count that a level stands for: the geometric middle of its range of whole counts; 0 below the level of a count of one."""
    step = np.maximum(level, first) - float(first)
    low = np.ceil(base**step - 1e-9)
    high = np.maximum(low, np.ceil(base ** (step + 1.0) - 1e-9) - 1)
    return np.where(level >= first, np.sqrt(low * high), 0.0)


def probe(h: np.ndarray, level: int, i: int, size: np.ndarray | int) -> np.ndarray:
    """The i-th bit of each n-gram's entry at a level, within a segment of `size` bits."""
    x = mix(h + np.full(1, level, np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return (((x >> np.uint64(32)) + np.uint64(i) * ((x & np.uint64(0xFFFFFFFF)) | np.uint64(1))) % np.asarray(size, np.uint64)).astype(np.int64)


def probes_at(level: int, first: int) -> int:
    return PROBES if level == first else max(2, PROBES // FEWER)


def false_count(fill: float, scale: tuple[float, int], top: int) -> float:
    """What an absent n-gram is expected to count in a filter of which a share `fill` is set."""
    on, above = fill ** probes_at(scale[1] + 1, scale[1]), np.arange(top - scale[1] + 1)
    return fill**PROBES * float((on**above * np.where(above < above[-1], 1 - on, 1.0) * count_at(scale[1] + above, *scale)).sum())


def segment_of(kind: int, h: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The filled segment of one part, whose n-grams have the levels q."""
    first = SCALES[kind][1]
    entries = len(q) + int((q - first).sum()) // FEWER
    segment = np.zeros(entries * BITS_EACH // 8 + 1, np.uint8)
    for level in range(first, int(q.max(initial=first)) + 1):
        x = h[q >= level]
        for i in range(probes_at(level, first)):
            bit = probe(x, level, i, 8 * len(segment))
            np.bitwise_or.at(segment, bit >> 3, np.left_shift(np.uint8(1), (bit & 7).astype(np.uint8)))
    return segment


class Filter:
    """Segments of one log-frequency Bloom filter. first: the first bit of each part's segment, and the end; top: the highest level in it."""

    def __init__(self, kind: int, first: np.ndarray, bits: np.ndarray, top: int) -> None:
        self.kind, self.first, self.bits, self.scale, self.top = kind, first, bits, SCALES[kind], top

    def false_count(self) -> float:
        return false_count(float(np.bitwise_count(self.bits).sum(dtype=np.int64) / max(1, 8 * len(self.bits))), self.scale, self.top)

    def read(self, x: np.ndarray, alone: bool = False) -> np.ndarray:
        """The level of each word or pair, read by probing level after level until an entry is absent; one below the first for none.
        alone: all are of the one part that is held."""
        lowest = self.scale[1]
        out = np.full(len(x), lowest - 1, np.int64)
        part = np.zeros(len(x), np.int64) if alone else part_of(x, len(self.first) - 1) if not self.kind else (x >> np.uint64(REST)).astype(np.int64)
        at, size = self.first[part], np.diff(self.first)[part]
        alive, level = np.flatnonzero(size > 0), lowest
        while len(alive) and level <= self.top:
            for i in range(probes_at(level, lowest)):  # the later probes only where the earlier ones were set
                bit = at[alive] + probe(x[alive], level, i, size[alive])
                alive = alive[(self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0]
            out[alive] = level
            level += 1
        return out

    def count(self, x: np.ndarray) -> np.ndarray:
        return count_at(self.read(x), *self.scale)


def filter_of(counted: DataFrame, kind: int, parts: int) -> Filter:
    """The filter of one kind, fetched whole: for filters of a checked size."""
    first, top, held = np.zeros(parts + 1, np.int64), SCALES[kind][1], {}
    for r in counted.filter(F.col("kind") == kind).select("part", "segment", "top").toLocalIterator():
        held[r["part"]] = np.frombuffer(r["segment"], np.uint8)
        first[r["part"] + 1], top = 8 * len(held[r["part"]]), max(top, r["top"])
    return Filter(kind, np.cumsum(first), np.concatenate([np.zeros(0, np.uint8), *(held[p] for p in sorted(held))]), top)


def score(docs: DataFrame, most_bits: int = MOST_BITS, most_words: int = MOST_WORDS) -> DataFrame:
    """Scores every row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(4 * partitions(spark), -(-size // PART_BYTES))
    counted = stored(added_up(gathered(docs, parts)))
    sums = counted.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("n_set").alias("n_set"), F.sum(F.octet_length("segment")).alias("bytes"), F.max("top").alias("top"))
    kinds = {r["kind"]: r for r in sums.collect()}
    v, n = (kinds[0]["n"], kinds[0]["total"]) if kinds else (0, 0)
    floor = n + 0.5 * (v + 1)
    if v > most_words or sum(8 * r["bytes"] for r in kinds.values()) > most_bits:
        return _dealt(docs, counted, parts, n, v, floor, kinds)
    filters = spark.sparkContext.broadcast((filter_of(counted, 0, parts), filter_of(counted, 1, parts)))
    rows = sorted((r["part"], unplanes(r["hashes"], 8), unplanes(r["counts"], 8).astype(np.int64)) for r in counted.filter("kind = 0").select("part", "hashes", "counts").toLocalIterator())
    known = spark.sparkContext.broadcast((np.concatenate([np.zeros(0, np.uint64), *(x[1] for x in rows)]), np.concatenate([np.zeros(0, np.int64), *(x[2] for x in rows)])))
    del rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_in, pairs_in = filters.value
        extra = pairs_in.false_count() * v
        for batch, data, off in blocks(batches):
            t, toff = tokens(data, off)
            one, two = np.unique(t, return_inverse=True), np.unique(pairs(t, toff, parts), return_inverse=True)  # the common pairs are those of many levels
            yield scored(batch.column("doc_id"), toff, one, two[1], words_in.count(one[0]), pairs_in.count(two[0]), found(*known.value, one[0]), extra, n, floor)

    return docs.mapInArrow(run, SCORED)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def found(h: np.ndarray, c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The exact count of each token, from sorted hashes and their counts."""
    at = np.minimum(np.searchsorted(h, t), max(0, len(h) - 1))
    return np.where(h[at] == t, c[at], 0) if len(h) else np.zeros(len(t), np.int64)


def scored(ids: pa.Array, toff: np.ndarray, one: tuple[np.ndarray, np.ndarray], again: np.ndarray, quantised: np.ndarray, both: np.ndarray, exact: np.ndarray, extra: float, n: int, floor: float) -> pa.RecordBatch:
    """The rows of a block. one, again: its distinct tokens, and the places of tokens and pairs among the distinct ones;
    quantised, both, exact: counts of the distinct tokens and pairs in the filters, and of the tokens exactly."""
    (distinct, which), doc, rows = one, sequences(toff), len(toff) - 1
    c_before = np.empty(len(which))
    c_before[1:] = quantised[which[:-1]]
    c_before[toff[:-1]] = quantised[np.minimum(np.searchsorted(distinct, END), len(distinct) - 1)]  # as many starts as ends
    pair, word = np.minimum(1.0, both[again] / np.maximum(c_before + extra, 1.0)), (quantised[which] + 0.5) / floor
    logs = np.stack([np.bincount(doc, np.log10(a * pair + (1 - a) * word), rows) for a in WEIGHTS])
    top = logs.max(0)
    total = top + np.log10((10.0 ** (logs - top)).mean(0))
    c = exact[which]
    cols = [ids, pa.array(~in_training(ids.to_pylist())), pa.array(np.diff(toff)), pa.array(np.bincount(doc, c > 0, rows).astype(np.int64)), pa.array(np.full(rows, n, np.int64)), pa.array(np.bincount(doc, np.log10((c + 0.5) / floor), rows)), pa.array(total)]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def _dealt(docs: DataFrame, counted: DataFrame, parts: int, n: int, v: int, floor: float, kinds: dict) -> DataFrame:
    """The way for filters and vocabularies of any size: the distinct n-grams of each bundle of documents are sent to the parts that
    hold their segments and counts, and what is read there meets the bundle again."""
    tops = {kind: r["top"] for kind, r in kinds.items()}
    extra = false_count(kinds[1]["n_set"] / (8 * kinds[1]["bytes"]), SCALES[1], tops[1]) * v if 1 in kinds else 0.0

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, size = [], [], 0
        for batch, data, off in blocks(batches):
            ids += batch.column("doc_id").to_pylist()
            held.append(tokens(data, off))
            size += len(data)
            if size >= BUNDLE:
                yield bundle(ids, held)
                ids, held, size = [], [], 0
        if ids:
            yield bundle(ids, held)

    def bundle(ids: list, held: list) -> pa.RecordBatch:
        distinct, which, often = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True, return_counts=True)
        lengths = np.concatenate([np.diff(toff) for _, toff in held])
        common = np.argsort(-often, kind="stable")  # common words get small numbers, which compress
        number = np.empty(len(common), np.int64)
        number[common] = np.arange(len(common))
        width = max(1, (len(distinct).bit_length() + 7) // 8)
        row = (uuid.uuid4().int >> 65, ids, lengths, planes(distinct[common], 8), squeezed(planes(number[which], width)), width)
        return made([row], [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int32()], ["block", "ids", "lengths", "words", "order", "width"])

    def opened(words_raw: pa.Buffer, order_raw: pa.Buffer, width: int, lengths: np.ndarray) -> tuple[np.ndarray, tuple, tuple]:
        distinct = unplanes(words_raw, 8)
        by_hash = np.argsort(distinct)
        place = np.empty(len(distinct), np.int64)
        place[by_hash] = np.arange(len(distinct))
        distinct, which = distinct[by_hash], place[unplanes(widened(order_raw), width).astype(np.int64)]
        toff = np.concatenate([[0], np.cumsum(lengths)])
        return toff, (distinct, which), np.unique(pairs(distinct[which], toff, parts), return_inverse=True)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lengths, w, o, width in zip(batch.column("block").to_pylist(), batch.column("lengths"), batch.column("words"), batch.column("order"), batch.column("width").to_pylist(), strict=True):
                _, one, two = opened(w.as_buffer(), o.as_buffer(), width, lengths.values.to_numpy())
                rows = [(kind, p, block, planes(x[a:b], WIDTH[kind]), None, None) for kind, x in enumerate((one[0], two[0])) for p, a, b in by_part(kind, x, parts)]
                yield made(rows, [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()], ["kind", "part", "block", "hashes", "counts", "segment"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, segment, known = None, None, None
        for batch in batches:
            out, asked = [], []

            def read() -> None:  # all that a batch asks of one part together
                if not asked:
                    return
                kind, part = asked[0][1:3]
                x, here = np.concatenate([a[3] for a in asked]), key == (kind, part)
                level = (segment.read(x, True) if here else np.full(len(x), SCALES[kind][1] - 1)).astype(np.int8)
                exact = found(*known, x) if here and not kind else np.zeros(len(x), np.int64)
                at = 0
                for block, *_, own in asked:
                    to = at + len(own)
                    out.append((block, kind, part, squeezed(level[at:to].tobytes()), None if kind else squeezed(planes(exact[at:to], 8))))
                    at = to
                asked.clear()

            for kind, part, block, h, c, bits in zip(*(batch.column(i).to_pylist() for i in range(3)), *(batch.column(i) for i in range(3, 6)), strict=True):
                if asked and asked[0][1:3] != (kind, part):
                    read()
                if block is None:  # a part comes before what is asked of it
                    bits = np.frombuffer(bits.as_buffer(), np.uint8)
                    key, segment = (kind, part), Filter(kind, np.array([0, 8 * len(bits)]), bits, tops[kind])
                    known = None if kind else (unplanes(h.as_buffer(), 8), unplanes(c.as_buffer(), 8).astype(np.int64))
                else:
                    asked.append((block, kind, part, ngrams(kind, part, h.as_buffer())))
            read()
            if out:
                yield made(out, [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()], ["block", "kind", "part", "levels", "exact"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, now, read, exact = None, None, ([], []), []
        for batch in batches:
            cols = [batch.column(c) for c in ("kind", "levels", "exact", "ids", "lengths", "words", "order", "width")]
            for i, (at, kind) in enumerate(zip(batch.column("block").to_pylist(), cols[0].to_pylist(), strict=True)):
                if kind < 0:  # a bundle comes before its answers, and these are in the order of its n-grams
                    if now:
                        yield judged(now, read, exact)
                    block, now, read, exact = at, [cols[3][i].values, cols[4][i].values.to_numpy(), cols[5][i].as_buffer(), cols[6][i].as_buffer(), cols[7][i].as_py()], ([], []), []
                    continue
                assert at == block
                read[kind].append(np.frombuffer(widened(cols[1][i].as_buffer()), np.int8))
                if not kind:
                    exact.append(unplanes(widened(cols[2][i].as_buffer()), 8).astype(np.int64))
        if now:
            yield judged(now, read, exact)

    def judged(now: list, read: tuple[list, list], exact: list) -> pa.RecordBatch:
        ids, lengths, w, o, width = now
        toff, one, two = opened(w, o, width, lengths)
        of = [count_at(np.concatenate(x).astype(np.int64), *SCALES[kind]) for kind, x in enumerate(read)]
        return scored(ids, toff, one, two[1], *of, np.concatenate(exact), extra, n, floor)

    bundles = stored(docs.mapInArrow(bundled, "block long, ids array<long>, lengths array<long>, words binary, order binary, width int"))
    held = counted.select("kind", "part", F.lit(None).cast("long").alias("block"), "hashes", "counts", "segment")
    asked = bundles.drop("ids").mapInArrow(ask, "kind int, part int, block long, hashes binary, counts binary, segment binary").union(held)
    asked = asked.repartition(partitions(docs.sparkSession), "kind", "part").sortWithinPartitions("kind", "part", F.col("block").asc_nulls_first())
    answers = asked.mapInArrow(answer, "block long, kind int, part int, levels binary, exact binary")
    both = bundles.withColumn("kind", F.lit(-1)).unionByName(answers, allowMissingColumns=True)
    both = both.repartition(partitions(docs.sparkSession), "block").sortWithinPartitions("block", "kind", "part")
    return both.mapInArrow(run, SCORED)
