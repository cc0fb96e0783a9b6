"""Removal of repeated byte strings with a sparse suffix array (operator 9).

A byte goes if a string of SPAN bytes that covers it also starts earlier (in a row of smaller id, or earlier
in the same text). Matches never cross texts and are judged on the input.

A suffix array of every position would move many times the input. This one is sparse, without losing a match:
of each SPAN-byte string the position of the least hash of its K-byte grams is an anchor, so equal strings
have anchors at equal places, and only the suffixes at anchors are entries.

1. Entries that are alike become one. Each anchor gets a key: the first bytes of its suffix, then a hash of its first K bytes; splitters
   sampled from the keys range-partition the entries, and in each part those of equal key, rest of the hash and hash of all
   bytes that a string with this anchor can reach (112 bits together) lie side by side. All but the earliest of them
   are covered whole. An entry whose first K bytes occur with no other reach is done with. A task does the same with its own
   entries before it deals them out, so a passage found in every document is dealt once a task.
2. The entries that are left over come back with the bytes of their reach. Splitters sampled from their suffixes range-partition
   them by their leading bytes, and each part sorts its suffixes by multikey quicksort, and likewise the bytes
   before the anchors, backwards. Common prefixes of neighbours, compared byte by byte, say which entries agree in which strings;
   all but the earliest are repeats. Borders lie between suffixes that differ in their first K bytes, unless more than a part's worth
   begin alike. A string that agrees with such a border up to its end can also lie beyond it: the earliest of each such string in each
   part are compared across the borders.

Null text is empty. Texts under SPAN bytes have no such strings. Where ids repeat or are null, the rows of an
id are ordered by their text's hash and are separate texts; nulls come first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.llm.common import _BYTE, blocks, mix, partitions, stored

SPAN, K = 100, 36
#: Anchors lie up to this many bytes after the start of their string.
REACH = SPAN - K
#: Bytes of text worth a part of the first sort, left-over entries worth a part of the second.
PART_BYTES, PART_ENTRIES = 16 << 20, 40_000
#: Bytes of text that a task sorts into parts together.
TOGETHER = 8 << 20
#: Bytes of a text that are hashed at once.
CHUNK = 1 << 20
#: Rows, and left-over entries, whose keys make splitters.
SAMPLE_ROWS, SAMPLE_KEYS = 2_000, 50_000
#: Touched texts whose ids may be broadcast (8 bytes each); beyond, they are joined.
MOST_IDS = 500_000
#: Suffixes that multikey quicksort leaves to a plain sort of the rest of their words.
FEW = 48

C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the K bytes from each position, by doubling."""
    h = _BYTE[data]
    doubled = {1: h}
    size = 1
    for c in C[:5]:
        h = h[: len(h) - size] * c + h[size:]
        size *= 2
        doubled[size] = h
    n = max(0, len(data) - K + 1)
    return mix(doubled[32][:n] * C[5] + doubled[4][32 : 32 + n])


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of a block's texts and the hashes of their K bytes."""
    n = len(data)
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    w = REACH + 1
    low = np.uint64((1 << 22) - 1)
    for at in range(0, max(0, n - SPAN + 1), CHUNK):
        h = gram_hashes(data[at : at + CHUNK + SPAN])
        many = min(CHUNK, n - SPAN + 1 - at)
        v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        full = -(-len(v) // w) * w
        v = np.concatenate([v, np.full(full - len(v), ~np.uint64(0))]).reshape(-1, w)
        ahead = np.minimum.accumulate(v, axis=1).ravel()
        behind = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:many], ahead[w - 1 : w - 1 + many])
        ok = np.ones(many, bool)  # strings that end within their text
        for e in off[1:][(off[1:] > at) & (off[1:] < at + many + SPAN)].tolist():
            ok[max(0, e - SPAN + 1 - at) : max(0, min(many, e - at))] = False
        mark = np.zeros(len(h), bool)
        mark[(least[ok] & low).astype(np.int64)] = True
        p = np.flatnonzero(mark)
        places.append(p + at)
        hashes.append(h[p])
    p, h = np.concatenate(places), np.concatenate(hashes)
    if len(places) > 2:
        p, first = np.unique(p, return_index=True)
        h = h[first]
    return p, h


def keys(data: np.ndarray, p: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The first four bytes of each suffix, then half of its hash."""
    lead = np.zeros(len(p), np.uint64)
    for i in range(4):
        lead = (lead << np.uint64(8)) | data[p + i].astype(np.uint64)
    return (lead << np.uint64(32)) | (h >> np.uint64(32))


def reaches(data: np.ndarray, p: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of all bytes that a string with this anchor can hold: REACH before it to SPAN after, within the text."""
    out = np.empty(len(p), np.uint64)
    full = (p - REACH >= start) & (p + SPAN <= end)
    at = p[full]
    if len(at):
        # K bytes at five places cover the reach: -64, -36, 0, 36 and 64.
        spread = np.array([-REACH, -K, 0, K, REACH])
        grid = at[:, None, None] + spread[None, :, None] + np.arange(0, K, 4)[None, None, :]
        total = np.zeros((len(at), len(spread)), np.uint64)
        for j in range(grid.shape[2]):
            word = np.zeros((len(at), len(spread)), np.uint64)
            for i in range(4):
                word = (word << np.uint64(8)) | data[grid[:, :, j] + i].astype(np.uint64)
            total = mix(total * C[0] + word)
        acc = np.zeros(len(at), np.uint64)
        for j in range(len(spread)):
            acc = mix(acc * C[1] + total[:, j])
        out[full] = acc
    for i in np.flatnonzero(~full).tolist():
        a, b = max(start[i], p[i] - REACH), min(end[i], p[i] + SPAN)
        out[i] = xxhash.xxh64_intdigest(data[a:b].tobytes(), seed=int((p[i] - a) * 1000 + b - p[i] + 1))
    return out


#: One entry as it moves: key, the rest of the hash and the reach's hash (high to low), place, number of its text in the parcel.
ENTRY = np.dtype([("key", "<u8"), ("rest", "<u2"), ("reach_hi", "<u2"), ("reach", "<u4"), ("at", "<u4"), ("doc", "<u4")])


def entries_of(ids: list, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    p, h = anchors(data, off)
    d = np.searchsorted(off, p, "right") - 1
    r = reaches(data, p, h, off[d], off[d + 1])
    out = np.empty(len(p), ENTRY)
    out["key"], out["rest"] = keys(data, p, h), h & np.uint64(0xFFFF)
    out["reach"], out["reach_hi"] = r & np.uint64(0xFFFFFFFF), (r >> np.uint64(32)) & np.uint64(0xFFFF)
    out["at"], out["doc"] = p - off[d], d
    return out


def parcel(ids: np.ndarray, e: np.ndarray) -> bytes:
    """Columns, as they compress better apart; texts are renumbered."""
    used, doc = np.unique(e["doc"], return_inverse=True)
    return np.array([len(used), len(e)], "<i8").tobytes() + ids[used].astype("<i8").tobytes() + b"".join(np.ascontiguousarray(e[c]).tobytes() for c in ENTRY.names[:-1]) + doc.astype("<u2" if len(used) < 1 << 16 else "<u4").tobytes()


def unparcel(raw: pa.Buffer) -> tuple[np.ndarray, list[np.ndarray]]:
    """The ids of the entries' texts, and their other columns."""
    n, m = np.frombuffer(raw, "<i8", 2)
    ids, at, cols = np.frombuffer(raw, "<i8", n, 16), 16 + 8 * n, []
    for name in ENTRY.names[:-1]:
        cols.append(np.frombuffer(raw, ENTRY[name], m, at))
        at += m * ENTRY[name].itemsize
    doc = np.frombuffer(raw, "<u2" if n < 1 << 16 else "<u4", m, at)
    return ids[doc], cols


def splitters(sample: np.ndarray, parts: int) -> np.ndarray:
    """parts - 1 or fewer keys, each the first of its part."""
    sample = np.sort(sample)
    return np.unique(sample[np.arange(1, parts) * len(sample) // parts]) if len(sample) else sample


def borders(sample: np.ndarray, parts: int) -> np.ndarray:
    """The same for suffixes. A border is K bytes long, so that nothing agrees across it, but within suffixes that begin alike and fill
    more than a part."""
    sample = np.sort(sample)
    full = [bytes(x) for x in sample[np.arange(1, parts) * len(sample) // parts]] if len(sample) else []
    return np.unique(np.array([x if i and full[i - 1][:K] == x[:K] else x[:K] for i, x in enumerate(full)], f"S{SPAN}"))


def in_parts(rows: DataFrame, work: Callable, schema: str) -> DataFrame:
    """work(part, payload buffers) -> batches, for each part of (part, payload); rows (id, places) without a payload are passed on as covered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            if batch.column(1).null_count:
                done, batch = batch.filter(batch.column(1).is_null()), batch.filter(batch.column(1).is_valid())
                yield pa.RecordBatch.from_arrays([done.column(2), pa.array(np.zeros(done.num_rows, np.int32)), done.column(3)], ["id", "kind", "places"])
            for part, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part != now and held:
                    yield from work(now, held)
                    held = []
                now = part
                held.append(x.as_buffer())
        if held:
            yield from work(now, held)

    n = partitions(rows.sparkSession)
    return rows.repartition(n, "part").sortWithinPartitions("part").mapInArrow(run, schema)


def places_of(i: np.ndarray, a: np.ndarray, kind: int) -> pa.RecordBatch:
    by = np.lexsort((a, i))
    i, a = i[by], a[by]
    first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
    ends = np.append(first, len(i)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(i[first]), pa.array(np.full(len(first), kind, np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(a.astype(np.int32)))], ["id", "kind", "places"])


def first_sort(payloads: list) -> Iterator[pa.RecordBatch]:
    """Of one part: (doc_id, kind, places): kind 0, covered whole; 1, left over."""
    got = [unparcel(x) for x in payloads]
    payloads.clear()
    ids = np.concatenate([x[0] for x in got])
    key, rest, high, reach, at = (np.concatenate([x[1][i] for x in got]) for i in range(5))
    del got
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    tied = np.zeros(len(order), bool)
    tied[same] = tied[same + 1] = True
    order = order[tied]
    if not len(order):
        return
    key, rest, ids, at = key[order], rest[order], ids[order], at[order]
    reach = reach[order].astype(np.uint64) | (high[order].astype(np.uint64) << np.uint64(32)) | (rest.astype(np.uint64) << np.uint64(48))
    # Ties of the key, by (rest, reach), then by place; the groups stay in the key's order.
    group = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]]))
    order = np.lexsort((at, ids, reach, group))
    group, reach, rest, ids, at, key = group[order], reach[order], rest[order], ids[order], at[order], key[order]
    new_group = np.concatenate([[True], (group[1:] != group[:-1]) | (rest[1:] != rest[:-1])])
    new_reach = new_group | np.concatenate([[True], reach[1:] != reach[:-1]])
    number = np.cumsum(new_group) - 1
    kinds = np.bincount(number, new_reach)
    left = new_reach & (kinds[number] > 1)
    for kind, use in ((0, ~new_reach), (1, left)):
        if use.any():
            yield places_of(ids[use], at[use], kind)


WIDE = REACH + SPAN
#: A left-over entry: its reach as bytes (zeros beyond the text), place, and the bytes of its text before and after the anchor.
LEFT = np.dtype([("id", "<i8"), ("at", "<u4"), ("before", "u1"), ("after", "u1"), ("reach", "u1", (WIDE,))])


def with_reach(doc: int, data: np.ndarray, places: np.ndarray) -> np.ndarray:
    out = np.zeros(len(places), LEFT)
    out["id"], out["at"] = doc, places
    out["before"], out["after"] = np.minimum(places, REACH), np.minimum(len(data) - places, SPAN)
    padded = np.concatenate([np.zeros(REACH, np.uint8), data, np.zeros(SPAN, np.uint8)])
    out["reach"] = np.lib.stride_tricks.sliding_window_view(padded, WIDE)[places]
    return out


def suffixes(e: np.ndarray) -> np.ndarray:
    """The bytes from each anchor on, as one sortable value: zeros beyond the text."""
    return np.ascontiguousarray(e["reach"][:, REACH:]).view(f"S{SPAN}").ravel()


def as_words(columns: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of big-endian words of eight, which compare as the bytes do."""
    width = -(-columns.shape[1] // 8) * 8
    full = np.zeros((len(columns), width), np.uint8)
    full[:, : columns.shape[1]] = columns
    return full.view(">u8").astype(np.uint64)


def multikey_order(columns: np.ndarray) -> np.ndarray:
    """The order of rows of bytes by multikey quicksort: rows are parted in three by a pivot's word, and those equal in it go on
    with the next word; a few rows are sorted by what is left of them."""
    words = as_words(columns)
    out, at = np.empty(len(words), np.int64), 0
    todo = [(np.arange(len(words)), 0)]
    while todo:
        rows, depth = todo.pop()
        if len(rows) <= FEW or depth == words.shape[1]:
            if depth < words.shape[1] and len(rows) > 1:
                rows = rows[np.lexsort(words[rows, depth:].T[::-1])]
            out[at : at + len(rows)] = rows
            at += len(rows)
            continue
        x = words[rows, depth]
        some = np.sort(x[:: max(1, len(x) // 99)])
        pivot = some[len(some) // 2]
        less, more = x < pivot, x > pivot
        todo += [(part, d) for part, d in ((rows[more], depth), (rows[~(less | more)], depth + 1), (rows[less], depth)) if len(part)]
    return out


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes the rows of a and b have in common from their start on."""
    differ = a != b
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


class Agreement:
    """Which rows of bytes agree in their first n bytes, for any n: neighbours in their order, and what these have in common."""

    def __init__(self, columns: np.ndarray) -> None:
        self.order = multikey_order(columns)
        now = columns[self.order]
        self.shared = common_prefix(now[1:], now[:-1])

    def classes(self, n: int) -> np.ndarray:
        """A number for each row; rows of one number agree in n bytes."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.concatenate([[0], np.cumsum(self.shared < n)])
        return out


def second_sort(payloads: list, borders: tuple[bytes, ...] = ()) -> Iterator[pa.RecordBatch]:
    """Of one part of left-over entries: (id, spans, string, start): start and end of what its repeated strings cover; and the
    earliest of each string that may also lie beyond one of the part's borders."""
    e = np.concatenate([np.frombuffer(x, LEFT) for x in payloads])
    payloads.clear()
    e = e[np.lexsort((e["at"], e["id"]))]
    ahead, behind = Agreement(e["reach"][:, REACH:]), Agreement(e["reach"][:, :REACH][:, ::-1])
    beyond = np.zeros(len(e), np.int64)
    for border in borders:
        beyond = np.maximum(beyond, common_prefix(e["reach"][:, REACH:], np.frombuffer(border.ljust(SPAN, b"\0"), np.uint8)[None, :]))
    low, high = np.full(len(e), 1 << 20), np.full(len(e), -(1 << 20))
    open_: list[tuple[np.ndarray, int]] = []
    for before in range(REACH + 1):  # strings that begin so many bytes before their anchor
        have = np.flatnonzero((e["before"] >= before) & (e["after"] >= SPAN - before))
        which = ahead.classes(SPAN - before)[have] * len(e) + behind.classes(before)[have]
        order = np.argsort(which, kind="stable")  # equal strings stay in the order of their places
        first = np.ones(len(order), bool)
        first[1:] = which[order[1:]] != which[order[:-1]]
        repeat = have[order[~first]]
        low[repeat] = np.minimum(low[repeat], -before)
        high[repeat] = np.maximum(high[repeat], -before)
        first = have[order[first]]
        open_.append((first[beyond[first] >= SPAN - before], before))
    hit = high >= low
    spans = spans_of(e["id"][hit], e["at"][hit].astype(np.int64) + low[hit], e["at"][hit].astype(np.int64) + high[hit] + SPAN)
    yield _found(spans.column(0), spans.column(1), None, None)
    for first, before in open_:
        if len(first):
            text = np.ascontiguousarray(e["reach"][first, REACH - before : REACH - before + SPAN])
            strings = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SPAN), len(first), [None, pa.py_buffer(text.tobytes())]).cast(pa.binary())
            yield _found(pa.array(e["id"][first]), pa.nulls(len(first), pa.list_(pa.int32())), strings, pa.array(e["at"][first].astype(np.int32) - np.int32(before)))


def _found(ids: pa.Array, spans: pa.Array, strings: pa.Array | None, starts: pa.Array | None) -> pa.RecordBatch:
    n = len(ids)
    return pa.RecordBatch.from_arrays([ids, spans, pa.nulls(n, pa.binary()) if strings is None else strings, pa.nulls(n, pa.int32()) if starts is None else starts], ["id", "spans", "string", "start"])


def spans_of(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """(id, spans as pairs), for ids in order."""
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    pairs = np.stack([start, end], 1).astype(np.int32).ravel()
    return pa.RecordBatch.from_arrays([pa.array(ids[first]), pa.ListArray.from_arrays(pa.array((2 * np.append(first, len(ids))).astype(np.int32)), pa.array(pairs))], ["id", "spans"])


def merged(size: int, places: list[np.ndarray], pairs: list[np.ndarray]) -> list[tuple[int, int]]:
    """Disjoint spans, in order, of a text of `size` bytes."""
    p = np.concatenate([np.zeros(0, np.int64), *places]).astype(np.int64)
    q = np.concatenate([np.zeros(0, np.int64), *pairs]).astype(np.int64).reshape(-1, 2)
    start = np.concatenate([np.maximum(p - REACH, 0), q[:, 0]])
    end = np.concatenate([np.minimum(p + SPAN, size), q[:, 1]])
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order]) if len(order) else end
    first = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]])) if len(start) else np.zeros(0, np.int64)
    last = np.append(first[1:] - 1, len(start) - 1) if len(start) else first
    return list(zip(start[first].tolist(), end[last].tolist(), strict=True))


def sole_ids(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(id, text and `keep`) with ids that order the rows and don't repeat; and, where doc_id isn't such an id, what (id) stands for."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text", *keep)
    odd = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or id is null")
    if odd.isEmpty():
        return rows, None
    made = stored(rows.withColumnRenamed("id", "doc_id").orderBy("doc_id", F.xxhash64("text")).select(F.monotonically_increasing_id().alias("id"), "doc_id", "text", *keep))
    return made.select("id", "text", *keep), made.select("id", "doc_id")


def find(rows: DataFrame) -> DataFrame:
    """(id, places, spans) of rows (id, text) with repeats: anchors whose whole reach goes, and further spans as pairs."""
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // PART_BYTES))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in blocks(batches):
            p, h = anchors(data, off)
            yield pa.RecordBatch.from_arrays([pa.array(keys(data, p, h)[:: max(1, len(p) // 4000)].view(np.int64))], ["key"])

    share = min(1.0, SAMPLE_ROWS / max(1, rows.count()))
    sample = [r[0] for r in rows.sample(share, 42).limit(2 * SAMPLE_ROWS).select("text").mapInArrow(sampled, "key long").sample(0.25, 42).limit(200_000).collect()] if parts > 1 else []
    cuts = splitters(np.array(sample, np.int64).view(np.uint64), parts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, size, n = [], [], 0, 0
        for batch, data, off in blocks(batches):
            own = batch.column("id").to_pylist()
            e = entries_of(own, data, off)
            e["doc"] += n
            n += len(own)
            held.append(e)
            ids += own
            size += len(data)
            if size >= TOGETHER:
                yield from dealt(held, ids)
                held, ids, size, n = [], [], 0, 0
        yield from dealt(held, ids)

    def dealt(held: list, ids: list) -> Iterator[pa.RecordBatch]:
        if not sum(map(len, held)):
            return
        e, ids = np.concatenate(held), np.array(ids, np.int64)
        # Alike entries of a task: the earliest goes on, and the others only as places that are covered.
        e = e[np.lexsort((e["at"], ids[e["doc"]], e["reach"], e["reach_hi"], e["rest"], e["key"]))]
        alike = np.concatenate([[False], np.logical_and.reduce([e[c][1:] == e[c][:-1] for c in ("key", "rest", "reach_hi", "reach")])])
        covered, e = e[alike], e[~alike]
        part = np.searchsorted(cuts, e["key"], "right")
        bounds = np.searchsorted(part, np.arange(len(cuts) + 2))
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([parcel(ids, e[bounds[k] : bounds[k + 1]])], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32()))], DEALT)
        if len(covered):
            done = places_of(ids[covered["doc"]], covered["at"], 0)
            n = done.num_rows
            yield pa.RecordBatch.from_arrays([pa.array((len(cuts) + 1 + np.arange(n) % tasks).astype(np.int32)), pa.nulls(n, pa.binary()), done.column(0), done.column(2)], DEALT)

    DEALT, tasks = ["part", "payload", "id", "places"], partitions(spark)
    entries = rows.mapInArrow(deal, "part int, payload binary, id long, places array<int>")
    sorted_once = stored(in_parts(entries, lambda part, held: first_sort(held), "id long, kind int, places array<int>"))
    whole = sorted_once.filter("kind = 0").select("id", "places", F.array().cast("array<int>").alias("spans"))
    left = sorted_once.filter("kind = 1").groupBy("id").agg(F.flatten(F.collect_list("places")).alias("places"))
    n_left = sorted_once.filter("kind = 1").agg(F.sum(F.size("places"))).first()[0] or 0
    if not n_left:
        return whole
    left = stored(left)
    texts = rows.join(F.broadcast(left) if left.count() <= MOST_IDS and n_left <= 8 * MOST_IDS else left, "id")
    parts = -(-n_left // PART_ENTRIES)
    entries = stored(texts.mapInArrow(_reached, "payload binary"))
    share = min(1.0, SAMPLE_KEYS / n_left)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("payload"):
                e = np.frombuffer(x.as_buffer(), LEFT)
                chosen = np.random.default_rng(int(e["id"][0]) & 0xFFFFFFFF).random(len(e)) < share
                yield pa.RecordBatch.from_arrays([pa.array(suffixes(e[chosen]).tolist(), pa.binary())], ["key"])

    sample = np.array([bytes(r[0]) for r in entries.mapInArrow(keyed, "key binary").collect()] if parts > 1 else [], f"S{SPAN}")  # about SAMPLE_KEYS rows
    fine = borders(sample, parts)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = np.concatenate([np.frombuffer(x.as_buffer(), LEFT) for x in batch.column("payload")])
            part = np.searchsorted(fine, suffixes(e), "right")
            order = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(len(fine) + 2))
            some = np.flatnonzero(np.diff(bounds))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([e[order[bounds[k] : bounds[k + 1]]].tobytes() for k in some.tolist()], pa.binary())], ["part", "payload"])

    def in_order(part: int, held: list) -> Iterator[pa.RecordBatch]:
        return second_sort(held, tuple(x for x in map(bytes, fine[max(0, part - 1) : part + 1]) if len(x) > K))

    found = stored(in_parts(entries.mapInArrow(again, "part int, payload binary"), in_order, "id long, spans array<int>, string binary, start int"))
    # Across the borders: of each string the earliest of all parts stays, those of other parts are repeats.
    edges = found.filter("string is not null").select("string", "id", "start")
    first = edges.groupBy("string").agg(F.min(F.struct("id", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = edges.join(first, "string").filter("struct(id, start) > first").groupBy("id").agg(F.flatten(F.collect_list(F.array("start", F.col("start") + F.lit(SPAN)))).alias("spans"))
    found = found.filter("string is null").select("id", "spans").unionByName(later)
    return whole.unionByName(found.select("id", F.array().cast("array<int>").alias("places"), "spans"))


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Left-over entries with the bytes of their reach, a few thousand a row."""
    held: list[np.ndarray] = []
    for batch, data, off in blocks(batches):
        for d, doc in enumerate(batch.column("id").to_pylist()):
            held.append(with_reach(doc, data[off[d] : off[d + 1]], np.array(batch.column("places")[d].as_py(), np.int64)))
        if sum(map(len, held)) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], ["payload"])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], ["payload"])


def remove_repeats(docs: DataFrame, make: Callable[[bytes, list[tuple[int, int]]], tuple], schema: str, kinds: list[pa.DataType], keep: list[str] | None = None) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, the columns of `keep`, and make(UTF-8 bytes, disjoint repeated spans), of the given schema."""
    keep = keep or []
    full, stands_for = sole_ids(docs, keep)
    rows = full.select("id", "text")
    carried = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in full.schema if f.name in keep)
    found = stored(find(rows))
    found = stored(found.groupBy("id").agg(F.flatten(F.collect_list("places")).alias("places"), F.flatten(F.collect_list("spans")).alias("spans")))
    names = [x.split()[0] for x in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in blocks(batches):
            got = []
            touched = "places" in batch.schema.names
            for d in range(batch.num_rows):
                text = data[off[d] : off[d + 1]].tobytes()
                places = [np.array(batch.column(c)[d].as_py() or [], np.int64) for c in ("places", "spans")] if touched else [[], []]
                got.append(make(text, merged(len(text), [places[0]], [places[1]]) if touched else []))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(batch.column(c) for c in keep), *(pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True))], ["id", *keep, *names])

    if found.count() <= MOST_IDS:
        ids = F.broadcast(found.select("id"))
        clean = full.join(ids, "id", "left_anti").mapInArrow(cut, f"id long, {carried}{schema}")
        out = clean.union(full.join(ids, "id", "left_semi").join(found.hint("merge"), "id").mapInArrow(cut, f"id long, {carried}{schema}"))
    else:
        out = full.join(found, "id", "left").mapInArrow(cut, f"id long, {carried}{schema}")
    if stands_for is None:
        return out.withColumnRenamed("id", "doc_id")
    return out.join(stands_for, "id").select("doc_id", *keep, *names)


def digest(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    kept, at = hashlib.sha256(), 0
    for a, b in spans:
        kept.update(text[at:a])
        at = b
    kept.update(text[at:])
    return len(text), sum(b - a for a, b in spans), len(spans), kept.hexdigest()


def removal_digests(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", [pa.int64(), pa.int64(), pa.int64(), pa.string()])


def kept_text(text: bytes, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without its repeats. A character is only cut whole: a span gives up the bytes of characters it cuts into."""
    out, at = [], 0
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        out.append(text[at:a])
        at = b
    kept = b"".join([*out, text[at:]]).decode()
    return kept, len(text) - len(kept.encode())


def without_repeats(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id, the columns of `keep`, kept (text) and n_cut (bytes) of each row."""
    return remove_repeats(docs, kept_text, "kept string, n_cut long", [pa.string(), pa.int64()], keep)
