"""Media columns by signature sniffing (operator 10).

An Aho-Corasick automaton finds magic bytes anywhere in a value; a validator of each format then confirms
structure and length, so that a chance match is not a medium. The type found corrects the declared one, and
media that lie inside other bytes are carved out by their confirmed extents.

Null values and empty values have no media. Nothing is assumed of a declared type, which may be null.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A record of samples is this many bytes; 255 fills the last one.
RECORD = 576
RATE = 8000


def _wav(b: bytes, at: int) -> int | None:
    if b[at + 8 : at + 12] != b"WAVE" or len(b) < at + 12:
        return None
    end, p, seen = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12, set()
    while p + 8 <= end:
        seen.add(b[p : p + 4])
        n = struct.unpack_from("<I", b, p + 4)[0] if p + 8 <= len(b) else end
        p += 8 + n + (n & 1)
    return end if end <= len(b) and p == end and {b"fmt ", b"data"} <= seen else None


def _png(b: bytes, at: int) -> int | None:
    p = at + 8
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or (p == at + 8) != (kind == b"IHDR") or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None
        p += 12 + n
        if kind == b"IEND":
            return p
    return None


def _gif(b: bytes, at: int) -> int | None:
    if len(b) < at + 13 or not struct.unpack_from("<H", b, at + 6)[0] or not struct.unpack_from("<H", b, at + 8)[0]:
        return None
    p = at + 13 + (3 << (b[at + 10] & 7) + 1) * (b[at + 10] >> 7)
    while p < len(b):
        mark = b[p]
        if mark == 0x3B:
            return p + 1
        if mark == 0x2C and p + 10 < len(b):
            p += 10 + (3 << (b[p + 9] & 7) + 1) * (b[p + 9] >> 7) + 1
        elif mark == 0x21:
            p += 2
        else:
            return None
        while p < len(b) and b[p]:
            p += 1 + b[p]
        p += 1
    return None


def _bmp(b: bytes, at: int) -> int | None:
    if len(b) < at + 30:
        return None
    n, pixels, head = struct.unpack_from("<I4xII", b, at + 2)
    depth = struct.unpack_from("<H", b, at + 28)[0]
    return at + n if head in (40, 108, 124) and 14 + head <= pixels <= n and at + n <= len(b) and depth in (1, 4, 8, 16, 24, 32) else None


def _jpeg(b: bytes, at: int) -> int | None:
    p, frame = at + 2, False
    while p + 4 <= len(b) and b[p] == 0xFF:
        mark = b[p + 1]
        if mark == 0xFF:
            p += 1
            continue
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2 or mark < 0xC0:
            return None
        frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        p += 2 + n
        if mark == 0xDA:
            end = b.find(b"\xff\xd9", p)
            return end + 2 if frame and end >= 0 else None
    return None


def _pdf(b: bytes, at: int) -> int | None:
    if not b[at + 5 : at + 6].isdigit() or b[at + 6 : at + 7] != b".":
        return None
    following = b.find(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, following if following >= 0 else len(b))
    return end + 5 if end >= 0 and b.find(b"startxref", at, end) >= 0 else None


def _gzip(b: bytes, at: int) -> int | None:
    try:
        d = zlib.decompressobj(31)
        d.decompress(b[at:], 1 << 16)
        while not d.eof and d.unconsumed_tail:
            d.decompress(d.unconsumed_tail, 1 << 16)
        return len(b) - len(d.unused_data) if d.eof else None
    except zlib.error:
        return None


#: Signatures of the formats and the media types they stand for.
FORMATS: list[tuple[bytes, str, Callable[[bytes, int], int | None]]] = [
    (b"RIFF", "audio/wav", _wav),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"BM", "image/bmp", _bmp),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"%PDF-", "application/pdf", _pdf),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
]


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    made = ahocorasick.Automaton()
    for i, (magic, _, _) in enumerate(FORMATS):
        made.add_word(magic.decode("latin-1"), i)
    made.make_automaton()
    return made


def media_in(value: bytes | None) -> list[tuple[int, int, str]]:
    """(start, end, type) of each confirmed medium, outermost first; none lies within another that is listed.

    A medium that is confirmed hides what lies inside it. Two that start at one byte: the longer one counts.
    """
    out: list[tuple[int, int, str]] = []
    if not value:
        return out
    done = 0
    for last, i in automaton().iter(value.decode("latin-1")):
        magic, kind, confirm = FORMATS[i]
        at = last + 1 - len(magic)
        if at >= done and (end := confirm(value, at)) is not None:
            out.append((at, end, kind))
            done = end
    return out


def sniff(rows: DataFrame, value: str, declared: str | None = None) -> DataFrame:
    """Adds media array<struct<start,end,type,bytes>>, media_type (of a value that is one medium; else the declared type) and corrected."""
    schema = rows.sparkSession.createDataFrame([], rows.schema).schema
    said = declared if declared else None
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name not in ("media", "media_type", "corrected"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("type", pa.string()), ("bytes", pa.binary())]))
        for batch in batches:
            values = batch.column(value).to_pylist()
            stated = batch.column(said).to_pylist() if said else [None] * len(values)
            media = [media_in(v) for v in values]
            kinds = [m[0][2] if len(m) == 1 and m[0][:2] == (0, len(v)) else s for v, m, s in zip(values, media, stated, strict=True)]
            cols = [batch.column(c) for c in batch.schema.names if c not in ("media", "media_type", "corrected")]
            cols += [pa.array([[{"start": a, "end": z, "type": k, "bytes": v[a:z]} for a, z, k in m] for v, m in zip(values, media, strict=True)], kind), pa.array(kinds, pa.string()), pa.array([k != s for k, s in zip(kinds, stated, strict=True)], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, [c for c in batch.schema.names if c not in ("media", "media_type", "corrected")] + ["media", "media_type", "corrected"])

    return rows.mapInArrow(found, f"{fields}, media array<struct<start:long,end:long,type:string,bytes:binary>>, media_type string, corrected boolean")


def as_wave(payload: bytes) -> bytes:
    """The payload as 8-bit mono samples of a RIFF wave file; its length must be even."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def samples(wave: bytes) -> bytes:
    """The samples of a confirmed wave file."""
    p = 12
    while wave[p : p + 4] != b"data":
        n = struct.unpack_from("<I", wave, p + 4)[0]
        p += 8 + n + (n & 1)
    return wave[p + 8 : p + 8 + struct.unpack_from("<I", wave, p + 4)[0]]


def texts_as_media(docs: DataFrame) -> DataFrame:
    """Each text as a wave file: doc_id, n_bytes, media (the stored form)."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [(x.as_py() or "").encode() for x in part.column(1)]
                media = [as_wave(r + b"\xff" * (max(1, -(-len(r) // RECORD)) * RECORD - len(r))) for r in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(put, "doc_id long, n_bytes long, media binary")


def media_features(stored: DataFrame, declared: str | None = None) -> DataFrame:
    """Sniffs the stored bytes (doc_id, n_bytes, media), carves the first medium out of what else is there, reads its samples back and
    describes them. declared: a column of types as they were declared; media_type and corrected tell the type found, and whether it differs."""
    rows = stored.select("doc_id", "n_bytes", "media", (F.col(declared) if declared else F.lit(None).cast("string")).alias("declared"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, n, cell, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                medium = cell.as_py()
                (start, end, kind), *others = media_in(medium) or [(0, len(medium), "unknown")]
                medium = medium[start:end]
                payload = samples(medium) if kind == "audio/wav" else medium
                x = np.frombuffer(payload, np.uint8)
                level = np.bincount(x, minlength=256)
                mean = int(level @ np.arange(256)) * 1000 // max(1, len(x))
                feature = f"{kind};{RATE}Hz;8bit;mono;records={len(x) // RECORD};mean={mean};levels={int((level > 0).sum())};peak={int(level.argmax())};others={len(others)}"
                out.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), end - start, hashlib.sha256(medium).hexdigest(), feature, kind, kind != said))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 10, kinds, strict=True)], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "corrected"]
    found = rows.mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, corrected boolean")
    return found if declared else found.drop("media_type", "corrected")
