"""Tables from the numbers of a character collection's glyphs to text, and their file format.

A file is a magic word, the length of the payload, and the payload in raw deflate. The payload has the number of glyphs, three
planes of bytes (high, middle, low) of a value for each, and an area of strings. A value is 0 for none, a code point, or
past the last code point the place of a string, which has its length before it. All numbers are big-endian.
"""

from __future__ import annotations

import os
import struct
import zlib
from functools import lru_cache

from parchmill.kernel.glyphs import character

#: The magic word, the first value that is a place, and the collections' names.
MAGIC, PLACES, LARGEST = b"YCD1", 0x110000, 1 << 24
ORDERINGS = ("Japan1", "GB1", "CNS1", "Korea1", "KR")


class Collection:
    def __init__(self, payload: bytes) -> None:
        self.n = struct.unpack_from(">I", payload)[0]
        self.high, self.middle, self.low = (payload[4 + i * self.n : 4 + (i + 1) * self.n] for i in range(3))
        self.strings = payload[4 + 3 * self.n :]

    def get(self, cid: int) -> str | None:
        if not 1 <= cid < self.n:
            return None
        value = self.high[cid] << 16 | self.middle[cid] << 8 | self.low[cid]
        if value < PLACES:
            return character(value) if value else None
        at = value - PLACES
        size = self.strings[at] if at < len(self.strings) else 0
        text = self.strings[at + 1 : at + 1 + size]
        return text.decode("utf-8", "ignore") if size and len(text) == size else None

    def rows(self) -> list[tuple[int, str]]:
        return [(cid, text) for cid in range(1, self.n) if (text := self.get(cid)) is not None]


def read(data: bytes) -> Collection | None:
    """The table in a file's bytes; None for a damaged one."""
    if data[:4] != MAGIC or len(data) <= 8:
        return None
    size = struct.unpack_from(">I", data, 4)[0]
    if not 4 <= size <= LARGEST:
        return None
    try:
        payload = zlib.decompressobj(-15).decompress(data[8:], size + 1)
    except zlib.error:
        return None
    return Collection(payload) if len(payload) == size and size >= 4 + 3 * struct.unpack_from(">I", payload)[0] else None


def written(texts: dict[int, str]) -> bytes:
    """A file of the texts by number; equal texts share their string."""
    n = max(texts, default=0) + 1
    values, strings, places = [0] * n, bytearray(), {}
    for cid, text in sorted(texts.items()):
        if len(text) == 1:
            values[cid] = ord(text)
        elif text:
            if text not in places:
                places[text] = len(strings)
                raw = text.encode()
                strings += bytes([len(raw)]) + raw
            values[cid] = PLACES + places[text]
    payload = struct.pack(">I", n) + b"".join(bytes(v >> s & 255 for v in values) for s in (16, 8, 0)) + bytes(strings)
    packer = zlib.compressobj(9, zlib.DEFLATED, -15)
    return MAGIC + struct.pack(">I", len(payload)) + packer.compress(payload) + packer.flush()


def merged(first: dict[int, str], second: dict[int, str]) -> dict[int, str]:
    """What the first source has, and of the second the numbers that the first lacks."""
    return second | first


@lru_cache(maxsize=16)
def loaded(folder: str, ordering: str) -> Collection | None:
    ordering = ordering.rstrip("\0 ")
    if ordering not in ORDERINGS:
        return None
    try:
        with open(os.path.join(folder, f"{ordering}.bin"), "rb") as f:
            return read(f.read())
    except OSError:
        return None
