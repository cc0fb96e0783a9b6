"""Stream filters. Each stops at a limit, and takes what it can from damaged data."""

from __future__ import annotations

import re
import zlib

import numpy as np

#: Filters of images, whose streams are never unpacked.
IMAGES = frozenset("DCTDecode DCT JPXDecode CCITTFaxDecode CCF JBIG2Decode".split())


def decode(data: bytes, names: list[str], settings: list[dict], limit: int) -> tuple[bytes, bool]:
    """Applies the filters in turn; unknown ones pass their data on. Also says whether the limit cut something off."""
    cut = False
    for name, parms in zip(names, settings, strict=False):
        if name in ("FlateDecode", "Fl"):
            data = predicted(inflate(data, limit + 1), parms)
        elif name in ("LZWDecode", "LZW"):
            early = parms.get("EarlyChange", 1)
            data = predicted(lzw(data, limit + 1, early if isinstance(early, int) else 1), parms)
        elif name in ("ASCII85Decode", "A85"):
            data = ascii85(data)
        elif name in ("ASCIIHexDecode", "AHx"):
            data = ascii_hex(data)
        elif name in ("RunLengthDecode", "RL"):
            data = run_length(data, limit + 1)
        if len(data) > limit:
            data, cut = data[:limit], True
    return data, cut


def inflate(data: bytes, most: int) -> bytes:
    """zlib data, or bare deflate; of damaged data the longest part that unpacks."""
    best = b""
    for bits in (15, -15):
        engine, out, at = zlib.decompressobj(bits), [], 0
        size = 0
        try:
            while at < len(data) and size < most and not engine.eof:
                part = engine.decompress(data[at : at + 65536], most - size)
                out.append(part)
                size += len(part)
                at += 65536
                while engine.unconsumed_tail and size < most:
                    part = engine.decompress(engine.unconsumed_tail, most - size)
                    out.append(part)
                    size += len(part)
        except zlib.error:
            # The last chunk holds the damage: feed it again in small steps, as far as it goes.
            whole = b"".join(out)
            engine = zlib.decompressobj(bits)
            out, size = [], 0
            try:
                for i in range(0, len(data), 64 if len(data) < 1 << 20 else 4096):
                    part = engine.decompress(engine.unconsumed_tail + data[i : i + (64 if len(data) < 1 << 20 else 4096)], most - size)
                    out.append(part)
                    size += len(part)
                    if size >= most:
                        break
            except zlib.error:
                pass
            if len(whole) > size:
                out = [whole]
        got = b"".join(out)
        if engine.eof and got or len(got) >= most:
            return got
        if len(got) > len(best):
            best = got
    return best


def predicted(data: bytes, parms: dict) -> bytes:
    """Undoes a PNG or TIFF predictor."""
    def whole(key: str, default: int) -> int:
        value = parms.get(key, default)
        return value if isinstance(value, int) and value > 0 else default

    kind = whole("Predictor", 1)
    if kind < 2 or not data:
        return data
    colors, depth, columns = min(256, whole("Colors", 1)), min(16, whole("BitsPerComponent", 8)), whole("Columns", 1)
    step = max(1, colors * depth // 8)
    row = (colors * depth * columns + 7) // 8
    if row > 65536:
        return data
    if kind == 2:
        if depth != 8:
            return data
        full = len(data) // row * row
        grid = np.frombuffer(data[:full], np.uint8).reshape(-1, columns, colors)
        rest = np.frombuffer(data[full:], np.uint8)
        tail = rest[: len(rest) // colors * colors].reshape(-1, colors)
        return np.cumsum(grid, 1, dtype=np.uint8).tobytes() + np.cumsum(tail, 0, dtype=np.uint8).tobytes() + rest[len(tail) * colors :].tobytes()
    out, above = [], bytearray(row)
    for at in range(0, len(data), row + 1):
        tag, line = data[at], bytearray(data[at + 1 : at + 1 + row])
        if not line:
            break
        if tag == 1:
            for i in range(step, len(line)):
                line[i] = line[i] + line[i - step] & 255
        elif tag == 2:
            line = bytearray((np.frombuffer(bytes(line), np.uint8) + np.frombuffer(bytes(above[: len(line)]), np.uint8)).tobytes())
        elif tag == 3:
            for i in range(len(line)):
                line[i] = line[i] + ((line[i - step] if i >= step else 0) + above[i] >> 1) & 255
        elif tag == 4:
            for i in range(len(line)):
                a, b, c = (line[i - step], above[i], above[i - step]) if i >= step else (0, above[i], 0)
                p = a + b - c
                x, y, z = abs(p - a), abs(p - b), abs(p - c)
                line[i] = line[i] + (a if x <= y and x <= z else b if y <= z else c) & 255
        out.append(bytes(line))
        above = line + bytes(row - len(line))
    return b"".join(out)


def lzw(data: bytes, most: int, early: int = 1) -> bytes:
    out, size = [], 0
    table: list[bytes] = [bytes([i]) for i in range(256)] + [b"", b""]
    width, held, bits, last = 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if code == 257:
            break
        if code < len(table):
            entry = table[code]
        elif last:
            entry = last + last[:1]
        else:
            break
        out.append(entry)
        size += len(entry)
        if size >= most:
            break
        if last and len(table) < 4096:
            table.append(last + entry[:1])
        last = entry
        width = min(12, max(9, (len(table) + (1 if early else 0)).bit_length())) if len(table) > 258 else 9
    return b"".join(out)


def ascii85(data: bytes) -> bytes:
    data = re.sub(rb"[\0\t\n\f\r ]", b"", data)
    data = data[2:] if data[:2] == b"<~" else data
    data = data.partition(b"~")[0]
    out, group = bytearray(), []
    for c in data:
        if c == 122 and not group:
            out += b"\0\0\0\0"
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += (_base85(group) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        n = len(group)
        out += (_base85(group + [84] * (5 - n)) & 0xFFFFFFFF).to_bytes(4, "big")[: n - 1]
    return bytes(out)


def _base85(group: list[int]) -> int:
    value = 0
    for x in group:
        value = value * 85 + x
    return value


def ascii_hex(data: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.partition(b">")[0])
    return bytes.fromhex((digits + b"0" * (len(digits) & 1)).decode())


def run_length(data: bytes, most: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and data[i] != 128 and len(out) < most:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)
