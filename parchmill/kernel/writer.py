"""Writes small PDFs: from content streams, and from plain text in a font that carries every character."""

from __future__ import annotations

import base64
import hashlib
import zlib

from parchmill.kernel.crypto import PAD, cbc_encrypt, hash_r6, rc4


def stream(data: bytes, head: str = "") -> bytes:
    return f"<< {head} /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream"


def lzw(data: bytes) -> bytes:
    """LZW with a clear code before the table is full."""
    bits = n = 0

    out = bytearray()
    table = {bytes([i]): i for i in range(256)}
    size, width, word = 258, 9, b""

    def put(code: int) -> None:
        nonlocal bits, n
        bits, n = bits << width | code, n + width
        while n >= 8:
            n -= 8
            out.append(bits >> n & 255)
        bits &= (1 << n) - 1

    put(256)
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = size
        size += 1
        if size + 1 > 1 << width:
            width += 1
        if size >= 4094:
            put(256)
            table = {bytes([k]): k for k in range(256)}
            size, width = 258, 9
        word = data[i : i + 1]
    if word:
        put(table[word])
    put(257)
    if n:
        out.append(bits << 8 - n & 255)
    return bytes(out)


def run_length(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 128]) - 1]) + data[i : i + 128] for i in range(0, len(data), 128)) + b"\x80"


def ascii85(data: bytes) -> bytes:
    return base64.a85encode(data) + b"~>"


def up_predicted(data: bytes, columns: int = 16) -> bytes:
    """PNG rows that each hold the difference from the row above."""
    data += b" " * (-len(data) % columns)
    above, out = bytes(columns), bytearray()
    for i in range(0, len(data), columns):
        row = data[i : i + columns]
        out += b"\x02" + bytes((a - b) & 255 for a, b in zip(row, above, strict=True))
        above = row
    return bytes(out)


def left_predicted(data: bytes, columns: int = 16) -> bytes:
    """TIFF rows of one byte a pixel, each the difference from the one to the left."""
    data += b" " * (-len(data) % columns)
    return b"".join(bytes([data[i]]) + bytes((a - b) & 255 for a, b in zip(data[i + 1 : i + columns], data[i : i + columns], strict=False)) for i in range(0, len(data), columns))


#: How a content stream may be packed: its dictionary and its bytes.
PACKINGS = {
    "plain": lambda d: ("", d),
    "flate": lambda d: ("/Filter /FlateDecode", zlib.compress(d)),
    "lzw": lambda d: ("/Filter /LZWDecode", lzw(d)),
    "a85": lambda d: ("/Filter [/ASCII85Decode /FlateDecode]", ascii85(zlib.compress(d))),
    "hex": lambda d: ("/Filter /ASCIIHexDecode", d.hex().encode() + b">"),
    "rl": lambda d: ("/Filter /RunLengthDecode", run_length(d)),
    "tiff": lambda d: ("/Filter /FlateDecode /DecodeParms << /Predictor 2 /Columns 16 >>", zlib.compress(left_predicted(d))),
    "png": lambda d: ("/Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 16 >>", zlib.compress(up_predicted(d))),
}


def objects(pages: list[bytes], fonts: dict[str, str] | None = None, extra: dict[int, bytes] | None = None, packing: str = "plain", info: str | None = None) -> dict[int, bytes]:
    """Objects by number: catalog 1, page tree 2, fonts from 10, pages and their contents from 30."""
    out: dict[int, bytes] = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}
    names = fonts or {"F1": "/Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding"}
    for i, body in enumerate(names.values()):
        out[10 + i] = f"<< /Type /Font {body} >>".encode()
    listed = " ".join(f"/{n} {10 + i} 0 R" for i, n in enumerate(names))
    base = 30 if len(pages) < 30 else 1000
    kids = " ".join(f"{base + 2 * i} 0 R" for i in range(len(pages)))
    out[2] = f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} /MediaBox [0 0 612 792] >>".encode()
    forms = " ".join(f"/{n.decode()} {k} 0 R" for k, v in (extra or {}).items() for n in [b"Fm%d" % (k - 95)] if b"/Form" in v)
    for i, content in enumerate(pages):
        head, data = PACKINGS[packing](content)
        out[base + 2 * i] = f"<< /Type /Page /Parent 2 0 R /Contents {base + 1 + 2 * i} 0 R /Resources << /Font << {listed} >> /XObject << {forms} >> >> >>".encode()
        out[base + 1 + 2 * i] = stream(data, head)
    out |= extra or {}
    if info:
        out[5] = info.encode("latin-1")
    return out


def assembled(objs: dict[int, bytes], encrypt: dict | None = None, modern: bool = False) -> bytes:
    """A file of the objects; modern: those that aren't streams go into an object stream, under a cross-reference stream."""
    out = bytearray(b"%PDF-1.5\n" if modern else b"%PDF-1.4\n")
    at: dict[int, int] = {}
    packed: list[int] = []
    trailer = "/Root 1 0 R" + (" /Info 5 0 R" if 5 in objs else "")
    if encrypt:
        trailer += f" /Encrypt << {encrypt['dict']} >> /ID [<{encrypt['id'].hex()}> <{encrypt['id'].hex()}>]"
    if modern:
        packed = [n for n, b in objs.items() if b"stream\n" not in b]
        bodies, heads, size = [], [], 0
        for n in packed:
            heads.append(f"{n} {size}")
            bodies.append(objs[n])
            size += len(objs[n]) + 1
        head = " ".join(heads).encode() + b" "
        data = zlib.compress(head + b" ".join(bodies))
        box = max(objs) + 1
        objs = {n: b for n, b in objs.items() if n not in packed} | {box: stream(data, f"/Type /ObjStm /N {len(packed)} /First {len(head)} /Filter /FlateDecode")}
    for n, body in objs.items():
        at[n] = len(out)
        if encrypt and b"stream\n" in body and b"/Type /ObjStm" not in body[:40] or encrypt and modern and b"stream\n" in body:
            body = encrypt["stream"](n, body)
        out += f"{n} 0 obj\n".encode() + body + b"\nendobj\n"
    top = max(objs) + 1
    start = len(out)
    if modern:
        rows = {n: (1, at[n], 0) for n in at} | {n: (2, box, i) for i, n in enumerate(packed)} | {top: (1, start, 0)}
        table = b"".join(bytes([rows.get(n, (0, 0, 0))[0]]) + rows.get(n, (0, 0, 0))[1].to_bytes(4, "big") + rows.get(n, (0, 0, 0))[2].to_bytes(2, "big") for n in range(top + 1))
        out += f"{top} 0 obj\n".encode() + stream(zlib.compress(table), f"/Type /XRef /W [1 4 2] /Size {top + 1} /Filter /FlateDecode {trailer}") + b"\nendobj\n"
    else:
        out += f"xref\n0 {top}\n".encode()
        for n in range(top):
            out += f"{at[n]:010d} 00000 n \n".encode() if n in at else b"0000000000 65535 f \n"
        out += f"trailer\n<< /Size {top} {trailer} >>\n".encode()
    return bytes(out + f"startxref\n{start}\n%%EOF".encode())


def build(pages: list[bytes | str], fonts: dict[str, str] | None = None, extra: dict[int, bytes] | None = None, packing: str = "plain", **more) -> bytes:
    return assembled(objects([p.encode("latin-1") if isinstance(p, str) else p for p in pages], fonts, extra, packing, more.get("info")), more.get("encrypt"), more.get("modern", False))


def lock(kind: str, password: str = "", seed: bytes = b"0123456789abcdef") -> dict:
    """What `assembled` needs to encrypt: kind rc4 (128 bits), aes (128 bits) or aes256."""
    if kind == "aes256":
        return lock_256(password.encode(), seed)
    key_bytes, permissions = 16, b"\xfc\xff\xff\xff"
    h = hashlib.md5((b"owner" + PAD)[:32]).digest()
    for _ in range(50):
        h = hashlib.md5(h).digest()
    owner = (password.encode() + PAD)[:32]
    for i in range(20):
        owner = rc4(bytes(b ^ i for b in h), owner)
    version = 4 if kind == "aes" else 2
    key = hashlib.md5((password.encode() + PAD)[:32] + owner + permissions + seed).digest()
    for _ in range(50):
        key = hashlib.md5(key[:key_bytes]).digest()
    user = hashlib.md5(PAD + seed).digest()
    for i in range(20):
        user = rc4(bytes(b ^ i for b in key), user)
    told = f"/Filter /Standard /V {version} /R {version if version == 4 else 3} /Length 128 /P -4 /O <{owner.hex()}> /U <{(user + bytes(16)).hex()}>"
    if kind == "aes":
        told += " /CF << /StdCF << /CFM /AESV2 /Length 16 >> >> /StmF /StdCF /StrF /StdCF"

    def encrypted(num: int, body: bytes) -> bytes:
        head, _, rest = body.partition(b"stream\n")
        data = rest[: -len(b"\nendstream")]
        own = hashlib.md5(key + num.to_bytes(3, "little") + b"\0\0" + (b"sAlT" if kind == "aes" else b"")).digest()
        if kind == "aes":
            pad = 16 - len(data) % 16
            iv = hashlib.md5(b"iv%d" % num).digest()
            data = iv + cbc_encrypt(own, data + bytes([pad]) * pad, iv)
        else:
            data = rc4(own, data)
        before = head[: head.rindex(b"/Length ")]
        return before + b"/Length %d >>\nstream\n" % len(data) + data + b"\nendstream"

    return {"dict": told, "id": seed, "stream": encrypted}


def lock_256(password: bytes, seed: bytes) -> dict:
    """Revision 6: a key of 32 bytes, wrapped under the hashed password."""
    key, check, wrap = hashlib.sha256(seed).digest(), seed[:8], seed[8:16]
    user = hash_r6(password, check, b"", 6) + check + wrap
    wrapped = cbc_encrypt(hash_r6(password, wrap, b"", 6), key, bytes(16))
    told = f"/Filter /Standard /V 5 /R 6 /Length 256 /P -4 /O <{bytes(48).hex()}> /U <{user.hex()}> /UE <{wrapped.hex()}> /OE <{bytes(32).hex()}> /CF << /StdCF << /CFM /AESV3 >> >> /StmF /StdCF /StrF /StdCF"

    def encrypted(num: int, body: bytes) -> bytes:
        head, _, rest = body.partition(b"stream\n")
        data = rest[: -len(b"\nendstream")]
        pad, iv = 16 - len(data) % 16, hashlib.md5(b"iv%d" % num).digest()
        data = iv + cbc_encrypt(key, data + bytes([pad]) * pad, iv)
        return head[: head.rindex(b"/Length ")] + b"/Length %d >>\nstream\n" % len(data) + data + b"\nendstream"

    return {"dict": told, "id": seed, "stream": encrypted}


def from_text(text: str, packing: str = "flate", lines_a_page: int = 50, modern: bool = False, encrypt: str | None = None, info: str | None = None, password: str = "") -> bytes:
    """The text, a line of the page for each of its lines, in a font whose codes are numbers given to its characters."""
    alphabet = sorted({ch for ch in text if ch != "\n"})
    code = {ch: i + 1 for i, ch in enumerate(alphabet)}
    rows = "\n".join(f"<{i + 1:04X}> <{ch.encode('utf-16-be').hex()}>" for i, ch in enumerate(alphabet))
    cmap = f"1 begincodespacerange <0000> <FFFF> endcodespacerange\n{len(alphabet)} beginbfchar\n{rows}\nendbfchar".encode()
    fonts = {"F1": "/Subtype /Type0 /BaseFont /Any /Encoding /Identity-H /ToUnicode 100 0 R /DescendantFonts [<< /Subtype /CIDFontType2 /DW 500 >>]"}
    pages, lines = [], text.split("\n")
    for at in range(0, len(lines), lines_a_page):
        shown = "\n".join(f"1 0 0 1 72 {800 - 12 * i} Tm <{''.join(f'{code[ch]:04X}' for ch in line)}> Tj" for i, line in enumerate(lines[at : at + lines_a_page]) if line)
        pages.append(f"BT /F1 10 Tf\n{shown}\nET".encode())
    return assembled(objects(pages, fonts, {100: stream(cmap)}, packing, info), lock(encrypt, password) if encrypt else None, modern)
