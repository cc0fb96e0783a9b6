"""The standard security handler: RC4 and AES with the user's or the owner's password."""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache
from typing import Any

import numpy as np

#: Fixed value: the padding of passwords.
PAD = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")


class Locked(Exception):
    """The password is wrong, or the kind of encryption isn't known."""


def rc4(key: bytes, data: bytes) -> bytes:
    if not key:
        return data
    s, j = list(range(256)), 0
    for i in range(256):
        j = j + s[i] + key[i % len(key)] & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, c in enumerate(data):
        i = i + 1 & 255
        a = s[i]
        j = j + a & 255
        b = s[j]
        s[i], s[j] = b, a
        out[n] = c ^ s[a + b & 255]
    return bytes(out)


def _boxes() -> tuple[np.ndarray, np.ndarray]:
    """The substitution box of AES from its definition: inverses in GF(2^8) and an affine map."""
    exp, log, x = [0] * 512, [0] * 256, 1
    for i in range(255):
        exp[i] = exp[i + 255] = x
        log[x] = i
        x ^= x << 1 ^ (0x11B if x & 128 else 0)
        x &= 255
    box = np.zeros(256, np.uint8)
    for v in range(256):
        inv = exp[255 - log[v]] if v else 0
        box[v] = inv ^ (inv << 1 | inv >> 7) & 255 ^ (inv << 2 | inv >> 6) & 255 ^ (inv << 3 | inv >> 5) & 255 ^ (inv << 4 | inv >> 4) & 255 ^ 0x63
    back = np.zeros(256, np.uint8)
    back[box] = np.arange(256, dtype=np.uint8)
    return box, back


BOX, UNBOX = _boxes()
UNSHIFT = np.array([(i - 4 * (i % 4)) % 16 for i in range(16)])


def _times(n: int) -> np.ndarray:
    def product(a: int) -> int:
        out, b = 0, n
        while b:
            out ^= a if b & 1 else 0
            a, b = a << 1 ^ (0x11B if a & 128 else 0), b >> 1
        return out

    return np.array([product(a) for a in range(256)], np.uint8)


BY = {n: _times(n) for n in (2, 3, 9, 11, 13, 14)}


def schedule(key: bytes) -> np.ndarray:
    n = len(key) // 4
    words = [list(key[4 * i : 4 * i + 4]) for i in range(n)]
    round_constant = 1
    for i in range(n, 4 * (n + 7)):
        w = list(words[-1])
        if i % n == 0:
            w = [int(BOX[x]) for x in w[1:] + w[:1]]
            w[0] ^= round_constant
            round_constant = round_constant << 1 ^ (0x11B if round_constant & 128 else 0)
        elif n > 6 and i % n == 4:
            w = [int(BOX[x]) for x in w]
        words.append([a ^ b for a, b in zip(w, words[-n], strict=True)])
    return np.array(words, np.uint8).reshape(-1, 16)


def _mixed(s: np.ndarray, a: int, b: int, c: int, d: int) -> np.ndarray:
    """Each column of four bytes times the circulant matrix of a, b, c, d."""
    x = s.reshape(-1, 4, 4)
    by = {1: x} | {k: BY[k][x] for k in (a, b, c, d) if k != 1}
    return (by[a] ^ np.roll(by[b], -1, 2) ^ np.roll(by[c], -2, 2) ^ np.roll(by[d], -3, 2)).reshape(-1, 16)


def decrypt_blocks(keys: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    s = blocks ^ keys[-1]
    for k in keys[-2:0:-1]:
        s = _mixed(UNBOX[s[:, UNSHIFT]] ^ k, 14, 11, 13, 9)
    return UNBOX[s[:, UNSHIFT]] ^ keys[0]


def _rounds_tables() -> list[list[int]]:
    """For each place in a column, the column that a substituted and mixed byte adds, as a big-endian word."""
    box = BOX.tolist()
    two, three = ([int(BY[n][x]) for x in box] for n in (2, 3))
    first = [two[i] << 24 | box[i] << 16 | box[i] << 8 | three[i] for i in range(256)]
    return [[x >> 8 * k | (x & (1 << 8 * k) - 1) << 32 - 8 * k for x in first] for k in range(4)]


T0, T1, T2, T3 = _rounds_tables()
BOX_LIST = BOX.tolist()


def encrypt_words(keys: list[list[int]], s: list[int]) -> list[int]:
    """One block as four words; each is encrypted after the one before, so there is nothing to do side by side."""
    a, b, c, d = (x ^ k for x, k in zip(s, keys[0], strict=True))
    for k0, k1, k2, k3 in keys[1:-1]:
        a, b, c, d = (
            T0[a >> 24] ^ T1[b >> 16 & 255] ^ T2[c >> 8 & 255] ^ T3[d & 255] ^ k0,
            T0[b >> 24] ^ T1[c >> 16 & 255] ^ T2[d >> 8 & 255] ^ T3[a & 255] ^ k1,
            T0[c >> 24] ^ T1[d >> 16 & 255] ^ T2[a >> 8 & 255] ^ T3[b & 255] ^ k2,
            T0[d >> 24] ^ T1[a >> 16 & 255] ^ T2[b >> 8 & 255] ^ T3[c & 255] ^ k3,
        )
    box = BOX_LIST
    rows = ((a, b, c, d), (b, c, d, a), (c, d, a, b), (d, a, b, c))
    return [(box[w >> 24] << 24 | box[x >> 16 & 255] << 16 | box[y >> 8 & 255] << 8 | box[z & 255]) ^ k for (w, x, y, z), k in zip(rows, keys[-1], strict=True)]


def cbc_decrypt(key: bytes, data: bytes, iv: bytes | None = None, padded: bool = True) -> bytes:
    """AES in CBC mode; without iv the first block is it. A ragged end is dropped, and bad padding stays."""
    if iv is None:
        iv, data = data[:16], data[16:]
    n = len(data) // 16
    if not n or len(iv) < 16:
        return b""
    blocks = np.frombuffer(data[: 16 * n], np.uint8).reshape(-1, 16)
    before = np.concatenate([np.frombuffer(iv, np.uint8).reshape(1, 16), blocks[:-1]])
    out = (decrypt_blocks(schedule(key), blocks) ^ before).tobytes()
    return out[: -out[-1]] if padded and 1 <= out[-1] <= 16 else out


def cbc_encrypt(key: bytes, data: bytes, iv: bytes) -> bytes:
    keys = [list(struct.unpack(">4I", k.tobytes())) for k in schedule(key)]
    last, out = struct.unpack(">4I", iv), []
    for at in range(0, len(data), 16):
        block = struct.unpack_from(">4I", data, at)
        last = encrypt_words(keys, [x ^ y for x, y in zip(block, last, strict=True)])
        out += last
    return struct.pack(f">{len(out)}I", *out)


@lru_cache(maxsize=1024)
def hash_r6(password: bytes, salt: bytes, user: bytes, revision: int) -> bytes:
    k = hashlib.sha256(password + salt + user).digest()
    if revision < 6:
        return k
    i = 0
    while True:
        e = cbc_encrypt(k[:16], (password + k + user) * 64, k[16:32])
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


class Cipher:
    """Unlocks a file and deciphers its streams and strings."""

    def __init__(self, d: dict[str, Any], file_id: bytes, password: str, pdf: Any) -> None:
        if d.get("Filter", "Standard") != "Standard":
            raise Locked("unknown security handler")
        self.v, self.r = int(d.get("V") or 0), int(d.get("R") or 2)
        self.metadata = d.get("EncryptMetadata") is not False
        bits = d.get("Length")
        self.bytes = bits // 8 if isinstance(bits, int) and 40 <= bits <= 256 else 5
        self.bytes = 5 if self.v == 1 else self.bytes
        self.filters = {"Identity": "Identity"}
        self.of_streams = self.of_strings = "V2"
        if self.v >= 4:
            self.bytes = 16 if self.v == 4 else 32
            for name, x in (pdf.dict(d.get("CF")) or {}).items():
                self.filters[str(name)] = str((pdf.dict(x) or {}).get("CFM", "Identity"))
            self.of_streams, self.of_strings = (self.filters.get(str(d.get(k, "Identity")), "Identity") for k in ("StmF", "StrF"))
        elif self.v not in (1, 2, 3):
            raise Locked("unknown encryption version")
        o, u, p = (d.get(k) if isinstance(d.get(k), bytes) else b"" for k in ("O", "U")), None, int(d.get("P") or 0)
        self.o, self.u = o
        self.p = (p & 0xFFFFFFFF).to_bytes(4, "little")
        self.id = file_id
        self.key = self._new_key(d, password.encode()) if self.v >= 5 else self._old_key(password.encode("latin-1", "replace"))

    def _made(self, password: bytes) -> bytes:
        h = hashlib.md5((password + PAD)[:32] + self.o[:32] + self.p + self.id + (b"\xff\xff\xff\xff" if self.r >= 4 and not self.metadata else b"")).digest()
        for _ in range(50 if self.r >= 3 else 0):
            h = hashlib.md5(h[: self.bytes]).digest()
        return h[: self.bytes]

    def _opens(self, key: bytes) -> bool:
        if self.r == 2:
            return rc4(key, PAD) == self.u[:32]
        x = hashlib.md5(PAD + self.id).digest()
        for i in range(20):
            x = rc4(bytes(b ^ i for b in key), x)
        return x == self.u[:16]

    def _old_key(self, password: bytes) -> bytes:
        key = self._made(password)
        if self._opens(key):
            return key
        h = hashlib.md5((password + PAD)[:32]).digest()
        for _ in range(50 if self.r >= 3 else 0):
            h = hashlib.md5(h).digest()
        h, x = h[: self.bytes], self.o[:32]
        for i in range(19, -1, -1) if self.r >= 3 else (0,):
            x = rc4(bytes(b ^ i for b in h), x)
        key = self._made(x)
        if not self._opens(key):
            raise Locked("the password is wrong")
        return key

    def _new_key(self, d: dict, password: bytes) -> bytes:
        password, u, o = password[:127], self.u[:48], self.o[:48]
        for kept, key, extra in ((u, "UE", b""), (o, "OE", u)):
            if len(kept) == 48 and hash_r6(password, kept[32:40], extra, self.r) == kept[:32]:
                wrapped = d.get(key)
                if isinstance(wrapped, bytes) and len(wrapped) >= 32:
                    return cbc_decrypt(hash_r6(password, kept[40:48], extra, self.r), wrapped[:32], bytes(16), padded=False)
        raise Locked("the password is wrong")

    def _decipher(self, data: bytes, num: int, gen: int, method: str) -> bytes:
        if method in ("Identity", "None"):
            return data
        if method == "AESV3":
            return cbc_decrypt(self.key, data) if len(data) >= 32 else b""
        salted = self.key + num.to_bytes(4, "little")[:3] + gen.to_bytes(4, "little")[:2] + (b"sAlT" if method == "AESV2" else b"")
        key = hashlib.md5(salted).digest()[: min(16, len(self.key) + 5)]
        if method == "AESV2":
            return cbc_decrypt(key, data) if len(data) >= 32 else b""
        return rc4(key, data)

    def stream(self, data: bytes, num: int, gen: int, named: str | None = None) -> bytes:
        return self._decipher(data, num, gen, self.of_streams if named is None else self.filters.get(str(named), "Identity"))

    def string(self, data: bytes, num: int, gen: int) -> bytes:
        return self._decipher(data, num, gen, self.of_strings)
