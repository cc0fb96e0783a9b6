"""PDF objects and the file around them: values, cross-reference data, object streams and repair."""

from __future__ import annotations

import codecs
import re
import zlib
from binascii import unhexlify
from bisect import bisect_left
from heapq import merge
from typing import Any, NamedTuple

from parchmill.kernel import filters
from parchmill.kernel.crypto import Cipher, Locked


class NotPdf(Exception):
    """The bytes are no PDF, or have no catalog."""


class Ref(NamedTuple):
    num: int
    gen: int


class Name(str):
    """A name, without its slash."""

    __slots__ = ()


class Stream(NamedTuple):
    dict: dict
    start: int
    num: int
    gen: int


END = object()
#: One token: number, name, literal string, hex string, bracket, or word.
TOKEN = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*(?:([+-]*(?:\d+\.?\d*|\.\d+)[^\0\t\n\f\r ()<>\[\]{}/%]*)|/([^\0\t\n\f\r ()<>\[\]{}/%]*)|(\()|(<<|>>|[\[\]])|<([^>]*)>?|([^\0\t\n\f\r ()<>\[\]{}/%]+)|([){}>]))")
REF = re.compile(rb"[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
HEADER = re.compile(rb"(?<!\d)(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+obj(?![A-Za-z])")
#: What comes before `obj` in a header that begins a line, and after a word that ends one.
BEGUN, LINE_END = re.compile(rb"(?:\A|[\r\n])[ \t]*\d{1,10}[\0\t\n\f\r ]+\d{1,5}[\0\t\n\f\r ]+\Z"), re.compile(rb"[ \t]*(?:endobj[ \t]*)?(?:[\r\n]|\Z)")
ENDSTREAM = re.compile(rb"[\0\t\n\f\r ]*endstream")
STOPS = frozenset([b"endobj", b"stream", b"endstream", b"xref", b"trailer", b"startxref"])
FREE = re.compile(rb"(?: [\r\n]0000000000 65535 f)+")
NUMBERS = re.compile(rb" *+(?:\d{1,9}(?: ++|(?=\])))*+\]")
DEPTH = 100
SIMPLE_ESCAPES = {110: 10, 114: 13, 116: 9, 98: 8, 102: 12}
OCTAL = re.compile(rb"(?:[^\\]++|\\[0-3][0-7]{2})*+")
ESCAPE = re.compile(rb"\\(?:[0-7]{1,3}|\r\n?|.|\Z)", re.S)


class Escapes(dict):
    """The bytes that an escape of a literal string stands for, kept; there are under 1000 of them."""

    def __missing__(self, escape: bytes) -> bytes:
        told = escape[1:]
        if told[:1] in (b"", b"\r", b"\n"):
            found = b""
        elif 48 <= told[0] <= 55:
            found = bytes([int(told, 8) & 255])
        else:
            found = bytes([SIMPLE_ESCAPES.get(told[0], told[0])])
        self[escape] = found
        return found


ESCAPES = Escapes()


def unescaped(body: bytes) -> bytes:
    """The bytes that a literal string's body stands for."""
    if b"\\" not in body:
        return body
    if OCTAL.fullmatch(body):  # as most writers have it
        return codecs.escape_decode(body)[0]
    return ESCAPE.sub(lambda m: ESCAPES[m[0]], body)


def unhexed(body: bytes) -> bytes:
    try:
        return unhexlify(body)
    except ValueError:  # white space, or an odd digit
        pass
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", body)
    return bytes.fromhex((digits + b"0" * (len(digits) & 1)).decode())


def literal_end(data: bytes, at: int) -> int:
    """The place after the parenthesis that closes a literal string whose body begins at `at`."""
    depth = 1
    for m in re.compile(rb"\\.|[()]", re.S).finditer(data, at):
        if m[0] == b"(":
            depth += 1
        elif m[0] == b")":
            depth -= 1
            if not depth:
                return m.end()
    return len(data)


def number(text: bytes) -> int | float:
    m = NUMBER.match(text)
    if not m:
        return 0
    whole = m[0]
    return int(whole) if b"." not in whole and len(whole) < 18 else float(whole)


def parse(data: bytes, at: int, room: list[int] | None = None) -> tuple[Any, int]:
    """The value at `at`, and where it ends; END where there is none. room[0]: elements that may still be kept.

    Containers are kept on a stack. Signs and words that fit nowhere are passed over; a word that ends an object
    closes all that is open.
    """
    open_: list[tuple[list, bool]] = []  # (items, is a dictionary)
    while True:
        m = TOKEN.match(data, at)
        if m is None:
            value, at = END, len(data)
        else:
            kind = m.lastindex
            at = m.end()
            value = None
            if kind == 1:
                value = number(m[1])
                if isinstance(value, int) and value >= 0 and (r := REF.match(data, m.end(1))) and m.end(1) == at:
                    value, at = Ref(value, int(r[1])), r.end()
            elif kind == 2:
                value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m[2]).decode("utf-8", "surrogateescape"))
            elif kind == 3:
                end = literal_end(data, at)
                value, at = unescaped(data[at : end - (data[end - 1 : end] == b")")]), end
            elif kind == 5:
                value = unhexed(m[5])
            elif kind == 4:
                sign = m[4]
                plain = NUMBERS.match(data, at) if sign == b"[" and len(open_) < DEPTH else None
                if plain is not None and (room is None or room[0] > len(plain[0])):  # an array of whole numbers alone
                    value, at = list(map(int, plain[0][:-1].split())), plain.end()
                    if room is not None:
                        room[0] -= len(value)
                elif sign == b"[" or sign == b"<<":
                    if len(open_) < DEPTH:
                        open_.append(([], sign == b"<<"))
                        continue
                    return None, at
                else:
                    if not open_ or open_[-1][1] != (sign == b">>"):
                        if not open_:
                            return None, at
                        if sign == b"]" or not any(d for _, d in open_):
                            continue
                        while not open_[-1][1]:  # a dictionary ends before its array does
                            inner = closed(open_.pop())
                            open_[-1][0].append(inner)
                    value = closed(open_.pop())
            elif kind == 6:
                word = m[6]
                if word in STOPS:
                    value, at = END, m.start(6)
                elif word == b"true" or word == b"false":
                    value = word == b"true"
                elif open_ and word != b"null" and not open_[-1][1]:
                    continue
            elif open_:
                continue
        if value is END:
            if not open_:
                return END, at
            while len(open_) > 1:
                inner = closed(open_.pop())
                open_[-1][0].append(inner)
            return closed(open_.pop()), at
        if not open_:
            return value, at
        if room is not None:
            room[0] -= 1
            if room[0] < 0:
                while len(open_) > 1:
                    inner = closed(open_.pop())
                    open_[-1][0].append(inner)
                return closed(open_.pop()), at
        open_[-1][0].append(value)


def closed(container: tuple[list, bool]) -> Any:
    items, is_dict = container
    if not is_dict:
        return items
    out, i = {}, 0
    while i < len(items):
        key = items[i]
        if not isinstance(key, Name):
            i += 1
            continue
        if i + 1 < len(items):
            out[key] = items[i + 1]
        i += 2
    return out


class Pdf:
    """An opened file. budget: bytes that reading it may take; all ceilings follow from it."""

    def __init__(self, data: bytes, password: str = "", budget: int = 256 << 20) -> None:
        if b"%PDF-" not in data[:1024] and b" obj" not in data:
            raise NotPdf("no PDF header and no object")
        self.data, self.budget = data, budget
        self.limit = max(1, budget // 4)
        self.where: dict[int, tuple[int, int]] = {}  # number -> (offset, -1) or (container, place)
        self.trailer: dict = {}
        self.notes: dict[str, str] = {}
        self.objects: dict[int, Any] = {}
        self.containers: dict[int, tuple[bytes, dict[int, int]]] = {}
        self.endings: list[tuple[int, bytes]] | None = None
        self.cipher: Cipher | None = None
        self.rebuilt = False
        try:
            self.read_tables()
        except (ValueError, IndexError, TypeError, OverflowError):
            pass
        if not isinstance(self.dict(self.trailer.get("Root")), dict) or not self.dict(self.trailer.get("Root")):
            self.rebuild()
        if not self.dict(self.trailer.get("Root")):
            if not self.objects_named("Page"):
                raise NotPdf("no catalog")
        if self.trailer.get("Encrypt") is not None:
            encrypt = self.dict(self.trailer["Encrypt"]) or {}
            ids = self.resolve(self.trailer.get("ID"))
            first = self.resolve(ids[0]) if isinstance(ids, list) and ids else b""
            self.encrypt_num = self.trailer["Encrypt"].num if isinstance(self.trailer["Encrypt"], Ref) else -1
            self.cipher = Cipher({k: self.resolve(v) for k, v in encrypt.items()}, first if isinstance(first, bytes) else b"", password, self)
            self.objects.clear()
            self.containers.clear()
            if self.rebuilt:
                self.index_containers()

    # --- notes

    def warn(self, text: str, key: str | None = None) -> None:
        key = key or text
        if key in self.notes:
            return
        if len(self.notes) >= 100:
            self.notes.setdefault("more", "Further warnings of this file are not kept")
        else:
            self.notes[key] = text.encode("utf-8", "replace").decode()

    # --- cross-reference data

    def read_tables(self) -> None:
        found = self.data.rfind(b"startxref", max(0, len(self.data) - 2048))
        m = re.compile(rb"startxref\s*(\d+)").match(self.data, found) if found >= 0 else None
        todo, seen = [int(m[1])] if m else [], set()
        room = 4 * len(self.data) + 65536
        while todo:
            at = todo.pop(0)
            if at in seen or at >= len(self.data):
                continue
            seen.add(at)
            m = re.compile(rb"[\0\t\n\f\r ]*xref").match(self.data, at)
            if m:
                trailer, room = self.read_rows(m.end(), room)
            else:
                trailer = self.read_stream_rows(at)
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)
            for key in ("XRefStm", "Prev"):
                if isinstance(trailer.get(key), int):
                    todo.append(trailer[key])

    def read_rows(self, at: int, room: int) -> tuple[dict, int]:
        section, row = re.compile(rb"[\0\t\n\f\r ]*(\d+)[ ]+(\d+)[\0\t\n\f\r ]*"), re.compile(rb"[\0\t\n\f\r ]*(\d{1,10})[ ]+(\d{1,5})[ ]+([nf])")
        while m := section.match(self.data, at):
            first, count, at = int(m[1]), int(m[2]), m.end()
            i = 0
            while i < count:
                r = row.match(self.data, at)
                room -= 20
                if not r or room < 0:
                    break
                at = r.end()
                if r[3] == b"n":
                    self.where.setdefault(first + i, (int(r[1]), -1))
                elif more := FREE.match(self.data, at):  # a stretch of free rows of 20 bytes is passed over at once
                    n = min(len(more[0]) // 20, count - i - 1, room // 20)
                    at, i, room = at + 20 * n, i + n, room - 20 * n
                i += 1
        m = re.compile(rb"[\0\t\n\f\r ]*trailer").match(self.data, at)
        trailer = parse(self.data, m.end())[0] if m else {}
        return trailer if isinstance(trailer, dict) else {}, room

    def read_stream_rows(self, at: int) -> dict:
        got = self.indirect(at)
        if not got or not isinstance(got[2], Stream):
            return {}
        head = got[2].dict
        widths = self.resolve(head.get("W"))
        if not isinstance(widths, list) or len(widths) < 3 or not all(isinstance(w, int) and 0 <= w <= 8 for w in widths[:3]) or not sum(widths[:3]):
            return head
        data = self.stream_data(got[2], decrypt=False) or b""
        index = self.resolve(head.get("Index"))
        if not isinstance(index, list) or len(index) < 2 or not all(isinstance(x, int) and x >= 0 for x in index):
            index = [0, head.get("Size") if isinstance(head.get("Size"), int) else 0]
        a, b, c = widths[:3]
        step, p = a + b + c, 0
        for first, count in zip(index[::2], index[1::2], strict=False):
            for num in range(first, first + min(count, (len(data) - p) // step)):
                kind = int.from_bytes(data[p : p + a], "big") if a else 1
                x, y = int.from_bytes(data[p + a : p + a + b], "big"), int.from_bytes(data[p + a + b : p + step], "big")
                p += step
                if kind == 1:
                    self.where.setdefault(num, (x, -1))
                elif kind == 2:
                    self.where.setdefault(num, (x, y))
        return head

    def rebuild(self) -> None:
        """Finds the objects by their headers, but not inside of streams; of several with one number the last counts."""
        self.rebuilt = True
        self.warn("Objects were located by a scan, as the cross-reference data doesn't lead to them")
        self.where, self.objects, self.containers = {}, {}, {}
        trailers, last = [], -1
        surely = likely = 0  # where the last stream ends: by its Length, by a search
        for m in merge(HEADER.finditer(self.data), re.finditer(rb"trailer", self.data), key=re.Match.start):
            at = m.start()
            if last >= 0 and self.data.find(b"stream", last, at) >= 0:
                surely, likely = self.stream_end(last)
            last = -1
            if at < surely or (at < likely and not self.begins_line(at)):
                continue
            if m.re is not HEADER:
                trailers.append(m.end())
                continue
            last = at
            if int(m[1]) < 1 << 31:
                self.where[int(m[1])] = (at, -1)
        trailer: dict = {}
        for at in trailers:
            found = parse(self.data, at)[0]
            if isinstance(found, dict):
                trailer = found | {k: v for k, v in trailer.items() if k not in found}
        for num, (at, _) in list(self.where.items()):
            if re.compile(rb".{0,400}?/Type\s*/XRef", re.S).match(self.data, at):
                got = self.indirect(at)
                if got and isinstance(got[2], Stream) and got[2].dict.get("Type") == "XRef":
                    trailer = trailer | {k: v for k, v in got[2].dict.items() if k in ("Root", "Info", "Encrypt", "ID")}
        self.trailer = trailer
        self.index_containers()
        if not self.dict(trailer.get("Root")):
            for num in sorted(self.where):
                got = self.get(num)
                if isinstance(got, dict) and got.get("Type") == "Catalog":
                    self.trailer["Root"] = Ref(num, 0)

    def begins_line(self, at: int) -> bool:
        return (self.data[max(0, at - 64) : at].rstrip(b" \t") or b"\n")[-1:] in (b"\n", b"\r")

    def stream_end(self, at: int) -> tuple[int, int]:
        """Where the stream of the object at `at` ends: by its Length, and by a search if that doesn't lead there."""
        got = self.indirect(at)
        if not got or not isinstance(got[2], Stream):
            return 0, 0
        start, n = got[2].start, got[2].dict.get("Length")
        if isinstance(n, int) and n >= 0 and ENDSTREAM.match(self.data, start + n):
            return start + n, 0
        return 0, self.searched_end(start)

    def searched_end(self, start: int) -> int:
        """Where a stream ends, by the words that end it or its object: at a line's start or end if there are any before the next object."""
        data = self.data
        if self.endings is None:
            self.endings = []
            for m in re.finditer(rb"endstream|endobj|obj(?![A-Za-z])", data):
                at, word = m.start(), m[0]
                if BEGUN.search(data[max(0, at - 64) : at]) if word == b"obj" else data[at - 1 : at] in (b"\n", b"\r") or LINE_END.match(data, m.end()):
                    self.endings.append((at, word))
        i = bisect_left(self.endings, (start,))
        if [word for _, word in self.endings[i : i + 2]] == [b"endobj", b"endstream"]:
            i += 1
        if i < len(self.endings) and self.endings[i][1] != b"obj":
            return self.endings[i][0]
        end = data.find(b"endstream", start)
        other = data.find(b"endobj", start, end if end >= 0 else len(data))
        if end < 0 or (0 <= other < end and HEADER.search(data, other, end)):
            end = other if other >= 0 else len(data)
        return end

    def index_containers(self) -> None:
        for num, (at, place) in list(self.where.items()):
            if place < 0 and self.data.find(b"ObjStm", at, at + 1024) >= 0:
                got = self.get(num)
                if isinstance(got, Stream) and got.dict.get("Type") == "ObjStm":
                    for i, n in enumerate(self.container(num)[1]):
                        self.where.setdefault(n, (num, i))

    # --- objects

    def indirect(self, at: int) -> tuple[int, int, Any] | None:
        """(number, generation, value) of the object whose header stands at `at`."""
        m = re.compile(rb"[\0\t\n\f\r ]*(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+obj").match(self.data, at)
        if not m:
            return None
        value, end = parse(self.data, m.end(), [max(4096, self.budget // 512)])
        if isinstance(value, dict):
            s = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*stream(\r\n|\n|\r)?").match(self.data, end)
            if s:
                return int(m[1]), int(m[2]), Stream(value, s.end(), int(m[1]), int(m[2]))
        return int(m[1]), int(m[2]), None if value is END else value

    def get(self, num: int) -> Any:
        if num in self.objects:
            return self.objects[num]
        value = None
        if num in self.where:
            at, place = self.where[num]
            if place < 0:
                got = self.indirect(at)
                if (not got or got[0] != num) and not self.rebuilt:
                    self.rebuild()
                    return self.get(num)
                value = got[2] if got and got[0] == num else None
            else:
                data, places = self.container(at)
                if num in places:
                    value = parse(data, places[num], [max(4096, self.budget // 512)])[0]
                    value = None if value is END else value
        if len(self.objects) >= 1024:
            self.objects.clear()
        self.objects[num] = value
        return value

    def container(self, num: int) -> tuple[bytes, dict[int, int]]:
        """An object stream's bytes, and where its objects begin."""
        if num not in self.containers:
            self.containers[num] = (b"", {})
            s = self.get(num) if self.where.get(num, (0, 0))[1] < 0 else None
            if isinstance(s, Stream):
                data = self.stream_data(s) or b""
                first, n = self.resolve(s.dict.get("First")), self.resolve(s.dict.get("N"))
                if isinstance(first, int) and isinstance(n, int):
                    pairs = re.findall(rb"(\d+)\s+(\d+)", data[: max(0, first)])[: max(0, min(n, self.budget // 320))]
                    while len(self.containers) > 32:
                        self.containers.pop(next(iter(self.containers)))
                    self.containers[num] = (data, {int(a): first + int(b) for a, b in reversed(pairs)})
        return self.containers[num]

    def resolve(self, value: Any) -> Any:
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.get(value.num)
        return None

    def dict(self, value: Any) -> dict | None:
        value = self.resolve(value)
        return value.dict if isinstance(value, Stream) else value if isinstance(value, dict) else None

    def objects_named(self, kind: str) -> list[int]:
        return [n for n in list(self.where) if isinstance(d := self.get(n), dict) and d.get("Type") == kind]

    # --- streams

    def raw(self, s: Stream) -> bytes:
        data, n = self.data, self.resolve(s.dict.get("Length"))
        if isinstance(n, int) and n >= 0 and ENDSTREAM.match(data, s.start + n):
            return data[s.start : s.start + n]
        self.warn("A stream's end was searched for, as its Length doesn't lead there")
        end = self.searched_end(s.start)
        if data[end - 2 : end] == b"\r\n":
            end -= 2
        elif data[end - 1 : end] in (b"\n", b"\r"):
            end -= 1
        return data[s.start : max(s.start, end)]

    def stream_data(self, s: Stream, decrypt: bool = True, limit: int | None = None, quiet: bool = False) -> bytes | None:
        """A stream's decoded bytes; None for an image's."""
        names, parms = self.resolve(s.dict.get("Filter", s.dict.get("F"))), self.resolve(s.dict.get("DecodeParms", s.dict.get("DP")))
        names = [self.resolve(x) for x in (names if isinstance(names, list) else [names])]
        parms = [self.dict(x) for x in (parms if isinstance(parms, list) else [parms])]
        names = [str(x) for x in names if isinstance(x, Name)]
        if any(n in filters.IMAGES for n in names):
            return None
        data = self.raw(s)
        if decrypt and self.cipher is not None and s.dict.get("Type") != "XRef":
            own = [(self.dict(p) or {}).get("Name", "Identity") for n, p in zip(names, parms + [None] * len(names), strict=False) if n == "Crypt"]
            data = self.cipher.stream(data, s.num, s.gen, own[0] if own else ("Identity" if s.dict.get("Type") == "Metadata" and not self.cipher.metadata else None))
        most = self.limit if limit is None else limit
        settings = [{k: self.resolve(v) for k, v in (p or {}).items()} for p in parms + [None] * (len(names) - len(parms))]
        data, cut = filters.decode(data, names, settings, most)
        if cut and not quiet:
            self.warn(f"A stream unpacks to more than half of memoryBudget: {len(data or b'')} bytes of it are used")
        return data


__all__ = ["END", "Locked", "Name", "NotPdf", "Pdf", "Ref", "Stream", "parse", "unescaped", "unhexed", "zlib"]
