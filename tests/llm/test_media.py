import gzip
import hashlib
import struct
import zlib

from helpers import ODD, frame, real

from parchmill.llm import media


def png():
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


GIF = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff!\xf9\x04\x01\0\0\0\0,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
BMP = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 58, 0, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"


def test_sniffing_confirms_structure():
    wave = media.as_wave(b"\xff" * 576)
    for value, kind in ((wave, "audio/wav"), (png(), "image/png"), (GIF, "image/gif"), (BMP, "image/bmp"), (gzip.compress(b"abc"), "application/gzip")):
        assert media.media_in(value) == [(0, len(value), kind)]
        assert media.media_in(b"junk" + value + b"more") == [(4, 4 + len(value), kind)]
        for n in range(len(value)):
            assert media.media_in(value[:n]) == []
    for text in (b"BM", b"RIFF", b"RIFF1234WAVE", b"GIF89a is a format", b"%PDF-1.4", b"", None):
        assert media.media_in(text) == []


def test_declared_types_are_corrected_and_media_carved(spark):
    rows = [(1, bytearray(png()), "image/gif"), (2, bytearray(b"text " + GIF + b" and " + png()), "text/plain"), (3, None, None), (4, bytearray(b""), "x/y")]
    got = {r.id: r for r in media.sniff(spark.createDataFrame(rows, "id long, body binary, said string"), "body", "said").collect()}
    assert (got[1].media_type, got[1].corrected) == ("image/png", True)
    assert (got[2].media_type, got[2].corrected) == ("text/plain", False)
    assert [bytes(m.bytes) for m in got[2].media] == [GIF, png()]
    assert got[3].media == [] and got[3].media_type is None and got[4].media_type == "x/y"


def check(docs):
    got = {r.doc_id: r for r in media.media_features(media.texts_as_media(docs)).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        raw = (r.text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        x = got[r.doc_id]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        wave = media.as_wave(payload)
        assert (x.media_bytes, x.media_sha256) == (len(wave), hashlib.sha256(wave).hexdigest())
        assert x.feature.startswith("audio/wav;")


def test_query_carves_what_is_stored(spark, tmp_path):
    from parchmill.llm import queries

    docs = frame(spark, [*ODD, "RIFF\x10\0\0\0WAVE", GIF.decode("latin-1"), as_text(png())])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {tuple(r) for r in media.media_features(media.texts_as_media(docs)).collect()}
    got = queries.op10_media(spark, str(tmp_path)).collect()
    assert {tuple(r)[:8] for r in got} == want and all((r.media_type, r.corrected) == ("audio/wav", True) for r in got)


def as_text(value):
    return value.decode("latin-1")


def test_round_trip(spark):
    check(real(spark, 200))
    check(frame(spark, [*ODD, "RIFF\x10\0\0\0WAVE", GIF.decode("latin-1")]))
    assert media.media_features(media.texts_as_media(frame(spark, ["a"]).limit(0))).collect() == []
