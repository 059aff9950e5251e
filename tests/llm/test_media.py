"""Sniffing and carving of hand-made media, and exact round trips of stored texts."""

import hashlib
import struct
import zlib

import pytest

from graphlens.llm import media

PNG = media.png_of(bytes(range(192)) * 2)
WAV = b"RIFF" + struct.pack("<I", 36 + 8) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", 8) + b"abcdefgh"
GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + bytes(9) + b"\x02\x02\x44\x01\x00\x3b"
JPEG = b"\xff\xd8\xff\xe0\x00\x10" + b"JFIF\0" + bytes(9) + b"\xff\xc0\x00\x0b" + bytes(9) + b"\xff\xda\x00\x08" + bytes(6) + b"data\xff\x00\xff\xd0more\xff\xd9"
BMP = b"BM" + struct.pack("<IIIIiiHHIIIIII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\1\2\3\0"
AIFF = b"FORM" + struct.pack(">I", 4 + 8 + 18) + b"AIFFCOMM" + struct.pack(">I", 18) + bytes(18)
OGG = b"OggS\0\x02" + bytes(20) + b"\x01\x03abc" + b"OggS\0\x04" + bytes(20) + b"\x01\x02xy"
MP4 = struct.pack(">I", 16) + b"ftypisom" + bytes(4) + struct.pack(">I", 12) + b"moov" + b"abcd"
AU = b".snd" + struct.pack(">IIIII", 24, 4, 1, 8000, 1) + b"abcd"
ALL = {"image/png": PNG, "audio/wav": WAV, "image/gif": GIF, "image/jpeg": JPEG, "image/bmp": BMP, "audio/aiff": AIFF, "audio/ogg": OGG, "video/mp4": MP4, "audio/basic": AU}


@pytest.mark.parametrize("kind", ALL)
def test_each_format(kind):
    b = ALL[kind]
    assert media.carve(b) == [(kind, 0, len(b))]
    assert media.carve(b"junk!" + b + b"more") == [(kind, 5, len(b))]
    assert media.carve(b[: len(b) // 2 + 3]) == [] and media.carve(b[:-1]) in ([], [("video/mp4", 0, 16)])


def test_several_and_inside():
    whole = b"x" + b"-".join(ALL.values())
    assert [k for k, _, _ in media.carve(whole)] == list(ALL)
    assert [k for k, _, _ in media.carve(whole, step=7)] == list(ALL)
    inside = bytearray(WAV)
    inside[40:44] = struct.pack("<I", len(GIF) + len(GIF) % 2)
    inside[4:8] = struct.pack("<I", 36 + len(GIF) + len(GIF) % 2)
    b = bytes(inside[:44]) + GIF + bytes(len(GIF) % 2)
    assert media.carve(b) == [("audio/wav", 0, len(b))]


def test_damage_is_seen():
    bad = bytearray(PNG)
    bad[50] ^= 1
    assert media.carve(bytes(bad)) == [] and media.carve(b"BM" * 500) == [] and media.carve(b"RIFF" * 99) == [] and media.carve(b"") == []


def test_declared_types_are_corrected(spark):
    rows = [(1, bytearray(PNG), "image/jpeg", 1), (2, bytearray(PNG), "image/png", 1), (3, bytearray(b"a" + GIF), None, 1), (4, None, "x", 1), (5, bytearray(), "y", 1)]
    got = {r.id: r for r in media.sniff(spark.createDataFrame(rows, "id long, media binary, declared string, __0 int")).collect()}
    assert (got[1].detected, got[1].as_declared) == ("image/png", False) and got[2].as_declared
    assert got[3].detected == media.UNKNOWN and got[3].as_declared is None and [(p.type, p.start) for p in got[3].parts] == [("image/gif", 1)]
    assert got[4].parts == got[5].parts == [] and got[4].media is None


def test_texts_round_trip(spark):
    found = [None, "", "a", "é" * 96, "x" * 192, "y" * 193, "GIF89a RIFF BM " * 50, "z" * 300_000, "a"]
    docs = spark.createDataFrame([(k if k else None, x, "m", 1) for k, x in enumerate(found)], "doc_id long, text string, media string, n_bytes int")
    got = {r.doc_id or 0: r for r in media.media_features(docs).collect()}
    assert len(got) == len(found)
    for k, x in enumerate(found):
        raw = (x or "").encode()
        payload = raw + b" " * (192 - len(raw) if not raw else -len(raw) % 192)
        r, stored = got[k], media.png_of(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and r.feature.startswith("image/png 192x")
    assert got[2][2:] == got[8][2:]
    assert media.media_features(docs.limit(0)).count() == 0
