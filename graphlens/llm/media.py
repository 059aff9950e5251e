"""Media columns: what bytes are, by magic bytes that an Aho-Corasick automaton finds and validators that follow the format's own structure."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import bounded, materialize, slices, texts

#: Magic bytes of media formats and where they are in a file. Fixed values of the formats.
MAGIC = (
    (b"\x89PNG\r\n\x1a\n", 0, "png"),
    (b"GIF87a", 0, "gif"),
    (b"GIF89a", 0, "gif"),
    (b"\xff\xd8\xff", 0, "jpeg"),
    (b"RIFF", 0, "riff"),
    (b"BM", 0, "bmp"),
    (b"FORM", 0, "aiff"),
    (b"OggS", 0, "ogg"),
    (b"ftyp", 4, "mp4"),
    (b".snd", 0, "au"),
)
#: Unknown bytes; the type of each format. Fixed values.
UNKNOWN = "application/octet-stream"
TYPES = {"png": "image/png", "gif": "image/gif", "jpeg": "image/jpeg", "bmp": "image/bmp", "aiff": "audio/aiff", "ogg": "audio/ogg", "mp4": "video/mp4", "au": "audio/basic"}
RIFF_TYPES = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}

#: What a validator gives: the type and the end of the media that begin at a place, or None.
Found = tuple[str, int] | None


def _png(b: bytes, at: int) -> Found:
    """Chunks in order, IHDR first, each with its CRC, up to IEND."""
    p, first = at + 8, True
    while p + 12 <= len(b):
        size = int.from_bytes(b[p : p + 4], "big")
        kind, end = b[p + 4 : p + 8], p + 12 + size
        if end > len(b) or (kind != b"IHDR" or size != 13) and first or zlib.crc32(memoryview(b)[p + 4 : end - 4]) != int.from_bytes(b[end - 4 : end], "big"):
            return None
        if kind == b"IEND":
            return TYPES["png"], end
        p, first = end, False
    return None


def _gif(b: bytes, at: int) -> Found:
    """Screen descriptor, colour tables, extensions and images as chains of sub-blocks, and the trailer."""
    if len(b) < at + 13:
        return None
    p = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 128 else 0)
    images = 0
    while p < len(b):
        if b[p] == 0x3B:
            return (TYPES["gif"], p + 1) if images else None
        if b[p] == 0x2C and p + 10 < len(b):
            p += 10 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 128 else 0) + 1
            images += 1
        elif b[p] == 0x21:
            p += 2
        else:
            return None
        while p < len(b) and b[p]:
            p += b[p] + 1
        p += 1
    return None


def _jpeg(b: bytes, at: int) -> Found:
    """Marker segments with their lengths, a frame before a scan, entropy-coded data up to the end marker."""
    p, frame = at + 2, False
    while p + 4 <= len(b):
        if b[p] != 0xFF:
            return None
        kind = b[p + 1]
        if kind == 0xFF:
            p += 1
            continue
        if kind == 0xD9:
            return (TYPES["jpeg"], p + 2) if frame else None
        size = int.from_bytes(b[p + 2 : p + 4], "big")
        if size < 2 or not 0xC0 <= kind <= 0xFE or 0xD0 <= kind <= 0xD8:
            return None
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        p += 2 + size
        if kind == 0xDA:
            if not frame:
                return None
            while True:
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return None
                if b[p + 1] == 0xD9:
                    return TYPES["jpeg"], p + 2
                if b[p + 1] and not 0xD0 <= b[p + 1] <= 0xD7:
                    break
                p += 2
    return None


def _chunks(b: bytes, at: int, end: int, order: str) -> dict[bytes, tuple[int, int]] | None:
    """Chunks of an IFF file: id -> place and size of its content; None if their lengths don't fill it."""
    found, p = {}, at
    while p + 8 <= end:
        size = int.from_bytes(b[p + 4 : p + 8], order)
        found[b[p : p + 4]] = (p + 8, size)
        p += 8 + size + (size & 1)
    return found if p == end else None


def _riff(b: bytes, at: int) -> Found:
    """Size and form of the file, chunks that fill it; sound has a format before its data, with whole frames."""
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    kind = RIFF_TYPES.get(b[at + 8 : at + 12])
    if kind is None or end > len(b) or (found := _chunks(b, at + 12, end, "little")) is None:
        return None
    if kind == "audio/wav":
        if b"fmt " not in found or b"data" not in found or found[b"fmt "][1] < 16:
            return None
        frame = int.from_bytes(b[found[b"fmt "][0] + 12 : found[b"fmt "][0] + 14], "little")
        return (kind, end) if frame and not found[b"data"][1] % frame else None
    return (kind, end) if found else None


def _aiff(b: bytes, at: int) -> Found:
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "big")
    found = _chunks(b, at + 12, end, "big") if b[at + 8 : at + 12] in (b"AIFF", b"AIFC") and end <= len(b) else None
    return (TYPES["aiff"], end) if found and b"COMM" in found else None


def _bmp(b: bytes, at: int) -> Found:
    """Size, place of the pixels, header and rows agree."""
    if len(b) < at + 54:
        return None
    size, _, start, head, wide, high, planes, depth, packed = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    rows = (wide * depth + 31) // 32 * 4 * abs(high)
    ok = head >= 40 and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and wide > 0 and high and start >= 14 + head and at + size <= len(b)
    return (TYPES["bmp"], at + size) if ok and (packed or start + rows <= size) else None


def _ogg(b: bytes, at: int) -> Found:
    """Pages with sequence flags and segment tables, from a first page to a last one."""
    p, n = at, 0
    while p + 27 <= len(b) and b[p : p + 5] == b"OggS\0":
        flags, segments = b[p + 5], b[p + 26]
        end = p + 27 + segments + sum(b[p + 27 : p + 27 + segments])
        if end > len(b) or (flags & 2 > 0) != (n == 0):
            return None
        p, n = end, n + 1
        if flags & 4:
            return TYPES["ogg"], p
    return None


def _mp4(b: bytes, at: int) -> Found:
    """Boxes with their lengths, ftyp first, to the last that is whole; moov or moof is among them."""
    p, kinds = at, set()
    while p + 8 <= len(b):
        size, kind = int.from_bytes(b[p : p + 4], "big"), b[p + 4 : p + 8]
        if size == 1 and p + 16 <= len(b):
            size = int.from_bytes(b[p + 8 : p + 16], "big")
        if size < 8 or p + size > len(b) or not kind.isalnum():
            break
        kinds.add(kind)
        p += size
    return (TYPES["mp4"], p) if kinds & {b"moov", b"moof"} and b"ftyp" in kinds else None


def _au(b: bytes, at: int) -> Found:
    if len(b) < at + 24:
        return None
    start, size, coding, rate, channels = struct.unpack_from(">IIIII", b, at + 4)
    ok = start >= 24 and size != 0xFFFFFFFF and at + start + size <= len(b) and 1 <= coding <= 27 and rate and 0 < channels < 256
    return (TYPES["au"], at + start + size) if ok else None


VALIDATORS = {"png": _png, "gif": _gif, "jpeg": _jpeg, "riff": _riff, "bmp": _bmp, "aiff": _aiff, "ogg": _ogg, "mp4": _mp4, "au": _au}


@lru_cache(maxsize=1)
def automaton():
    """Magic bytes as one automaton; bytes are its characters up to U+00FF."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for magic, before, kind in MAGIC:
        made.add_word(magic.decode("latin-1"), (len(magic) + before, kind))
    made.make_automaton()
    return made


def carve(b: bytes, step: int = 1 << 16) -> list[tuple[str, int, int]]:
    """(type, offset, length) of all media in b, in order: magic bytes whose format's structure and lengths hold. Behind each the search goes on at its end, so what is inside other media is theirs."""
    out, at, found = [], 0, automaton()
    while at < len(b):
        hit = None
        # Bytes become characters in steps: most values are media from their first byte on.
        for lo in range(at, len(b), step):
            for end, (back, kind) in found.iter(b[lo : lo + step + 16].decode("latin-1")):
                start = lo + end + 1 - back
                if start >= at and (ok := VALIDATORS[kind](b, start)) is not None:
                    hit = (ok[0], start, ok[1] - start)
                    break
            if hit:
                break
        if not hit:
            break
        out.append(hit)
        at = hit[1] + hit[2]
    return out


def sniff(media: DataFrame, content: str = "media", declared: str = "declared") -> DataFrame:
    """media plus detected string, as_declared boolean, parts array<struct<type string, start long, length long>>, a row for each row.

    detected is the type of media that fill the whole value; a value that is none, or only holds some, is application/octet-stream, and parts are
    the media in it. Null and empty values have no part. A null declared type gives a null as_declared. The three new names must be free; other
    columns of media stay as they are, whatever their names. No row gives no row.
    """
    names = media.columns
    plain = bounded(media).toDF(*(f"__{k}" for k in range(len(names))))
    at = names.index(content)
    part = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in slices(batches, f"__{at}"):
            parts = [carve(x) for x in found]
            whole = [p[0][0] if len(p) == 1 and p[0][1:] == (0, len(x)) else UNKNOWN for x, p in zip(found, parts, strict=True)]
            rows = [[dict(zip(("type", "start", "length"), y, strict=True)) for y in p] for p in parts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(whole, pa.string()), pa.array(rows, part)], names=[*batch.schema.names, "detected", "parts"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    made = plain.mapInArrow(run, f"{fields}, detected string, parts array<struct<type:string,start:bigint,length:bigint>>").toDF(*names, "detected", "parts")
    return made.select(*(F.col(f"`{n}`") for n in names), "detected", (F.col("detected") == F.col(f"`{declared}`")).alias("as_declared"), "parts")


def png_of(samples: bytes, wide: int = 192) -> bytes:
    """A grey image of 8-bit samples, `wide` in a row, without loss."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, wide)
    lines = np.zeros((len(rows), wide + 1), np.uint8)
    lines[:, 1:] = rows

    def chunk(kind: bytes, content: bytes) -> bytes:
        return struct.pack(">I", len(content)) + kind + content + struct.pack(">I", zlib.crc32(content, zlib.crc32(kind)))

    return MAGIC[0][0] + chunk(b"IHDR", struct.pack(">IIBBBBB", wide, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 1)) + chunk(b"IEND", b"")


def samples_of(png: bytes) -> tuple[int, int, bytes]:
    """Width, height and samples of such an image (8-bit grey, rows without a filter)."""
    p, data, wide, high = 8, [], 0, 0
    while p < len(png):
        size, kind = int.from_bytes(png[p : p + 4], "big"), png[p + 4 : p + 8]
        if kind == b"IHDR":
            wide, high, depth, colour = struct.unpack_from(">IIBB", png, p + 8)
            if (depth, colour) != (8, 0):
                raise ValueError("not an image of 8-bit grey samples")
        elif kind == b"IDAT":
            data.append(png[p + 8 : p + 8 + size])
        p += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(high, wide + 1)
    if lines[:, 0].any():
        raise ValueError("rows with a filter")
    return wide, high, lines[:, 1:].tobytes()


def store_texts(docs: DataFrame, unit: int = 192) -> DataFrame:
    """(doc_id, n_bytes long, declared string, media binary), a row for each row of docs: the whole text as UTF-8 (null: empty), filled with spaces to a positive multiple of unit, as samples of an image. The declared type says nothing, as that of raw uploads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in slices(batches):
            made = [png_of(x.ljust(max(1, -(-len(x) // unit)) * unit), unit) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([UNKNOWN] * len(made)), pa.array(made, pa.binary())], names=["doc_id", "n_bytes", "declared", "media"])

    plain = texts(docs)
    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, n_bytes long, declared string, media binary")


def media_features(docs: DataFrame, unit: int = 192) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), a row for each row of docs: texts are stored as images, the stored table is read again, each value is sniffed, and the payload is taken from the part that was carved.

    Null and empty texts are one row of spaces. Repeated rows repeat. Other columns of docs are not looked at. No row gives no row.
    """
    stored, _ = materialize(store_texts(docs, unit), "media")
    known = sniff(stored)
    kind = stored.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in slices(batches, "media"):
            rows = []
            for x, detected, parts in zip(found, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                (part,) = (p for p in parts if p["type"] == TYPES["png"])
                wide, high, samples = samples_of(x[part["start"] : part["start"] + part["length"]])
                total = int(np.frombuffer(samples, np.uint8).sum(dtype=np.int64))
                feature = f"{detected} {wide}x{high} mean {total / len(samples):.4f} parts {len(parts)} at {part['start']}"
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(x), hashlib.sha256(x).hexdigest(), feature))
            cols = list(zip(*rows, strict=True))
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.string() if "sha" in n or n == "feature" else pa.int64()) for c, n in zip(cols, names, strict=True))], names=["doc_id", "n_bytes", *names])

    made = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return known.select("doc_id", "n_bytes", "media", "detected", "parts").mapInArrow(run, made)
