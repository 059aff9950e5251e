"""Token ids of whole texts from the tokenizers library, and their flat binary files."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm.common import Memo, scratch, slices, texts

#: Characters that some regular expression engines take for white space and Python doesn't. Fixed values.
ALSO_SPACE = "᠎​⁠﻿"

#: Letters, and what is behind them if that begins with an ASCII character: a pre-token of letters ends there.
LETTERS = re.compile(r"([A-Za-zªµºÀ-ÖØ-öø-ɏ]+)([\x00-\x7f].*)?", re.DOTALL).fullmatch


class Ids:
    """encode(texts) gives each text's ids as little-endian uint32 bytes, as the library does for the whole text without added special tokens.

    For a byte-level BPE with its usual pattern, a blank before a character that is no white space always begins a new pre-token, so a text is
    cut there and each distinct piece goes through the library once for a worker, its leading letters and the rest apart. Texts where a blank has white space behind it or that hold an
    added token's string go through the library whole, as do all texts of tokenizers of another make.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        made = json.loads(self.tok.to_str())
        pre = made.get("pre_tokenizer") or {}
        self.cut = not made.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and made["model"]["type"] == "BPE" and not made["model"].get("dropout")
        self.added = [x["content"] for x in made.get("added_tokens", [])]
        self.size = self.tok.get_vocab_size()
        self.known, self.rests = Memo(self._piece), Memo(lambda x: self._whole([x])[0])
        self.model = self.tok.model
        # The byte-level alphabet: bytes that are no visible Latin-1 character stand from U+0100 on, in order.
        hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
        self.alphabet = {b: 256 + k for k, b in enumerate(hidden)}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, x: str) -> bytes | None:
        """Ids of a blank and x; None if x can't be cut off. A blank and letters are one pre-token, which the model takes in its alphabet of bytes."""
        if found := LETTERS(x):
            head, tail = found.groups()
            if tail:
                return self.known[head] + self.rests[tail]
            plain = x if x.isascii() else x.encode().decode("latin-1").translate(self.alphabet)
            return array("I", [t.id for t in self.model.tokenize("Ġ" + plain)]).tobytes()
        return None if not x or x[0].isspace() or x[0] in ALSO_SPACE else self._whole([" " + x])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cut:
            return self._whole(texts)
        for memo in (self.known, self.rests):
            memo.turn()
        heads = self._whole([x.partition(" ")[0] for x in texts])
        get, out, late = self.known.__getitem__, [], []
        for k, x in enumerate(texts):
            try:
                _, *pieces = (" ", " ") if any(s in x for s in self.added) else x.split(" ")
                out.append(heads[k] + b"".join(map(get, pieces)))
            except TypeError:
                out.append(b"")
                late.append(k)
        for k, x in zip(late, self._whole([texts[k] for k in late]), strict=True):
            out[k] = x
        return out


@lru_cache(maxsize=4)
def ids_of(path: str) -> Ids:
    """One Ids for each tokenizer file and worker."""
    return Ids(path)


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch, found in slices(batches):
        yield batch, ids_of(path).encode([x.decode(errors="replace") for x in found])


def crc(ids: bytes) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids)


class Folder:
    """Files below a URI that all machines reach: the local file system directly (so that ids can be memory-mapped), others through pyarrow."""

    def __init__(self, uri: str):
        parts = urlparse(uri)
        self.local = parts.scheme in ("", "file")
        if self.local:
            self.base, self.fs = parts.path, None
        else:
            from pyarrow import fs

            self.fs, self.base = fs.FileSystem.from_uri(uri)

    def put(self, name: str, pieces: Iterator[bytes]) -> None:
        """Write under another name, then rename: a task that is lost or runs twice leaves one whole file."""
        to = f"{self.base}/{name}"
        part = f"{to}.{os.getpid()}-{os.urandom(6).hex()}.part"
        if self.local:
            os.makedirs(self.base, exist_ok=True)
            with open(part, "wb") as f:
                f.writelines(pieces)
            os.replace(part, to)
        else:
            self.fs.create_dir(self.base)
            with self.fs.open_output_stream(part) as f:
                for x in pieces:
                    f.write(x)
            self.fs.move(part, to)

    def array(self, name: str, dtype: np.dtype) -> np.ndarray:
        """A file's integers, memory-mapped where the file system allows it."""
        at = f"{self.base}/{name}"
        if self.local:
            return np.memmap(at, dtype, "r") if os.path.getsize(at) else np.empty(0, dtype)
        with self.fs.open_input_file(at) as f:
            return np.frombuffer(f.read(), dtype)


def width(size: int) -> np.dtype:
    """The narrowest unsigned type that holds every id below size."""
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def write_ids(docs: DataFrame, path: str, end_id: int | None, uri: str, partitions: int | None = None) -> DataFrame:
    """Write the ids of every whole text, end_id appended to each, in ascending doc_id order. Returns the manifest: part int, n_docs long, n_tokens long, nulls long (leading documents without doc_id), base long (ids before the part).

    Part k is ids-k.bin (flat little-endian unsigned integers, 16 bits wide if the vocabulary allows it), offsets-k.bin (64-bit starts of its
    documents inside the part, and the end) and docs-k.bin (64-bit doc_ids). Documents are dealt by ranges of doc_id and of a hash of their text, so
    rows of one doc_id and rows without one don't meet in one task; every part is sorted, written under another name and renamed. Bases are prefix sums over the manifest, one row for each part.
    Rows without doc_id come first and have a 0 in docs-k.bin; the manifest counts them. No row gives an empty manifest.
    """
    spark = docs.sparkSession
    plain = texts(docs)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, folder, kind = TaskContext.get().partitionId(), Folder(uri), width(max(ids_of(path).size, (end_id or 0) + 1))
        end = b"" if end_id is None else np.array([end_id], kind).tobytes()
        sizes: list[int] = []
        ids: list[np.ndarray] = []
        nulls: list[int] = []

        def pieces() -> Iterator[bytes]:
            for batch, found in encoded(batches, path):
                ids.append(np.asarray(batch.column(0).fill_null(0), "<i8"))
                nulls.append(batch.column(0).null_count)
                for x in found:
                    sizes.append(len(x) // 4 + bool(end))
                    yield np.frombuffer(x, "<u4").astype(kind).tobytes() + end

        folder.put(f"ids-{part:06d}.bin", pieces())
        folder.put(f"offsets-{part:06d}.bin", iter([np.concatenate([[0], np.cumsum(sizes, dtype="<i8")]).astype("<i8").tobytes()]))
        folder.put(f"docs-{part:06d}.bin", iter([x.tobytes() for x in ids]))
        if sizes:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64()), pa.array([sum(nulls)], pa.int64())], names=["part", "n_docs", "n_tokens", "nulls"])

    by = ["doc_id", "salt"]
    dealt = plain.withColumn("salt", F.xxhash64("text")).repartitionByRange(n, *by).sortWithinPartitions(*by, "text")
    made = dealt.select("doc_id", "text").mapInArrow(run, "part int, n_docs long, n_tokens long, nulls long")
    rows = sorted(made.collect())  # one row for each part
    before = np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])]).astype(int).tolist()
    return spark.createDataFrame([(*r, b) for r, b in zip(rows, before, strict=False)], "part int, n_docs long, n_tokens long, nulls long, base long")


def read_ids(manifest: DataFrame, uri: str, kind: np.dtype) -> DataFrame:
    """(doc_id, start long, n_tokens long, ids_crc32 long) from the files that a manifest names: start counts the ids of all documents before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder(uri)
        for batch in batches:
            for part, base, nulls in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, at, docs = folder.array(f"ids-{part:06d}.bin", kind), folder.array(f"offsets-{part:06d}.bin", np.dtype("<i8")), folder.array(f"docs-{part:06d}.bin", np.dtype("<i8"))
                for lo in range(0, len(docs), 8192):
                    hi = min(len(docs), lo + 8192)
                    crcs = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(at[lo:hi].tolist(), at[lo + 1 : hi + 1].tolist(), strict=True)]
                    own = np.asarray(docs[lo:hi])
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64(), mask=np.arange(lo, hi) < nulls), pa.array(at[lo:hi] + base), pa.array(np.diff(at[lo : hi + 1])), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("part", "base", "nulls").repartition(max(1, manifest.count()), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, end_id: int | None, uri: str | None = None) -> DataFrame:
    """Write the token files of docs and read them back: one row for each row of docs, null texts counting as empty. Other columns of docs are not looked at; repeated rows stay, in any order among themselves."""
    spark = docs.sparkSession
    uri = uri or scratch(spark, "ids")
    manifest = write_ids(docs, path, end_id, uri)
    return read_ids(manifest, uri, width(max(ids_of(path).size, (end_id or 0) + 1)))
