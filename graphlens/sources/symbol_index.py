"""Symbol indexes in their binary wire format as a data source: a document a row, only the asked fields decoded."""

from __future__ import annotations

import mmap
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from graphlens.operators.gaps import gap

DOCUMENTS = (
    "index string, relative_path string, language string, "
    "occurrences array<struct<range:array<int>,symbol:string,symbol_roles:int,enclosing_range:array<int>>>, symbols array<struct<symbol:string,kind:int,display_name:string>>, error string"
)
#: Numbers of the fields that are read. Fixed values of the index format.
INDEX_DOCUMENT = 2
DOCUMENT = {1: "relative_path", 2: "occurrences", 3: "symbols", 4: "language"}
OCCURRENCE = {1: "range", 2: "symbol", 3: "symbol_roles", 7: "enclosing_range"}
SYMBOL = {1: "symbol", 5: "kind", 6: "display_name"}
#: Wire types: a number, eight bytes, bytes with their length, four bytes. Fixed values.
NUMBER, EIGHT, BYTES, FOUR = 0, 1, 2, 5
#: Bytes of an index that one task reads.
SPLIT_BYTES = 32 << 20


class Damaged(ValueError):
    """What is no such index, or ends before its parts do."""


def number(data, at: int, end: int) -> tuple[int, int]:
    """A number of seven bits a byte, low ones first, and the place behind it."""
    out = shift = 0
    while True:
        if at >= end or shift > 63:
            raise Damaged("a number has no end")
        b = data[at]
        at += 1
        out |= (b & 0x7F) << shift
        if b < 0x80:
            return out, at
        shift += 7


def fields(data, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(field, wire type, begin, end) of a message's fields; for a number begin is its value. Contents are passed over, not read."""
    while at < end:
        key, at = number(data, at, end)
        field, kind = key >> 3, key & 7
        if kind == NUMBER:
            value, at = number(data, at, end)
            yield field, kind, value, at
            continue
        if kind == BYTES:
            size, at = number(data, at, end)
        elif kind in (EIGHT, FOUR):
            size = 8 if kind == EIGHT else 4
        else:
            raise Damaged(f"wire type {kind} is not known")
        if at + size > end:
            raise Damaged("a field is cut off")
        yield field, kind, at, at + size
        at += size


def _int(value: int) -> int:
    """32 bits with a sign; other bits of a number are dropped, as the format has it."""
    value &= 0xFFFFFFFF
    return value - (1 << 32) if value >> 31 else value


def _record(data, at: int, end: int, names: dict[int, str], lists: tuple[str, ...] = ()) -> dict:
    """The named fields of a message of strings, numbers and (packed or single) lists of numbers. The last value of a field counts."""
    out: dict = {}
    for field, kind, a, b in fields(data, at, end):
        name = names.get(field)
        if name is None:
            continue
        if name in lists:
            own = out.setdefault(name, [])
            if kind == NUMBER:
                own.append(_int(a))
            while kind == BYTES and a < b:
                v, a = number(data, a, b)
                own.append(_int(v))
        else:
            out[name] = _int(a) if kind == NUMBER else bytes(data[a:b]).decode("utf-8", errors="replace")
    return out


def document(data, at: int, end: int, wanted: frozenset[str]) -> dict:
    """The wanted fields of one document; messages of others are passed over."""
    out: dict = {"occurrences": [], "symbols": [], "relative_path": "", "language": ""}
    for field, kind, a, b in fields(data, at, end):
        name = DOCUMENT.get(field)
        if name not in wanted or kind != BYTES:
            continue
        if name == "occurrences":
            x = _record(data, a, b, OCCURRENCE, ("range", "enclosing_range"))
            out[name].append((x.get("range", []), x.get("symbol", ""), x.get("symbol_roles", 0), x.get("enclosing_range")))
        elif name == "symbols":
            x = _record(data, a, b, SYMBOL)
            out[name].append((x.get("symbol", ""), x.get("kind", 0), x.get("display_name", "")))
        else:
            out[name] = bytes(data[a:b]).decode("utf-8", errors="replace")
    return out


class _Split(InputPartition):
    def __init__(self, path: str, lo: int, hi: int):
        self.path, self.lo, self.hi = path, lo, hi


class IndexReader(DataSourceReader):
    """Index files cut into ranges of bytes. Documents have no marks between them, so a task passes over the heads of those before its range and decodes those that begin in it."""

    def __init__(self, path: str, schema: StructType, split: int):
        self.names, self.split = schema.names, split
        self.paths = sorted(os.path.join(path, x) for x in os.listdir(path) if x.endswith(".scip")) if os.path.isdir(path) else [path]

    def partitions(self) -> list[InputPartition]:
        sizes = [(p, os.path.getsize(p)) for p in self.paths]
        return [_Split(p, lo, min(lo + self.split, n)) for p, n in sizes for lo in range(0, max(n, 1), self.split)]

    def read(self, part: _Split) -> Iterator[tuple]:
        wanted = frozenset(self.names)
        size = os.path.getsize(part.path)

        def row(error: str | None = None, **found) -> tuple:
            return tuple({**found, "index": part.path, "error": error}.get(n) for n in self.names)

        if not size:
            yield row("the index is empty")
            return
        with open(part.path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            at, heads = 0, fields(data, 0, size)
            while at < part.hi:
                try:
                    field, kind, a, b = next(heads)
                except StopIteration:
                    return
                except Damaged as e:
                    if at >= part.lo:
                        yield row(str(e))
                    return
                begin, at = at, b
                if field != INDEX_DOCUMENT or kind != BYTES or begin < part.lo:
                    continue
                try:
                    yield row(**document(data, a, b, wanted))
                except Damaged as e:
                    yield row(f"a document at byte {begin}: {e}")


class SymbolIndexSource(DataSource):
    """spark.read.format("symbol_index").schema(some of DOCUMENTS).option("splitBytes", n).load(file, or folder of *.scip)."""

    @classmethod
    def name(cls) -> str:
        return "symbol_index"

    def schema(self) -> str:
        return DOCUMENTS

    def reader(self, schema: StructType) -> DataSourceReader:
        return IndexReader(self.options["path"], schema, int(self.options.get("splitBytes", SPLIT_BYTES)))


def read_documents(spark: SparkSession, path: str, schema: str = DOCUMENTS, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """DOCUMENTS, or the columns of schema alone, of an index file or of a folder's *.scip files. A damaged document, and the damaged rest of a file, is a row with an error; the documents before it stay. An empty file is one such row."""
    spark.dataSource.register(SymbolIndexSource)
    return spark.read.format("symbol_index").schema(schema).option("splitBytes", str(split_bytes)).load(path)


def tables(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(occurrences, infos, gaps) of DOCUMENTS, as sources.tools.read_index gives them. An index with any error counts as failed and gives nothing but a gap, so that what is in its files falls back to names; other indexes are not touched by it."""
    failed = documents.where("error is not null").groupBy("index").agg(F.min("error").alias("detail"), F.count("*").alias("n"))
    good = documents.where("error is null and relative_path <> ''").join(failed.select("index"), "index", "left_anti")
    docs = good.withColumn("file", F.replace("relative_path", F.lit("\\"), F.lit("/")))
    occ = docs.select("file", F.explode("occurrences").alias("o")).select("file", "o.symbol", F.col("o.symbol_roles").alias("roles"), "o.range", "o.enclosing_range")
    infos = docs.select("file", F.explode("symbols").alias("s")).select("file", "s.symbol", F.col("s.kind").cast("string").alias("kind"), "s.display_name")
    gaps = gap(failed, "resolve", "repo", "index_failed", path=F.col("index"), detail=F.col("detail"), impact="calls of this index's files are resolved by names", count=F.col("n"))
    return occ.where("symbol <> '' and size(range) > 0"), infos, gaps
