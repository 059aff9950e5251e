"""Phrases whose words stand together more often than their parts lead one to expect: counted as fixed-width keys of word numbers, sorted by range and counted by runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens.llm.common import bounded, discard, materialize, numbered, slices

#: Every byte that ends a piece becomes a full stop, tabs become spaces, A-Z small; a full stop is no byte of a word, so it can stand between words as a mark.
_SMALL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz .........")
#: Words of a row of codes, keys that a task sorts at a time, rows of an Arrow batch of keys, parts of a language in which its best phrases are sought first.
ROW, KEYS, BATCH, SALT = 1 << 20, 1 << 21, 1 << 16, 32
#: Word numbers are 32 bits of a key, 0 meaning none.
MOST_WORDS = (1 << 32) - 2


def coded(docs: DataFrame) -> DataFrame:
    """(row long, lang, words: array of binary, counts: array of long, own int, codes: binary): texts of one language, as many as an Arrow batch holds, as 32-bit numbers into the row's own list of words; -1 ends a piece. n-grams begin at the first `own` codes; up to two more follow, so that a long text may be several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in slices(batches):
            langs: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), found, strict=True):
                langs.setdefault(lang, []).append(text)
            for lang, own in langs.items():
                known: dict[bytes, int] = {b".": 0}
                words = b".".join(own).translate(_SMALL).replace(b".", b" . ").split(b" ")
                codes = np.fromiter((known.setdefault(w, len(known)) for w in words if w), np.int32)
                names = np.array([*known], object)
                for at in range(0, len(codes), ROW):
                    here = codes[at : at + ROW + 2]
                    used, inside = np.unique(here, return_inverse=True)
                    counts = np.bincount(inside[: ROW], minlength=len(used))
                    stop = int(used[0] == 0)
                    yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([names[used[stop:]].tolist()], pa.list_(pa.binary())), pa.array([counts[stop:]], pa.list_(pa.int64())), pa.array([min(ROW, len(here))], pa.int32()), pa.array([(inside - stop).astype("<i4").tobytes()], pa.binary())], names=["lang", "words", "counts", "own", "codes"])

    plain = bounded(docs).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    rows = plain.mapInArrow(run, "lang string, words array<binary>, counts array<long>, own int, codes binary")
    return rows.select(F.monotonically_increasing_id().alias("row"), "*")


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows of unsigned 32-bit numbers, first column first: stable passes over digits of 16 bits from the last one on (each a counting sort), digits that are the same everywhere left out."""
    order = np.arange(len(columns[0]))
    for col in reversed(columns):
        for shift in (0, 16):
            digit = (col >> np.uint32(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def packed(columns: list[np.ndarray]) -> pa.Array:
    """12-byte keys whose byte order is the order of their three numbers."""
    data = np.stack(columns, axis=1).astype(">u4").tobytes()
    n = len(columns[0])
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * 12).astype(np.int32).tobytes()), pa.py_buffer(data)])


def unpacked(keys: pa.Array) -> np.ndarray:
    """The three numbers of each key, as rows."""
    offsets = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1]
    return np.frombuffer(keys.buffers()[2], ">u4", 3 * len(keys), int(offsets[0])).reshape(-1, 3).astype(np.uint32)


def keys_of(codes: np.ndarray, own: int, numbers: np.ndarray) -> list[np.ndarray]:
    """The key columns of the n-grams that begin at the first `own` codes: two frequent words of one piece and the third one, 0 if there is none. codes index numbers, its last entry (-1) being 0."""
    ids = np.concatenate([numbers[codes], np.zeros(2, np.uint32)])
    first, second, third = ids[:own], ids[1 : own + 1], ids[2 : own + 2]
    at = np.flatnonzero((first > 0) & (second > 0))
    return [first[at], second[at], third[at]]


def combined(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Batches of (key, n): the distinct keys, sorted, with their counts."""
    order = radix_order(columns)
    columns = [c[order] for c in columns]
    begin = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)])
    counts = np.diff(np.r_[begin, len(order)])
    for i in range(0, len(begin), BATCH):
        at = begin[i : i + BATCH]
        yield pa.RecordBatch.from_arrays([packed([c[at] for c in columns]), pa.array(counts[i : i + BATCH])], names=["key", "n"])


def grams(rows: DataFrame) -> DataFrame:
    """(key: binary of 12 bytes, n): rows(own, codes, numbers: array of struct(local, id)) as keys, each task's counted before they leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for own, codes, pairs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                codes = np.frombuffer(codes.as_buffer(), "<i4")
                local, ids = (np.asarray(pairs.values.field(k)) for k in ("local", "id"))
                numbers = np.zeros(int(codes.max()) + 2, np.uint32)
                numbers[local] = ids
                held.append(keys_of(codes, own, numbers))
                n += len(held[-1][0])
                if n >= KEYS:
                    yield from combined([np.concatenate(c) for c in zip(*held, strict=True)])
                    held, n = [], 0
        if n:
            yield from combined([np.concatenate(c) for c in zip(*held, strict=True)])

    return rows.select("own", "codes", "numbers").mapInArrow(run, "key binary, n long")


def run_lengths(least: int):
    """A function over batches of sorted (key, n): (id1, id2, id3, n: long) for each run of at least `least`: whole keys (id3 > 0) and, with id3 = 0, their first two numbers. A run of two numbers may go on in the next partition, so a partition's first and last ones are given whatever their counts, and have to be summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, pair, inside = (np.zeros((0, 3), np.uint32), np.zeros(0, np.int64)), (np.zeros((0, 3), np.uint32), np.zeros(0, np.int64)), False

        def runs(held: tuple, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ids, n = np.concatenate([held[0], ids]), np.concatenate([held[1], n])
            begin = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)])
            return ids[begin], np.add.reduceat(n, begin)

        def out(ids: np.ndarray, n: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(ids[keep, k].astype(np.int64)) for k in range(3)), pa.array(n[keep])], names=["id1", "id2", "id3", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, n = unpacked(batch.column(0)), np.asarray(batch.column(1))
            found, sums = runs(whole, ids, n)
            whole = found[-1:], sums[-1:]
            yield out(found[:-1], sums[:-1], (sums[:-1] >= least) & (found[:-1, 2] > 0))
            found, sums = runs(pair, ids * np.array([1, 1, 0], np.uint32), n)
            pair = found[-1:], sums[-1:]
            keep = sums[:-1] >= least
            if len(keep) and not inside:
                keep[0] = inside = True
            yield out(found[:-1], sums[:-1], keep)
        yield out(*whole, (whole[1] >= least) & (whole[0][:, 2] > 0))
        yield out(*pair, np.ones(len(pair[1]), bool))

    return run


def dictionary(rows: DataFrame, least: int) -> DataFrame:
    """(lang, word binary, f, id long): the words of a language that occur at least so often, numbered from 1. Occurrences are counted in each row of codes before they meet."""
    each = rows.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("word"), F.col("w.counts").alias("c")).where("c > 0")
    frequent, path = materialize(each.groupBy("lang", "word").agg(F.sum("c").alias("f")).where(F.col("f") >= least), "frequent")
    known, _ = materialize(numbered(frequent, ["lang", "word"], "id").withColumn("id", F.col("id") + 1), "dictionary")
    discard(known.sparkSession, path)
    if (known.agg(F.max("id")).first()[0] or 0) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} frequent words don't fit into keys of 32 bits for each")
    return known


def counted(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, words, kept): totals(lang, n), words(lang, word, f, id), kept(id1, id2, id3, n: every phrase of two words (id3 = 0) or three that occurs at least so often).

    A phrase is no more frequent than its words, so rarer words only end pieces. Word numbers reach the texts by way of each row's own list of
    words, not by a broadcast dictionary nor by a join of every word. A hot key is one row for each 2 million keys of a task.
    """
    spark = docs.sparkSession
    rows, rows_path = materialize(coded(docs), "codes")
    words = dictionary(rows, least)
    totals, _ = materialize(rows.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")), "totals")
    lists = rows.select("row", "lang", F.posexplode("words").alias("local", "word")).join(words.select("lang", "word", "id"), ["lang", "word"])
    numbers, numbers_path = materialize(lists.groupBy("row").agg(F.collect_list(F.struct("local", "id")).alias("numbers")), "numbers")
    keys, keys_path = materialize(grams(rows.select("row", "own", "codes").join(numbers, "row")), "keys", batch=16)
    discard(spark, rows_path, numbers_path)
    runs = keys.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run_lengths(least), "id1 long, id2 long, id3 long, n long")
    parts, parts_path = materialize(runs, "runs", batch=BATCH)
    kept, _ = materialize(parts.groupBy("id1", "id2", "id3").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "phrases")
    discard(spark, keys_path, parts_path)
    return totals, words, kept


def score(a: str, left: str, right: str) -> str:
    """floor(1000000 * a * a / (left * right)) in decimals of 38 digits; counts below 10^16."""
    big = lambda c: f"cast({c} as decimal(18,0))"
    return f"(cast(1000000 as decimal(7,0)) * {big(a)} * {big(a)}) div ({big(left)} * {big(right)})"


def collocations(docs: DataFrame, least: int = 10, best: int = 2000, inside: int = 50) -> DataFrame:
    """(lang, rank int, phrase, a, l, r, n, score: long): each language's first `best` phrases of two or three words that occur at least `least` times.

    A phrase's score is that of its lowest-scoring cut into two parts, the shorter first part if scores are equal. Phrases inside a longer one
    that has at least `inside` percent of their occurrences are left out. Order: score and occurrences descending, phrase by UTF-8 bytes. A null
    language is 'und' (and one with texts of 'und'), a null text is empty; repeated rows count each; words are bytes, so texts that are no UTF-8
    count as they are. A language without phrases gives no row, an empty table none at all. Extra columns are not looked at.
    """
    totals, words, kept = counted(docs, least)
    first = words.select("lang", F.col("id").alias("id1"), F.col("word").alias("w1"), F.col("f").alias("f1"))
    second = words.select(F.col("id").alias("id2"), F.col("word").alias("w2"), F.col("f").alias("f2"))
    pairs, _ = materialize(kept.where("id3 = 0").drop("id3").join(first, "id1").join(second, "id2"), "pairs")
    ahead = pairs.select("lang", "id1", "id2", "w1", "w2", "f1", F.col("n").alias("f12"))
    behind = pairs.select(F.col("id1").alias("id2"), F.col("id2").alias("id3"), F.col("w2").alias("w3"), F.col("f2").alias("f3"), F.col("n").alias("f23"))
    triples, _ = materialize(kept.where("id3 > 0").withColumnRenamed("n", "a").join(ahead, ["id1", "id2"]).join(behind, ["id2", "id3"]), "triples")
    cuts = triples.withColumn("s1", F.expr(score("a", "f1", "f23"))).withColumn("s2", F.expr(score("a", "f12", "f3"))).withColumn("one", F.expr("s1 <= s2"))
    longer = cuts.select("lang", F.concat_ws(" ", *[F.col(w).cast("string") for w in ("w1", "w2", "w3")]).alias("phrase"), "a", F.expr("if(one, f1, f12)").alias("l"), F.expr("if(one, f23, f3)").alias("r"), F.expr("if(one, s1, s2)").alias("score"))
    around = triples.select("id1", "id2", "a").unionByName(triples.select(F.col("id2").alias("id1"), F.col("id3").alias("id2"), "a")).groupBy("id1", "id2").agg(F.max("a").alias("most"))
    free = pairs.join(around, ["id1", "id2"], "left").where(F.expr(f"most is null or most * 100 < n * {inside}"))
    shorter = free.select("lang", F.concat_ws(" ", F.col("w1").cast("string"), F.col("w2").cast("string")).alias("phrase"), F.col("n").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"), F.expr(score("n", "f1", "f2")).alias("score"))
    # The best of each of a language's parts first, so that no task sorts all its phrases.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = longer.unionByName(shorter).withColumn("_salt", F.expr(f"pmod(xxhash64(phrase), {SALT})"))
    some = salted.withColumn("_nth", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_nth") <= best)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
