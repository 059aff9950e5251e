"""Long repeats across documents by recompression: rounds that name runs and pairs, the same everywhere, until shared symbols show shared passages."""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.llm.common import bounded, discard, materialize, mix, slices

#: Rounds of naming inside a task. More rounds make longer symbols, which need more of a window around them to be sure.
ROUNDS = 3
#: Rounds of naming in Spark above them: a symbol of the last holds up to two to this power marks.
ABOVE = 3
#: Most words whose hashes a worker keeps; beyond that it starts anew.
KEPT = 200_000
#: Bytes of text whose words are arrays at a time: these take some 40 times as much memory.
SLICE = 2 << 20

class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        v = self[word] = xxhash.xxh64_intdigest(word, 7)
        return v


_known = _Words()


def stretch_hashes(w: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of stretches of a sequence of word hashes, each of all its bytes."""
    held, of = memoryview(np.ascontiguousarray(w)).cast("B"), xxhash.xxh3_64_intdigest
    return np.array([of(held[i:j], seed) for i, j in zip((8 * start).tolist(), (8 * end).tolist(), strict=True)], np.uint64)


def symbols(w: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """Recompression of word hashes w of documents that begin at first (and end at its last item): (name, start, end, sure_from, sure_to) of the symbols that the last round leaves.

    Each round names maximal runs of equal symbols, then the pairs that its two classes of symbols make, a name being a 64-bit hash of what it
    stands for: all tasks give equal runs and pairs equal names in every round, without a dictionary that would have to be shared. Any text that
    holds the words from sure_from to sure_to has this symbol at the same place of them; where that would need the words beyond a document's
    edge, the bound lies outside the document. Starts, ends and both bounds ascend.
    """
    name, a = mix(w), np.arange(len(w))
    b, lo, hi = a + 1, np.repeat(first[:-1], np.diff(first)), np.repeat(first[1:], np.diff(first))
    ca, cb = a, b
    for r in range(rounds):
        m = len(name)
        if not m:
            break
        joined = np.zeros(m + 1, bool)  # joined[i]: i - 1 and i are in one document
        joined[1:m] = lo[1:] == lo[:-1]
        new = ~joined[:m]
        new[1:] |= name[1:] != name[:-1]
        st = np.flatnonzero(new)
        en = np.r_[st[1:], m] - 1
        run = en - st + 1
        name = np.where(run > 1, mix(name[st] + run.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)), name[st])
        ca, cb = np.where(joined[st], ca[st - 1], lo[st] - 1), np.where(joined[en + 1], cb[np.minimum(en + 1, m - 1)], hi[st] + 1)
        a, b, lo, hi = a[st], b[en], lo[st], hi[st]
        m = len(name)
        joined = np.zeros(m + 1, bool)
        joined[1:m] = lo[1:] == lo[:-1]
        right = mix(name + np.uint64(2 * r + 1)) >> np.uint64(63) == 1
        pair = np.zeros(m + 1, bool)  # pair[i]: i is the right half of a pair
        pair[1:m] = ~right[:-1] & right[1:] & joined[1:m]
        st = np.flatnonzero(~pair[:m])
        two = pair[st + 1]
        en = st + two
        name = np.where(two, mix(name[st] * np.uint64(0xE7037ED1A0B428DB) + mix(name[en])), name[st])
        alone_left, alone_right = ~two & ~right[st], ~two & right[st]
        ca_, cb_ = ca[st], cb[en]
        ca_ = np.where(alone_right, np.where(joined[st], ca[st - 1], lo[st] - 1), ca_)
        cb_ = np.where(alone_left, np.where(joined[st + 1], cb[np.minimum(st + 1, m - 1)], hi[st] + 1), cb_)
        ca, cb, a, b, lo, hi = ca_, cb_, a[st], b[en], lo[st], hi[st]
    return name, a, b, ca, cb


def marks(w: np.ndarray, first: np.ndarray, window: int, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """(key, region, start, windows): every window of every document belongs to one mark, the stretch of neighbouring windows that choose the same symbol.

    A window chooses, among the symbols that its own words make sure, the one with the least hashed name (the first of equals); so equal windows
    choose alike wherever they occur. key hashes the words that make the symbol sure, region all the words of the mark's windows. A window that
    makes no symbol sure is a mark by itself, with its own hash as key.
    """
    name, _, _, ca, cb = symbols(w, first, rounds)
    size = np.maximum(np.diff(first) - window + 1, 0)
    at = np.repeat(first[:-1] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
    if not len(at):
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    lo, hi = np.searchsorted(ca, at, "left"), np.searchsorted(cb, at + window, "right")
    bits = np.uint64(max(1, int(len(name)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = [(mix(name + np.uint64(99)) & ~low) | np.arange(len(name), dtype=np.uint64)]
    many = np.maximum(hi - lo, 1)
    step = np.frexp(many)[1] - 1  # floor of the binary logarithm
    for k in range(int(step.max())):
        x = least[-1].copy()
        x[: len(x) - (1 << k)] = np.minimum(x[: len(x) - (1 << k)], least[-1][1 << k :])
        least.append(x)
    tables = np.stack(least)
    end = np.maximum(hi - (1 << step), lo)
    best = np.minimum(tables[step, np.minimum(lo, len(name) - 1)], tables[step, np.minimum(end, len(name) - 1)])
    chosen = np.where(hi > lo, (best & low).astype(np.int64), -1)
    new = np.ones(len(at), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (chosen[1:] < 0) | (at[1:] != at[:-1] + 1)
    st = np.flatnonzero(new)
    many = np.diff(np.r_[st, len(at)])
    start, own = at[st], chosen[st]
    ctx_from, ctx_to = np.where(own >= 0, ca[own], start), np.where(own >= 0, cb[own], start + window)
    return stretch_hashes(w, ctx_from, ctx_to, 1), stretch_hashes(w, start, start + many - 1 + window, 2), start, many


def runs(doc: np.ndarray, key: np.ndarray, region: np.ndarray, start: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, step, times): equal marks of a document at equal distances as runs. In a text that repeats itself every few words each period has the same marks; so a run is one symbol however long the text."""
    order = np.lexsort((start, many, region, key, doc))
    cols = [x[order] for x in (doc, key, region, many)]
    new = np.ones(len(order) + 1, bool)
    new[1:-1] = np.logical_or.reduce([x[1:] != x[:-1] for x in cols]) if len(order) else False
    away = np.diff(start[order], prepend=0)
    turns = ~new[:-1]
    turns[1:] &= ~new[:-2] & (away[1:] != away[:-1])
    new[:-1] |= turns & np.r_[False, np.ones(len(order) - 1, bool)] if len(order) else False
    at = np.flatnonzero(new[:-1])
    times = np.diff(np.r_[at, len(order)])
    step = np.where(times > 1, away[np.minimum(at + 1, max(len(order) - 1, 0))], 1) if len(order) else times
    return order[at], step, times


def _places(length: Column) -> Column:
    """The stretches of so many words that a run's windows (s, step, times) make: one where they touch."""
    each = lambda s, e: F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))
    s, step, last = F.col("s"), F.col("step"), F.col("times") - 1
    apart = F.transform(F.sequence(F.lit(0), last), lambda k: each(s + k * step, s + k * step + length))
    return F.when(step <= length, F.array(each(s, s + step * last + length))).otherwise(apart)


def words_of(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of texts, and where each text's words begin."""
    if len(_known) > KEPT:
        _known.clear()
    split = [x.split() for x in found]
    first = np.r_[0, np.cumsum([len(x) for x in split])]
    return np.fromiter((h for x in split for h in map(_known.__getitem__, x)), np.uint64, int(first[-1])), first


def _spans(covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(covered):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _free(spark) -> None:
    """Let Spark delete the shuffle files of finished steps now, not when the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def shared_symbols(marks_: DataFrame, rounds: int = ABOVE) -> tuple[DataFrame, list[str]]:
    """Marks (doc_id, crc, s, n, step, times, k, r) -> (doc_id, crc, s, n, lo, leaves) and the paths of the tables behind it: each document's marks in symbols, by recompression.

    In each round two classes of names say which neighbours (the second beginning where the first's windows end) make a pair. A pair's name stands
    for the names of its halves, the same in every document, and Spark gathers in which documents it occurs: a pair of one document alone falls
    apart again, one of several is a symbol from then on. lo is the smallest doc_id that has the symbol (null for a single mark), leaves are its marks.
    Equal symbols are equal words as a whole, so all but the smallest doc_id's are repeats, whatever their marks are.
    """
    spark, n = marks_.sparkSession, marks_.count()
    now = marks_.distinct().select("doc_id", "crc", "s", "n", (F.col("times") == 1).alias("whole"), F.col("k").alias("a"), F.col("r").alias("b"), F.lit(None).cast(marks_.schema["doc_id"].dataType).alias("lo"), F.array(F.struct("s", "n", "step", "times", "k", "r")).alias("leaves"))
    paths: list[str] = []
    for j in range(1, rounds + 1):
        w = Window.partitionBy("doc_id", "crc").orderBy("s")
        rows = now.withColumn("right", F.xxhash64("a", "b", F.lit(j)).bitwiseAND(1) == 1)
        rows = rows.withColumn("after", F.lead(F.struct("s", "n", "a", "b", "right", "whole", "leaves")).over(w)).withColumn("before", F.lag(F.struct("s", "n", "a", "b", "right", "whole")).over(w))
        first = F.col("whole") & ~F.col("right") & F.col("after.whole") & F.col("after.right") & (F.col("after.s") == F.col("s") + F.col("n"))
        second = F.col("whole") & F.col("right") & F.col("before.whole") & ~F.col("before.right") & (F.col("before.s") + F.col("before.n") == F.col("s"))
        halves = F.when(first, F.struct("a", "b", F.col("after.a").alias("c"), F.col("after.b").alias("d"))).when(second, F.struct(F.col("before.a").alias("a"), F.col("before.b").alias("b"), F.col("a").alias("c"), F.col("b").alias("d")))
        rows = rows.withColumn("first", F.coalesce(first, F.lit(False))).withColumn("halves", halves).drop("before", "right")
        rows = rows.withColumn("pa", F.when(F.col("halves").isNotNull(), F.xxhash64("halves", F.lit(j)))).withColumn("pb", F.when(F.col("halves").isNotNull(), F.xxhash64(F.lit(-j), "halves.c", "halves.d", "halves.a", "halves.b"))).drop("halves")
        rows, rows_at = materialize(rows, "pairs", n)
        names, names_at = materialize(rows.where("first").groupBy("pa", "pb").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("least < last").select("pa", "pb", "least"), "names", n // 2)
        paired = rows.where("pa is not null").join(names, ["pa", "pb"], "left").where("least is null or first")
        yes = F.col("least").isNotNull()
        made = {"n": F.col("n") + F.col("after.n"), "a": F.col("pa"), "b": F.col("pb"), "lo": F.col("least"), "leaves": F.concat("leaves", "after.leaves")}
        paired = paired.select(*(F.when(yes, made[c]).otherwise(F.col(c)).alias(c) if c in made else F.col(c) for c in now.columns))
        now, now_at = materialize(rows.where("pa is null").select(*now.columns).unionByName(paired), "symbols", n)
        discard(spark, rows_at, names_at, *paths)
        paths = [now_at]
    return now.select("doc_id", "crc", "s", "n", "lo", "leaves"), paths


def text_key(text: Column) -> Column:
    """64 bits that tell texts of one doc_id apart; a null text is an empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def repeated_spans(docs: DataFrame, window: int = 50, rounds: int = ROUNDS) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, crc: text_key of text, spans array<struct<s int, e int>>), a row for each document with a word that a window repeated from a smaller doc_id covers; spans are its words' places, disjoint and ascending.

    1. One pass over the texts makes marks (see `marks`), about one for every twenty words; a run of equal marks of
       a document, as in texts that repeat themselves, is one row.
    2. Keys that occur in one document alone go. Equal windows have equal keys.
    3. Spark rounds name pairs of neighbouring marks, again and again (see `shared_symbols`). Of equal symbols, all but those of the smallest
       doc_id are covered as a whole; only marks that no symbol decides go on.
    4. Of equal regions, all but those of the smallest doc_id are covered as a whole.
    5. Where a key has several regions, one document for each region (the smallest) gives the hashes of its windows, 128 bits each, and a
       window is covered where a smaller doc_id has the same.
    All grouping is by partial aggregates of minima and by joins that can be split, so a passage in a third of the documents gathers nowhere.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in slices(batches, most=SLICE):
            w, first = words_of(found)
            key, region, start, many = marks(w, first, window, rounds)
            doc = np.searchsorted(first, start, side="right") - 1
            head, step, times = runs(doc, key, region, start, many)
            key, region, start, many, doc = key[head], region[head], start[head], many[head], doc[head]
            take = pa.array(doc)
            cols = [x.astype(np.int32) for x in (start - first[doc], many, step, times)]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(region.view(np.int64)), batch.column(0).take(take), batch.column(2).take(take), *map(pa.array, cols)], names=["k", "r", "doc_id", "crc", "s", "n", "step", "times"])

    plain = docs.where("doc_id is not null").select("doc_id", "text", text_key(F.col("text")).alias("crc"))
    made, made_at = materialize(plain.mapInArrow(mark, f"k long, r long, doc_id {kind}, crc long, s int, n int, step int, times int"), "marks")
    # Aggregates are written before they are joined: a join straight on one can't split the hot keys of its other side.
    shared, shared_at = materialize(made.groupBy("k").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("k"), "keys")
    cand, cand_at = materialize(made.join(shared, "k", "left_semi"), "shared")
    discard(spark, made_at, shared_at)
    _free(spark)
    least, least_at = materialize(cand.groupBy("k", "r").agg(F.min("doc_id").alias("d0")), "least")
    split, split_at = materialize(least.groupBy("k").agg(F.count("*").alias("regions")).where("regions > 1"), "split")
    regions, regions_at = materialize(least.join(split, "k", "left"), "regions")
    top, top_at = shared_symbols(cand)
    copied = top.where("doc_id > lo").select("doc_id", "crc", F.array(F.struct("s", F.expr(f"cast(s + n - 1 + {window} as int)").alias("e"))).alias("at"))
    left = top.where("lo is null or doc_id = lo").select("doc_id", "crc", F.explode("leaves").alias("x")).select("doc_id", "crc", "x.*")
    seen, seen_at = materialize(left.join(regions, ["k", "r"]).select("doc_id", "crc", "s", "n", "step", "times", "d0", "regions").where("doc_id > d0 or regions is not null"), "seen")
    discard(spark, cand_at, least_at, split_at, regions_at)
    _free(spark)
    whole = seen.where("doc_id > d0").select("doc_id", "crc", _places(F.col("n") - 1 + window).alias("at"))
    asked = seen.where("doc_id = d0").groupBy("doc_id", "crc").agg(F.collect_list(F.struct("s", "n", "step", "times")).alias("asked"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in slices(batches, most=SLICE):
            w, first = words_of(found)
            rows = batch.column(3).to_pylist()
            begin = [f + x["s"] for f, asks in zip(first.tolist(), rows, strict=False) for x in asks]
            many = np.array([x["n"] for asks in rows for x in asks], np.int64)
            own = np.repeat(np.arange(len(rows)), [sum(x["n"] for x in asks) for asks in rows])
            at = np.repeat(np.array(begin, np.int64) - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            h = [stretch_hashes(w, at, at + window, seed).view(np.int64) for seed in (3, 4)]
            take = pa.array(own)
            step, times = (np.repeat(np.array([x[c] for asks in rows for x in asks], np.int32), many) for c in ("step", "times"))
            yield pa.RecordBatch.from_arrays([*map(pa.array, h), batch.column(0).take(take), batch.column(2).take(take), pa.array((at - first[own]).astype(np.int32)), pa.array(step), pa.array(times)], names=["h", "g", "doc_id", "crc", "s", "step", "times"])

    windows, windows_at = materialize(plain.join(asked.hint("shuffle_hash"), ["doc_id", "crc"]).select("doc_id", "text", "crc", "asked").mapInArrow(each, f"h long, g long, doc_id {kind}, crc long, s int, step int, times int"), "windows")
    _free(spark)
    least, least_at = materialize(windows.groupBy("h", "g").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h", "g", "lo"), "least")
    # What holds for a window of a run's first mark holds for that of each.
    single = windows.join(least, ["h", "g"]).where("doc_id > lo").select("doc_id", "crc", _places(F.lit(window)).alias("at"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        for batch in batches:
            spans = [[{"s": s, "e": e} for s, e in _spans([(x["s"], x["e"]) for places in row for x in places])] for row in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind)], names=["doc_id", "crc", "spans"])

    found = whole.unionByName(single).unionByName(copied).groupBy("doc_id", "crc").agg(F.collect_list("at").alias("spans"))
    out, _ = materialize(found.mapInArrow(merge, f"doc_id {kind}, crc long, spans array<struct<s:int,e:int>>"), "spans")
    discard(spark, seen_at, windows_at, least_at, *top_at)
    _free(spark)
    return out


def without_repeats(docs: DataFrame, window: int = 50, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_words long, n_removed long, kept string), a row for each row of docs: the words that no window repeated from a smaller doc_id covers, joined by one space.

    Windows are `window` words of one document and are judged on the input. Texts with fewer words lose nothing; null texts have no words.
    Repeated rows are not "smaller" than each other, so they keep what no third row covers. Rows without doc_id neither lose words nor take
    any from others. Other columns of docs are not looked at. No row gives no row.
    """
    plain = bounded(docs).select(F.col("`doc_id`").alias("doc_id"), F.coalesce(F.col("`text`"), F.lit("")).alias("text")).withColumn("crc", text_key(F.col("text")))
    spans = repeated_spans(plain, window, rounds)
    kind = plain.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in slices(batches):
            words, removed, kept = [], [], []
            for x, gone in zip(found, batch.column(2).to_pylist(), strict=True):
                own = x.split()
                words.append(len(own))
                removed.append(sum(g["e"] - g["s"] for g in gone or ()))
                for g in reversed(gone or ()):
                    del own[g["s"] : g["e"]]
                kept.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string(), safe=False)], names=["doc_id", "n_words", "n_removed", "kept"])

    both = plain.join(spans.hint("shuffle_hash"), ["doc_id", "crc"], "left").select("doc_id", "text", "spans")
    return both.mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept string")


def cut_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the words of spans (see repeated_spans) cut out of their texts, the rest joined by one space, and n_chars, if there is such a column, set to the new length. Rows without spans stay as they are. Columns of docs are renamed meanwhile, so their names may be anything."""
    names = docs.columns
    cols = [f"__{k}" for k in range(len(names))]
    doc, text = cols[names.index("doc_id")], cols[names.index("text")]
    plain = bounded(docs).toDF(*cols)
    found = spans.select(F.col("doc_id").alias("span_doc"), F.col("crc").alias("span_crc"), "spans")
    both = plain.join(found.hint("shuffle_hash"), (F.col(doc) == F.col("span_doc")) & (text_key(F.col(text)) == F.col("span_crc")), "left").select(*cols, "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts_ in slices(batches, text):
            kept = batch.column(names.index("text")).cast(pa.binary()).to_pylist()
            for k, gone in enumerate(batch.column(len(names)).to_pylist()):
                if gone:
                    own = texts_[k].split()
                    for g in reversed(gone):
                        del own[g["s"] : g["e"]]
                    kept[k] = b" ".join(own)
            out = list(batch.columns[: len(names)])
            out[names.index("text")] = pa.array(kept, pa.binary()).cast(batch.schema.field(text).type, safe=False)
            yield pa.RecordBatch.from_arrays(out, names=cols)

    cut = both.mapInArrow(run, plain.schema).toDF(*names)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else cut


def digest(kept: DataFrame) -> DataFrame:
    """The kept text as its SHA-256."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple], window: int = 50) -> list[tuple]:
    """The same by looking at every window, for tests."""
    least: dict[tuple, object] = {}
    split = [(d, (x or "").encode().split()) for d, x in rows]
    for d, own in split:
        for i in range(len(own) - window + 1):
            key = tuple(own[i : i + window])
            if d is not None:
                least[key] = min(least.get(key, d), d)
    out = []
    for d, own in split:
        gone: set[int] = set()
        for i in range(len(own) - window + 1):
            if d is not None and least[tuple(own[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(own) if i not in gone)
        out.append((d, len(own), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
