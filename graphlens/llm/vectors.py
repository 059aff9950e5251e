"""Nearest neighbours by an adaptive dimension scan: rotated vectors in column blocks, candidates being given up early by hypothesis tests on partial distances."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens.llm.common import discard, materialize

#: Most vectors, by the hash of their ids, on which the lists' centres and the number of probed lists are fitted. Every vector is indexed.
SAMPLE = 8_000
#: Queries of the sample on which the number of probed lists is chosen, and the share of their neighbours that the lists must hold.
TRIALS, RECALL = 200, 0.97
#: The part of the table whose best products bound a query's search: one row of so many, SAMPLE rows at most, however small the table is.
BOUND_SHARE = 8
#: Most vectors and queries of one list in one task; larger lists are dealt into blocks.
LIST_ROWS, QUERY_ROWS = 2_048, 1_024
#: Dimensions of a column block, vectors that are scanned between two looks at the bound, and how sure a test must be (in deviations).
COLUMNS, ROWS, SURE = 24, 2048, 2.1


@dataclass
class Index:
    """What the driver fits on a bounded sample and hands to all tasks: the rotation, the lists' centres and the number of probed lists."""

    dim: int
    norm2: float  # no vector's squared length is more
    rotation: np.ndarray
    centres: np.ndarray
    probes: int
    sample: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Vectors with one dimension more, all of the same length: there the nearest are those of the largest inner product. Rotated, so that any few dimensions tell about all."""
        more = np.sqrt(np.maximum(self.norm2 - np.einsum("ij,ij->i", x, x), 0))
        return np.c_[x, more] @ self.rotation

    def turn(self, q: np.ndarray) -> np.ndarray:
        """Queries, which have 0 in that dimension."""
        return np.c_[q, np.zeros(len(q))] @ self.rotation

    def lists(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n lists with the nearest centres, nearest first."""
        away = np.einsum("ij,ij->i", self.centres, self.centres) - 2 * x @ self.centres.T
        return np.argsort(away, axis=1, kind="stable")[:, :n]


def fit(x: np.ndarray, norm2: float, rows: int, k: int, seed: int = 7) -> Index:
    """An index over vectors like the sample x of `rows` vectors: about the square root of rows / 16 lists by k-means, and as many probes as hold RECALL of the trials' neighbours in the sample."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    rotation = np.linalg.qr(rng.normal(size=(dim + 1, dim + 1)))[0]
    index = Index(dim, norm2, rotation, np.zeros((1, dim + 1)), 1, np.empty((0, dim)))
    lifted = index.lift(x)
    n = max(1, min(1024, len(np.unique(lifted, axis=0)), round(math.sqrt(rows / 16))))
    index.centres = lifted[rng.choice(len(x), n, replace=False)]
    for _ in range(12):
        own = index.lists(lifted, 1)[:, 0]
        total = np.zeros_like(index.centres)
        np.add.at(total, own, lifted)
        size = np.bincount(own, minlength=n)
        index.centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], index.centres)
    own = index.lists(lifted, 1)[:, 0]
    asked = rng.choice(len(x), min(TRIALS, len(x)), replace=False)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    order = np.argsort(index.lists(index.turn(x[asked]), n), axis=1)  # place of each list among the query's
    needs = np.take_along_axis(order, own[near], axis=1).ravel()
    index.probes = int(np.quantile(needs, RECALL, method="higher")) + 1 if len(needs) else n
    index.sample = x[: min(SAMPLE, rows // BOUND_SHARE)]
    return index


def scan(q: np.ndarray, x: np.ndarray, keep: int, bound: float) -> np.ndarray:
    """Places in x of candidates for the `keep` nearest to q, both rotated: those whose squared distance stays within the bound.

    x goes by blocks of rows and of columns. After each block of columns a candidate's partial distance, scaled to all dimensions, is tested
    against the bound: rotated at random, it strays from the whole by more than SURE / sqrt(columns seen) of it in few cases, so one that is
    larger still is given up. The bound falls to the keep-th distance found so far.
    """
    dim, out, away = x.shape[1], [], []
    kept = np.empty(0)
    slack = 1e-5 * float(q @ q + (x[0] @ x[0] if len(x) else 0))  # more than the rounding of single precision; vectors in x are of one length
    for lo in range(0, len(x), ROWS):
        hi = min(lo + ROWS, len(x))
        rows = np.arange(lo, hi)
        part = np.zeros(len(rows), x.dtype)
        for c in range(0, dim, COLUMNS):
            block = x[lo:hi, c : c + COLUMNS]
            d = (block if len(rows) == hi - lo else block[rows - lo]) - q[c : c + COLUMNS]
            part += np.einsum("ij,ij->i", d, d)
            seen = min(c + COLUMNS, dim)
            if seen < dim and bound < np.inf:
                stay = part * (dim / seen) <= bound * (1 + SURE / math.sqrt(seen)) ** 2
                rows, part = rows[stay], part[stay]
                if not len(rows):
                    break
        stay = part <= bound + slack
        out.append(rows[stay])
        away.append(part[stay])
        kept = np.concatenate([kept, away[-1]])
        if len(kept) >= keep:
            kept = np.partition(kept, keep - 1)[:keep]
            bound = min(bound, float(kept[-1]))
    places, away = np.concatenate(out), np.concatenate(away)
    return places[away <= bound + slack]


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten()).astype(float).reshape(-1, dim)


def usable(vectors: DataFrame, key: str, value: str) -> DataFrame:
    """(vec_id, v array<double>): rows with an id and a vector that is not null, not zero and has finite components alone."""
    v = vectors.select(F.col(f"`{key}`").alias("vec_id"), F.col(f"`{value}`").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """(query_id long, rank int, vec_id long, score double): for each vector whose id is divisible by `every` the k others of the largest inner product that its probed lists hold, nearest first, ties to the smaller id.

    Scores are inner products of the vectors as given, in double precision. Vectors that are null, zero or hold null or non-finite components take
    no part. Vectors have a product with those of their own length alone, so each length is a search of its own. The bound of a search comes from one
    row of BOUND_SHARE (SAMPLE rows at most), so the lists decide in tables of any size; only a query whose lists hold fewer than k others within
    it is compared with every row, so none lacks neighbours. Each row is a
    candidate for all other rows, and a query of its own if its id is, so rows that repeat an id or a vector count each. Other columns are not looked at. No row gives no row.

    Lists of more than LIST_ROWS vectors and more than QUERY_ROWS queries of a list go to several tasks in blocks.
    """
    spark = vectors.sparkSession
    clean = usable(vectors, key, value)
    found = [_nearest(clean, r.n, every, k) for r in clean.groupBy(F.size("v").alias("n")).count().orderBy("n").collect()]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _nearest(clean: DataFrame, dim: int, every: int, k: int) -> DataFrame:
    """nearest() among the usable vectors of one length."""
    spark = clean.sparkSession
    clean, clean_at = materialize(clean.where(F.size("v") == dim).withColumn("row", F.monotonically_increasing_id()), "vectors")
    total = clean.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    sample = clean.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(SAMPLE).select("v").toArrow().column("v")
    index = fit(_matrix(sample, dim), total.m, total.n, k)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = index.lists(index.lift(_matrix(batch.column(1), dim)), 1)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], names=["vec_id", "v", "row", "list"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column(1), dim)
            bound = np.full(len(q), np.inf)
            if len(index.sample) > k + 1:
                # The sample's k + 1 best bound the k best of all; the query itself may be among them.
                score = np.partition(q @ index.sample.T, -(k + 1), axis=1)[:, -(k + 1)]
                bound = np.einsum("ij,ij->i", q, q) + index.norm2 - 2 * score
            lists = index.lists(index.turn(q), index.probes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bound), pa.array(list(lists.astype(np.int32)), pa.list_(pa.int32()))], names=["query_id", "q", "asker", "bound", "lists"])

    held, held_at = materialize(clean.mapInArrow(assign, "vec_id long, v array<double>, row long, list int"), "lists")
    queries = clean.where(F.col("vec_id") % every == 0)
    probed = queries.mapInArrow(ask, "query_id long, q array<double>, asker long, bound double, lists array<int>").select("query_id", "q", "asker", "bound", F.explode("lists").alias("list"))
    asked, asked_at = materialize(probed, "probes")
    blocks = {r.list: r.n for r in held.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most 1024 lists
    asks = {r.list: r.n for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}
    table = spark.createDataFrame([(c, -(-n // LIST_ROWS), -(-asks.get(c, 0) // QUERY_ROWS)) for c, n in sorted(blocks.items())], "list int, blocks int, asks int").where("asks > 0")

    def dealt(df: DataFrame, own: str, other: str, n: str, m: str, hash_: str) -> DataFrame:
        """df's rows, each in one of n blocks, for every block of the other side."""
        with_n = df.join(F.broadcast(table), "list").withColumn(own, F.pmod(F.xxhash64(hash_), F.col(n)).cast("int"))
        return with_n.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1))).drop("blocks", "asks")

    left = dealt(held, "x", "y", "blocks", "asks", "row").groupBy("list", "x", "y")
    right = dealt(asked, "y", "x", "asks", "blocks", "asker").groupBy("list", "x", "y")

    def search(own: pa.Table, queries_: pa.Table) -> pa.Table:
        if not own.num_rows or not queries_.num_rows:
            return _rows([])
        v, q = _matrix(own.column("v"), dim), _matrix(queries_.column("q"), dim)
        turned, lifted = index.turn(q).astype(np.float32), np.asfortranarray(index.lift(v), np.float32)  # candidates only: scores are exact
        bounds = np.asarray(queries_.column("bound")) * (1 + 1e-9) + 1e-9
        return _best(own, v, queries_, q, k, lambda i: scan(turned[i], lifted, k + 1, float(bounds[i])))

    out, _ = materialize(_ranked(left.cogroup(right).applyInArrow(search, FOUND), k), "nearest")
    # A query that found fewer than k others, by the lists it did not probe or by a test that gave up a neighbour, looks at all rows, a bounded block of such queries at a time.
    counts = out.groupBy("asker").count()
    few = queries.select(F.col("row").alias("asker")).join(counts, "asker", "left").where(F.coalesce("count", F.lit(0)) < min(k, total.n - 1)).select("asker")
    if few.count():
        rest, _ = materialize(_whole_scan(clean, few, k, dim), "few")
        out = out.join(few, "asker", "left_anti").unionByName(rest)
    discard(spark, held_at, asked_at)
    return out.drop("asker")


FOUND = "asker long, query_id long, vec_id long, score double"


def _rows(parts: list[tuple]) -> pa.Table:
    """Columns of FOUND."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
    cols = zip(*parts, strict=True) if parts else [[np.empty(0)]] * 4
    return pa.table([pa.array(np.concatenate(c)).cast(t) for c, t in zip(cols, kinds, strict=True)], names=["asker", "query_id", "vec_id", "score"])


def _best(own: pa.Table, v: np.ndarray, asking: pa.Table, q: np.ndarray, k: int, candidates: Callable[[int], np.ndarray]) -> pa.Table:
    """For each query the k rows of the largest exact score among its candidates, its own row left out."""
    ids, rows = np.asarray(own.column("vec_id")), np.asarray(own.column("row"))
    out = []
    for i, (asker, qid) in enumerate(zip(asking.column("asker").to_pylist(), asking.column("query_id").to_pylist(), strict=True)):
        at = candidates(i)
        at = at[rows[at] != asker]
        score = np.einsum("ij,j->i", v[at], q[i])
        best = np.lexsort((ids[at], -score))[:k]
        out.append((np.full(len(best), asker), np.full(len(best), qid), ids[at][best], score[best]))
    return _rows(out)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("asker", "query_id", "rank", "vec_id", "score")


def _whole_scan(clean: DataFrame, few: DataFrame, k: int, dim: int) -> DataFrame:
    """Exact neighbours of the queries in `few`, from every row: queries go in blocks of at most QUERY_ROWS to each block of rows."""
    blocks = max(1, -(-clean.count() // LIST_ROWS))
    asks = max(1, -(-few.count() // QUERY_ROWS))
    left = clean.select("vec_id", "v", "row", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(asks - 1))).alias("y"))
    q = clean.join(few, clean["row"] == few["asker"]).select(F.col("vec_id").alias("query_id"), "asker", F.col("v").alias("q"), F.pmod(F.xxhash64("asker"), F.lit(asks)).alias("y"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("x"))

    def search(own: pa.Table, asking: pa.Table) -> pa.Table:
        if not own.num_rows or not asking.num_rows:
            return _rows([])
        every = np.arange(own.num_rows)
        return _best(own, _matrix(own.column("v"), dim), asking, _matrix(asking.column("q"), dim), k, lambda i: every)

    return _ranked(left.groupBy("x", "y").cogroup(q.groupBy("x", "y")).applyInArrow(search, FOUND), k)
