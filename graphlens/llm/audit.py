"""How filters interact: what each order of them keeps, and each filter's Shapley share of what is removed, from counts of failure masks alone."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import materialize

_WORD = r"[^\x20\x09-\x0D]+"
#: The name of the condition that looks at the whole table, not at a row.
COPY = "E"


def row_conditions() -> dict[str, Column]:
    """Failure conditions of single rows, over the columns text, words and distinct: under 50 words; under 65 % distinct words; over 5 % capitals; any of # $ % & * |."""
    return {
        "A": F.col("words") < 50,
        "B": F.col("distinct") * 100 < F.col("words") * 65,
        "C": F.regexp_count("text", F.lit("[A-Z]")).cast("long") * 100 > F.length("text").cast("long") * 5,
        "D": F.col("text").rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask int), a row for each row of docs: bit i of mask says that condition i fails, in the order of row_conditions() and then COPY.

    COPY: another row with a smaller doc_id has the identical text, wherever in the table. Null texts count as empty, null sources are the part ''.
    A row without doc_id has no smaller one and is smaller than none; repeated rows of one doc_id don't fail because of each other. Words are
    compared case-sensitively; bytes that are no UTF-8 count as replacement characters in words.
    """
    plain = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    words = plain.withColumn("list", F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)))
    counted = words.select("doc_id", "part", "text", F.size("list").cast("long").alias("words"), F.size(F.array_distinct("list")).cast("long").alias("distinct"))
    bits = [F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(row_conditions().values())]
    facts, _ = materialize(counted.select("doc_id", "part", sum(bits[1:], bits[0]).alias("own"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest")), "failures")
    # One row for each text that several documents have; written, so that the join can split the rows of a text with very many copies.
    copied, _ = materialize(facts.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("digest", "least"), "copied")
    copy = F.when(F.col("doc_id") > F.col("least"), 1 << len(bits)).otherwise(0)
    return facts.join(copied, "digest", "left").select("doc_id", "part", (F.col("own") + copy).alias("mask"))


def mask_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows, those labelled quality 1 and toxic 1. Of several label rows of a doc_id any counts; rows without label count for neither."""
    marks = labels.groupBy("doc_id").agg(*[F.coalesce(F.max(F.when(F.col(c) == 1, 1)), F.lit(0)).alias(c) for c in ("quality", "toxic")])
    beside = failed.join(marks, "doc_id", "left")
    return beside.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))])


def removal_polynomial(counts: dict[int, int], k: int) -> list[int]:
    """Coefficients, by bit set of variables, of the multilinear polynomial of k variables that gives how many rows filters remove: the sum over masks of count * (1 - product of (1 - x_i) over the mask's bits)."""
    over = [counts.get(m, 0) for m in range(1 << k)]
    for i in range(k):
        for m in range(1 << k):
            if not m >> i & 1:
                over[m] += over[m | 1 << i]
    return [0] + [n if m.bit_count() % 2 else -n for m, n in enumerate(over) if m]


def corners(poly: list[int], k: int) -> list[int]:
    """The polynomial's value at each corner of the cube: what the filters of each bit set remove together."""
    value = list(poly)
    for i in range(k):
        for m in range(1 << k):
            if m >> i & 1:
                value[m] += value[m ^ 1 << i]
    return value


def shapley(poly: list[int], k: int) -> list[int]:
    """k! times each variable's Shapley value: the integral along the diagonal of the polynomial's partial derivative. A term c * t^(size - 1) gives c / size; all exact rationals."""
    shares = (sum((Fraction(c, m.bit_count()) for m, c in enumerate(poly) if m >> i & 1), Fraction(0)) * factorial(k) for i in range(k))
    return [int(x) for x in shares]


_COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def orders_of(names: str, masks: list[dict]) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each order of the filters `names`, from one part's mask counts."""
    k = len(names)
    polys = [removal_polynomial({m["mask"]: m[c] for m in masks}, k) for c in ("n", "good", "toxic")]
    gone, good, toxic = (corners(p, k) for p in polys)
    share, rows, full = shapley(polys[0], k), sum(m["n"] for m in masks), (1 << k) - 1
    for order in permutations(range(k)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = gone[after] - gone[before]
            yield "".join(names[j] for j in order), step, rows - gone[after], removed, gone[1 << i] - removed, gone[full] - gone[full ^ 1 << i], good[after] - good[before], toxic[after] - toxic[before], share[i]
            before = after


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step int, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: long), a row for each part, order of the five filters and step.

    Each part is at most 32 rows of mask counts, whatever its size; these become its removal polynomials (of all rows, of good ones, of toxic
    ones). Corner values give what every set of filters removes, and so every order's steps; shapley is 120 times the integrated partial
    derivative. Rows are dealt to parts only as counts, so a part with a third of all rows costs as much as another. Parts are the sources
    (null: ''); a table without rows has no part and gives no row. Extra columns are not looked at. See failures() for odd rows.
    """
    names = "".join(row_conditions()) + COPY
    gathered = mask_counts(failures(docs), labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, masks in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                cols = list(zip(*orders_of(names, masks), strict=True))
                kinds = [pa.string(), pa.int32(), *[pa.int64()] * len(_COLUMNS)]
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * len(cols[0]), pa.string()), *map(pa.array, cols, kinds)], names=["part", "filter_order", "step", *_COLUMNS])

    return gathered.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COLUMNS))
