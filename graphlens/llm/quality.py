"""Document quality by a sparse ensemble of rules over text statistics, compiled into Spark column expressions."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add, and_, eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlens.llm.common import bounded, slices, texts

#: Statistics of a text, in the order in which `statistics` gives them.
STATS = (
    "word_length", "upper", "symbols", "symbol_words", "digits", "bars", "marks", "stops", "different", "echoes", "top_word",
    "line_words", "same_lines", "different_bigrams", "spaces",
)
#: Words among which different ones are counted, so that a text's length tells nothing about its quality.
SPAN = 128
#: Most labelled rows that a fit takes, by the hash of their ids; the fit's only bound, so that its rows fit on the driver.
SAMPLE = 20_000
#: Shape of the forest that gives the rules, and the lasso's penalty for each row.
TREES, DEPTH, BINS, RATE, PENALTY = 50, 3, 32, 0.3, 3e-5

_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~"
_KEPT = {name: bytes(b for b in range(256) if b not in chars) for name, chars in (("upper", _UPPER), ("digits", _DIGITS), ("symbols", _SYMBOLS), ("marks", b"!?"), ("stops", b".,;:"), ("spaces", b" \t\n\r\x0b\x0c"))}
_WORD_END = b"#$%&*+/<=>@[\\]^_`{|}~!?"


def statistics(text: bytes) -> tuple[float, ...]:
    """STATS of one whole UTF-8 text; all are 0 for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATS)
    size = len(text)
    held = {name: len(text.translate(None, gone)) for name, gone in _KEPT.items()}
    solid = max(1, size - held["spaces"])
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    spans = [words[i : i + SPAN] for i in range(0, n, SPAN)]
    different = sum(len(set(x)) for x in spans)
    pairs = sum(len(set(zip(x, x[1:], strict=False))) for x in spans)
    return (
        solid / n, held["upper"] / solid, held["symbols"] / solid, sum(w[-1] in _WORD_END for w in words) / n, held["digits"] / solid,
        text.count(b"|") / n, held["marks"] / n, held["stops"] / n, different / n, sum(map(eq, words, words[1:])) / n, max(counts.values()) / n,
        math.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), pairs / max(1, n - len(spans)), held["spaces"] / size,
    )


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, STATS double): a row for each row of docs, over its whole text (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in slices(batches):
            cols = np.array([statistics(x) for x in found], float).reshape(-1, len(STATS)).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols)], names=["doc_id", *STATS])

    plain = texts(docs)
    return plain.mapInArrow(run, ", ".join([f"doc_id {plain.schema['doc_id'].dataType.simpleString()}", *(f"{c} double" for c in STATS)]))


def with_statistics(docs: DataFrame, use: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """use(docs with STATS beside their columns), then the columns of docs alone. Columns of docs are renamed meanwhile, so their names may be anything."""
    names = docs.columns
    plain = bounded(docs).toDF(*(f"__{k}" for k in range(len(names))))
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in slices(batches, f"__{at}"):
            cols = np.array([statistics(x) for x in found], float).reshape(-1, len(STATS)).T
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, cols)], names=[*batch.schema.names, *STATS])

    schema = T.StructType([*plain.schema.fields, *(T.StructField(c, T.DoubleType()) for c in STATS)])
    return use(plain.mapInArrow(run, schema)).select(*plain.columns).toDF(*names)


def held_out() -> Column:
    """Rows that no fit sees: crc32 of the doc_id as text is a multiple of 5. False for rows without doc_id, which have no label."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


#: A rule: conditions (statistic, above or not, threshold), all of which hold.
Rule = tuple[tuple[int, bool, float], ...]


def _grow(x: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: Rule, found: dict[Rule, None], f: np.ndarray) -> None:
    """One regression tree by Newton gains over binned statistics; adds each node's path to found and its step to f."""
    gain, best, own_g, own_h = 1e-3, None, g[rows].sum(), h[rows].sum()
    if depth:
        for c in range(x.shape[1]):
            left_g = np.cumsum(np.bincount(x[rows, c], g[rows], BINS))[:-1]
            left_h = np.cumsum(np.bincount(x[rows, c], h[rows], BINS))[:-1]
            gains = left_g**2 / (left_h + 1) + (own_g - left_g) ** 2 / (own_h - left_h + 1) - own_g**2 / (own_h + 1)
            gains[(left_h < 1) | (own_h - left_h < 1)] = 0
            k = int(gains.argmax())
            if gains[k] > gain and k < len(edges[c]):
                gain, best = gains[k], (c, k)
    if best is None:
        f[rows] += RATE * own_g / (own_h + 1)
        return
    c, k = best
    above = x[rows, c] > k
    for side in (False, True):
        rule = tuple(sorted({(s, a): t for s, a, t in (*path, (c, side, float(edges[c][k])))}.items()))
        rule = tuple((s, a, t) for (s, a), t in rule)
        found[rule] = None
        _grow(x, edges, g, h, rows[above == side], depth - 1, rule, found, f)


def _holds(rule: Rule, stats: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(stats[:, s] > t) == a for s, a, t in rule])


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights with an L1 penalty by accelerated proximal steps; the intercept is free."""
    n, m = r.shape
    design = np.c_[np.ones(n), r]
    v = np.ones(m + 1)
    for _ in range(30):
        v = design.T @ (design @ v)
        v /= np.linalg.norm(v)
    step = 4 / max(1e-9, np.linalg.norm(design @ v) ** 2 / n) * 0.98
    w = z = np.zeros(m + 1)
    t = 1.0
    for _ in range(steps):
        grad = design.T @ (1 / (1 + np.exp(-(design @ z))) - y) / n
        new = z - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return float(w[0]), w[1:]


class RuleEnsemble:
    """score = 1 / (1 + exp(-(intercept + sum of the weights of the rules that hold)))."""

    def __init__(self, intercept: float, rules: list[tuple[Rule, float]]):
        self.intercept, self.rules = intercept, rules

    @classmethod
    def fit(cls, stats: np.ndarray, y: np.ndarray) -> RuleEnsemble:
        """Boosted shallow trees over the statistics give their paths as rules; a lasso keeps few. One class alone gives a constant score near it, no row 0.5."""
        if not len(y):
            return cls(0.0, [])
        if y.min() == y.max():
            return cls(4.0 if y[0] else -4.0, [])
        edges = [np.unique(np.quantile(stats[:, c], np.linspace(0, 1, BINS + 1)[1:-1])) for c in range(stats.shape[1])]
        x = np.stack([np.searchsorted(e, stats[:, c], side="left") for c, e in enumerate(edges)], axis=1)
        f, found = np.full(len(y), math.log(y.mean() / (1 - y.mean()))), {}
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            _grow(x, edges, y - p, p * (1 - p), np.arange(len(y)), DEPTH, (), found, f)
        rules, seen = [], set()
        for rule in found:
            key = (hold := _holds(rule, stats)).tobytes()
            if key not in seen and 0 < hold.sum() < len(y):
                seen.add(key)
                rules.append(rule)
        r = np.stack([_holds(rule, stats) for rule in rules], axis=1).astype(float)
        b, w = _lasso(r, y, PENALTY)
        return cls(b, [(rule, float(x)) for rule, x in zip(rules, w, strict=True) if x])

    def numpy(self, stats: np.ndarray) -> np.ndarray:
        total = np.full(len(stats), self.intercept)
        for rule, w in self.rules:
            total += w * _holds(rule, stats)
        return 1 / (1 + np.exp(-total))

    def column(self) -> Column:
        """The score as an expression over the statistics' columns. Weights are folded over an array, in the rules' order: in a chain of additions Spark's planning holds the code of each below the next, so the driver's memory grew with the square of the rules."""
        total, steps = F.lit(self.intercept), []
        for rule, w in self.rules:
            holds = reduce(and_, (F.col(STATS[s]) > t if above else F.col(STATS[s]) <= t for s, above, t in rule))
            steps.append(F.when(holds, w).otherwise(0.0))
        if steps:
            total = F.aggregate(F.array(*steps), total, add)
        return 1 / (1 + F.exp(-total))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleEnsemble:
    """Fit on at most `sample` labelled rows of docs that are not held out, those with the least hashed ids. Null labels and ids count for nothing; repeated labels of one document are one, the majority (a tie: 1)."""
    one = labels.where("quality is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.avg("quality").alias("y"))
    taken = one.select("doc_id", (F.col("y") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most `sample` ids are broadcast, whatever the corpus, so no text is shuffled.
    known = texts(docs).join(F.broadcast(taken.select("doc_id")), "doc_id", "left_semi")
    rows = described(known).join(taken, "doc_id").orderBy("doc_id", *STATS).limit(sample).select("y", *STATS).toPandas()
    return RuleEnsemble.fit(rows[list(STATS)].to_numpy(float), rows["y"].to_numpy(float))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out boolean, score double, predicted int), a row for each row of docs over its whole text.

    The score sees statistics of the text alone: no label, language, source or id. Null and empty texts have statistics of 0 and a score like any
    other; repeated rows repeat; no row gives no row; without labels every score is 0.5. Other columns of docs are not looked at.
    """
    model = fit_quality(docs, labels, sample)
    scored = described(docs).select("doc_id", held_out().alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
