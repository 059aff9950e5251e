"""The rule ensemble: held-out accuracy, the compiled column against numpy, and edge rows."""

import math
import re
import zlib

import numpy as np
import pytest

from graphlens.llm import quality

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    return docs, labels, quality.score_quality(docs, labels).toPandas().set_index("doc_id")


def test_held_out_accuracy(scored):
    docs, labels, got = scored
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in got.held_out.items())
    own = labels.toPandas().set_index("doc_id").join(got)
    own = own[own.held_out]
    assert (own.predicted == own.quality).mean() > 0.95 and len(own) > 40
    good, bad = own[own.quality == 1].score.to_numpy(), own[own.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.98


def test_labels_of_held_out_rows_do_not_matter(spark, scored):
    docs, labels, got = scored
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out(), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    again = quality.score_quality(docs, flipped).toPandas().set_index("doc_id")
    assert np.array_equal(again.score.loc[got.index], got.score)


def test_column_is_the_ensemble(spark):
    rng = np.random.default_rng(0)
    x = rng.random((300, len(quality.STATS)))
    y = ((x[:, 3] > 0.5) & (x[:, 7] <= 0.6)).astype(float)
    model = quality.RuleEnsemble.fit(x, y)
    assert 0 < len(model.rules) < 150 and ((model.numpy(x) >= 0.5) == y).mean() > 0.97
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], list(quality.STATS)).select(model.column().alias("s"))
    assert np.allclose([r.s for r in df.collect()], model.numpy(x))


def random_rules(rng, n):
    at = [rng.choice(len(quality.STATS), 3, replace=False) for _ in range(n)]
    return [(tuple((int(s), bool(rng.integers(2)), float(rng.random())) for s in own), float(rng.normal())) for own in at]


def test_most_rules_of_a_fit_can_be_planned(spark):
    """Noisy labels give hundreds of rules; an expression nested by rule overflowed the driver's stack or heap."""
    rng = np.random.default_rng(1)
    x = rng.random((20, len(quality.STATS)))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], list(quality.STATS))

    def depth(model):
        tree = df.select(model.column())._jdf.queryExecution().analyzed().expressions().head().treeString()
        return max(len(line) - len(line.lstrip(" :+-")) for line in tree.split("\n"))

    few, most = (quality.RuleEnsemble(0.1, random_rules(rng, n)) for n in (5, quality.TREES * (2 ** (quality.DEPTH + 1) - 2)))
    assert len(most.rules) == 700 and depth(few) == depth(most)
    got = [r.s for r in df.select(most.column().alias("s")).where("s >= 0 or s is null").collect()]
    assert len(got) == 20 and np.allclose(got, most.numpy(x), rtol=1e-12)
    assert {r.s for r in df.select(quality.RuleEnsemble(0.0, []).column().alias("s")).collect()} == {0.5}


def test_statistics_of_texts_without_words():
    assert set(quality.statistics(b"")) == set(quality.statistics(b" \n\t")) == {0.0}
    assert dict(zip(quality.STATS, quality.statistics(b"a a A# 1")))["echoes"] == 0.25


def test_edge_rows(spark):
    schema, of = "doc_id long, text string, y int, upper double", "doc_id long, quality int, toxic int"
    none = spark.createDataFrame([], of)
    assert quality.score_quality(spark.createDataFrame([], schema), none).count() == 0
    docs = spark.createDataFrame([(i, None if i % 3 == 0 else "x " * i, 1, 1.0) for i in range(30)] + [(7, "x " * 7, 1, 1.0), (None, "z" * 100_000, 2, 2.0)], schema)
    rows = quality.score_quality(docs, none).collect()
    assert len(rows) == 32 and {r.score for r in rows} == {0.5} and {r.predicted for r in rows} == {1}
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(30)] + [(1, None, 0), (None, 1, 0), (2, 0, 0)], of)
    assert all(0 <= r.score <= 1 for r in quality.score_quality(docs, labels).collect())
    one = spark.createDataFrame([(i, 0, 0) for i in range(30)], of)
    assert {r.predicted for r in quality.score_quality(docs, one).collect()} == {0}


def slow_statistics(text):
    """STATS by one look at each byte and word."""
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", text) if w]
    if not words:
        return dict.fromkeys(quality.STATS, 0.0)
    n, solid = len(words), sum(b not in b" \t\n\r\x0b\x0c" for b in text)
    share = lambda chars: sum(b in chars for b in text)
    spans = [words[k : k + 128] for k in range(0, n, 128)]
    lines = [x for x in text.split(b"\n") if x.split()]
    symbols = b"#$%&*+/<=>@[\\]^_`{|}~"
    out = {
        "word_length": solid / n, "upper": share(bytes(range(65, 91))) / solid, "symbols": share(symbols) / solid, "symbol_words": sum(w[-1] in symbols + b"!?" for w in words) / n,
        "digits": share(b"0123456789") / solid, "bars": share(b"|") / n, "marks": share(b"!?") / n, "stops": share(b".,;:") / n,
        "different": sum(len({*s}) for s in spans) / n, "echoes": sum(words[k] == words[k + 1] for k in range(n - 1)) / n, "top_word": max(words.count(w) for w in set(words)) / n,
        "line_words": math.log(1 + n / len(lines)), "same_lines": (len(lines) - len({*lines})) / len(lines),
        "different_bigrams": sum(len({(s[k], s[k + 1]) for k in range(len(s) - 1)}) for s in spans) / max(1, sum(len(s) - 1 for s in spans)), "spaces": (len(text) - solid) / len(text),
    }
    return {k: out[k] for k in quality.STATS}


def test_whole_query_against_brute_force(spark, scored):
    docs, labels, got = scored
    model = quality.fit_quality(docs, labels)
    for r in docs.collect():
        own = slow_statistics((r.text or "").encode())
        total = model.intercept
        for rule, weight in model.rules:
            if all((own[quality.STATS[s]] > t) is above for s, above, t in rule):
                total += weight
        want, row = 1 / (1 + math.exp(-total)), got.loc[r.doc_id]
        assert abs(row.score - want) < 1e-9 and row.predicted == (want >= 0.3)
