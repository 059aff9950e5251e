"""Nearest items in blocks against every pair."""

import numpy as np
import pytest

from graphlens.operators import knn


def slow(items, queries, k):
    out = []
    for qid, q in queries:
        fine = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        found = sorted((round(1 - round(float(np.dot(v, q) / np.sqrt(np.dot(v, v) * np.dot(q, q))), 5), 5), i) for i, v in items if fine(v) and fine(q) and len(v) == len(q))
        out += [(qid, i, d, n) for n, (d, i) in enumerate(found[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("few", [0, 4096])
def test_against_every_pair(spark, monkeypatch, few):
    monkeypatch.setattr(knn, "FEW", few)
    monkeypatch.setattr(knn, "QUERIES", 7)
    monkeypatch.setattr(knn, "ITEMS", 30)
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(200, 6)).round(3).tolist()
    items = [(i, v) for i, v in enumerate(vectors)] + [(200 + i, vectors[i]) for i in range(20)] + [(300, None), (301, [0.0] * 6), (302, [1.0, 2.0]), (303, [float("nan")] * 6), (304, [1.0, None]), (305, [2.0, 4.0])]
    queries = [(f"q{i}", vectors[3 * i]) for i in range(40)] + [("short", [1.0, 2.0]), ("none", None), ("zero", [0.0] * 6), ("other", [1.0])]
    a, b = spark.createDataFrame(items, "id long, embedding array<double>").repartition(3), spark.createDataFrame(queries, "query_id string, query array<double>")
    found = knn.nearest(a, b, 5)
    got = sorted((r.query_id, r.id, r.distance, r.rank) for r in found.collect())
    assert got == slow(items, queries, 5) and len(got) == 202
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    assert knn.nearest(a.limit(0), b, 5).count() == 0 and knn.nearest(a, b.limit(0), 5).count() == 0
