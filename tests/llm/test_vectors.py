"""The adaptive dimension scan against brute force."""

import numpy as np
import pytest

from graphlens.llm import vectors


def brute(ids, x, every, k):
    out = {}
    for i, q in enumerate(ids):
        if q % every == 0:
            score = x @ x[i]
            order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
            out[q] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def ran(df, **kw):
    out = {}
    for r in vectors.nearest(df, **kw).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return sum(len({v for v, _ in got.get(q, [])} & {v for v, _ in rows}) for q, rows in want.items()) / max(1, sum(map(len, want.values())))


@pytest.mark.parametrize("kind", ["unit", "lengths", "clusters", "huge"])
def test_recall_and_exact_scores(spark, kind, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24))
    if kind == "clusters":
        x += 6 * rng.normal(size=(12, 24))[rng.integers(0, 12, 1500)]
    if kind == "huge":
        x *= 1e6 * rng.random((1500, 1))
    elif kind != "lengths":
        x /= np.linalg.norm(x, axis=1)[:, None]
    ids = rng.permutation(5000)[:1500]
    monkeypatch.setattr(vectors, "LIST_ROWS", 100)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 30)
    df = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, v int")
    got, want = ran(df), brute(ids, x, 20, 20)
    assert set(got) == set(want) and all(len(r) == 20 for r in got.values())
    assert recall(got, want) >= 0.9
    at = {int(i): k for k, i in enumerate(ids)}
    for q, rows in got.items():
        assert all(abs(s - x[at[q]] @ x[at[v]]) <= 1e-9 * max(1, abs(s)) for v, s in rows)
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))


def test_driver_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding) for r in df.collect())
    want = brute(np.array([i for i, _ in rows]), np.array([v for _, v in rows], float), 20, 20)
    assert recall(ran(df), want) >= 0.9


def test_copies_tie_to_the_smaller_id(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(100)] + [(200 + i, [0.0, 1.0 + i]) for i in range(3)], "vec_id long, embedding array<double>")
    got = ran(df, k=5)
    assert [v for v, _ in got[20]] == [0, 1, 2, 3, 4] and [v for v, _ in got[0]] == [1, 2, 3, 4, 5] and [v for v, _ in got[200]] == [202, 201, 0, 1, 2]


def test_rows_that_take_no_part(spark):
    schema = "vec_id long, embedding array<float>"
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, None), (40, [0.0, 0.0]), (60, [nan, 1.0]), (80, [1.0, inf]), (100, [1.0, None]), (None, [1.0, 1.0]), (120, [1.0]), (140, []), (3, [2.0, 1.0]), (3, [2.0, 1.0]), (4, [-1.0, 0.0])]
    assert ran(spark.createDataFrame(rows, schema)) == {0: [(3, 4.0), (3, 4.0), (4, -1.0)]}
    assert ran(spark.createDataFrame([], schema)) == {} and ran(spark.createDataFrame(rows[1:4], schema)) == {} and ran(spark.createDataFrame(rows[:1], schema)) == {}


def test_scan_gives_up_no_near_candidate():
    rng = np.random.default_rng(0)
    rotation = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    x, lost, total = rng.normal(size=(3000, 64)) @ rotation, 0, 0
    for q in rng.normal(size=(30, 64)) @ rotation:
        d = ((x - q) ** 2).sum(axis=1)
        want, got = set(np.argsort(d)[:20].tolist()), vectors.scan(q, np.asfortranarray(x), 20, np.inf)
        total, lost = total + 20, lost + len(want - set(got.tolist()))
        assert len(got) < 100
    assert lost <= 0.03 * total


def test_neighbours_given_up_by_the_test_are_replaced(spark):
    # One list, all of it probed. What sets the neighbours apart lies in the first column block of the rotation, so the test overrates their distance.
    block = vectors.fit(np.eye(64), 1.0, 64, 20).rotation[:64, : vectors.COLUMNS]
    away = np.linalg.eigh(block @ block.T)[1][:, ::-1]
    q, rng = away[:, -1], np.random.default_rng(0)
    to = rng.normal(size=(29, 20)) @ away[:, :20].T
    angle = np.linspace(0.2, 0.205, 29)[:, None]
    x = np.r_[q[None, :], np.cos(angle) * q + np.sin(angle) * to / np.linalg.norm(to, axis=1)[:, None]]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got, want = ran(df, every=30), brute(np.arange(30), x, 30, 20)
    assert [v for v, _ in got[0]] == [v for v, _ in want[0]]


def test_recall_of_the_lists_beyond_the_sample(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SAMPLE", 300)
    asked = []
    whole = vectors._whole_scan
    monkeypatch.setattr(vectors, "_whole_scan", lambda clean, few, k, dim: asked.append(few.count()) or whole(clean, few, k, dim))
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding) for r in df.collect())
    got, want = ran(df), brute(np.array([i for i, _ in rows]), np.array([v for _, v in rows], float), 20, 20)
    assert set(got) == set(want) and all(len(r) == 20 for r in got.values())
    assert sum(asked) <= 0.05 * len(want) and recall(got, want) >= 0.9


def test_every_row_is_a_candidate_whatever_its_id_and_length(spark):
    rows = [(20, [1.0, 0.0]), (3, [5.0, 0.0]), (3, [9.0, 0.0]), (40, [0.0, 1.0, 1.0]), (7, [0.0, 2.0, 0.0]), (60, [2.0, 2.0]), (60, [2.0, 2.0])]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in vectors.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect())
    want = [(20, 1, 3, 9.0), (20, 2, 3, 5.0), (20, 3, 60, 2.0), (40, 1, 7, 2.0)] + 2 * [(60, 1, 3, 18.0), (60, 2, 3, 10.0), (60, 3, 60, 8.0)]
    assert got == sorted(want)


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1", "12000"])
def test_the_lists_decide_in_tables_of_any_size(spark, size, monkeypatch):
    asked, whole = [], vectors._whole_scan
    monkeypatch.setattr(vectors, "_whole_scan", lambda clean, few, k, dim: asked.append(few.count()) or whole(clean, few, k, dim))
    if size.isdigit():
        x = np.random.default_rng(1).normal(size=(int(size), 16))
        df, rows, every = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), list(enumerate(x)), 200
    else:
        df, every = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet"), 20
        rows = sorted((r.vec_id, r.embedding) for r in df.collect())
    got, want = ran(df, every=every), brute(np.array([i for i, _ in rows]), np.array([v for _, v in rows], float), every, 20)
    assert set(got) == set(want) and all(len(r) == 20 for r in got.values())
    assert sum(asked) <= 0.05 * len(want) and recall(got, want) >= 0.9
    print(size, sum(asked), len(want), round(recall(got, want), 4))
