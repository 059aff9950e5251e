"""Sweeps over spans against all pairs."""

import random
import time

from graphlens.operators import spans, symbols


def made(n, seed, wide=40):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 2, None]), s := rng.randrange(200), s + rng.randrange(wide), i) for i in range(n)]
    return [*rows, (1, None, 5, n), (2, 5, None, n + 1), (3, 0, 10**12, n + 2), (3, 7, 7, n + 3)]


def earlier(rows, r):
    return [p for p in rows if None not in (*p[:3], *r[:3]) and p[0] == r[0] and p[1] < r[1]]


def test_against_all_pairs(spark):
    for seed in range(3):
        rows = made(300, seed)
        df = spark.createDataFrame(rows, "k int, s long, e long, id int").repartition(5)
        want = [(*r, min(((p[2] - p[1], -p[1]) for p in earlier(rows, r) if p[2] >= r[2]), default=(0, None))[1]) for r in rows]
        got = [tuple(r) for r in spans.smallest_container(df, "k", "s", "e").collect()]
        assert sorted(got, key=str) == sorted([(*r[:4], None if r[4] is None else -r[4]) for r in want], key=str)
        pairs = sorted((*r, p[1], p[2]) for r in rows for p in earlier(rows, r) if r[1] <= p[2] < r[2])
        assert sorted(tuple(r) for r in spans.partial_overlaps(df, "k", "s", "e").collect()) == pairs and pairs


def test_no_rows_and_no_join(spark):
    df = spark.createDataFrame(made(5, 1), "k int, s long, e long, id int")
    for op in (spans.smallest_container, spans.partial_overlaps):
        assert op(df.limit(0), "k", "s", "e").count() == 0
        assert "Join" not in op(df, "k", "s", "e")._jdf.queryExecution().toString()


def test_steps_taken_back():
    rng = random.Random(3)
    sweep, done, start = spans.Sweep(logged=True), [], 0
    state = lambda: (list(sweep.ends), list(sweep.front), list(sweep.front_ends))
    for _ in range(3000):
        if done and rng.random() < 0.4:
            sweep.back()
            start, before = done.pop()
            assert state() == before
        else:
            done.append((start, state()))
            start += rng.randrange(4)
            sweep.step(start, start + rng.randrange(30))


def symbol(i, ts, scip):
    return {"qualified_name": f"q{i}", "name": f"q{i}", "kind": "function", "path": "p", "ord": i, "name_line": ts[0], "name_col": 0, "scip_symbol": f"s{i}" if scip else None, "ts_start": ts[0], "ts_end": ts[1], "scip_start": scip and scip[0], "scip_end": scip and scip[1], "source": "both" if scip else "treesitter"}


def restarted(rows):
    """The same rule, from the beginning after each symbol that gives way."""
    for r in rows:
        r["use"] = r["scip_start"] is not None
    while True:
        for r in rows:
            r["start"], r["end"] = (r["scip_start"], r["scip_end"]) if r["use"] else (r["ts_start"], max(r["ts_end"], r["ts_start"]))
        rows.sort(key=lambda r: (r["start"], -r["end"], r["name_line"], r["name_col"], r["scip_symbol"] or "", r["qualified_name"]))
        for k, r in enumerate(rows):
            above = [p for p in rows[:k] if p["end"] >= r["end"]]
            r["parent"] = min(enumerate(above), key=lambda x: (x[1]["end"] - x[1]["start"], -x[0]))[1] if above else None
            r["conflict"] = any(r["start"] <= p["end"] < r["end"] for p in rows[:k])
        flip = next((r for r in rows if r["conflict"] and r["use"]), None)
        if flip is None:
            return rows
        flip["use"] = False


def test_nesting_is_that_of_starting_anew():
    gives_way = 0
    for seed in range(60):
        rng = random.Random(seed)
        rows = []
        for i in range(rng.randrange(1, 30)):
            a = rng.randrange(60)
            scip = (b := max(0, a + rng.randrange(-9, 9)), b + rng.randrange(20)) if rng.random() < 0.7 else None
            rows.append(symbol(i, (a, a + rng.randrange(15)), scip))
        show = lambda out: [(r["qualified_name"], r["start"], r["end"], r["conflict"], r["use"], r["parent"] and r["parent"]["qualified_name"]) for r in out]
        want = show(restarted([dict(r) for r in rows]))
        got = symbols.nest([dict(r) for r in rows])
        assert show(got) == want
        gives_way += sum(not r["use"] and r["scip_start"] is not None for r in got)
    assert gives_way > 50


def test_many_symbols_of_one_file():
    rng = random.Random(0)
    rows = [symbol(i, (3 * i, 3 * i + 1), (3 * i - rng.randrange(3), 3 * i + rng.randrange(9))) for i in range(1, 20_000)]
    at = time.time()
    out = symbols.nest(rows)
    assert time.time() - at < 5 and len(out) == 19_999 and sum(not r["use"] for r in out) > 1000
