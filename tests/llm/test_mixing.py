"""The mix against targets, blocks and permutations worked out in memory."""

from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlens.llm import mixing


def leveled(sizes, weights, share, most):
    """Targets by resharing the excess."""
    weights = [weights[i % len(weights)] for i in range(len(sizes))]
    want, stopped = share * sum(sizes), set()
    while True:
        left = want - sum(most * sizes[i] for i in stopped)
        free = sum(w for i, w in enumerate(weights) if i not in stopped)
        aim = [Fraction(most * s) if i in stopped else left * w / free for i, (s, w) in enumerate(zip(sizes, weights, strict=True))]
        over = {i for i, s in enumerate(sizes) if i not in stopped and aim[i] > most * s}
        if not over:
            return aim
        stopped |= over


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    made = [(i, " ".join(f"w{i}_{k}" for k in range(rng.integers(0, 300))), ["b", "a", "é", "Z", None, ""][min(int(rng.exponential(2)), 5)]) for i in range(150)]
    return [*made, (7, made[7][1], made[7][2]), (7, made[7][1], made[7][2]), (None, "no id here", "a"), (900, None, "a"), (901, "", "only empty"), (902, "x " * 5000, None), (903, "one", "tiny")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, source string, size int, row int, start int").repartition(3)


def test_rows_targets_and_limits(docs, rows):
    got = mixing.mixed_rows(docs, block=16, shard=20).collect()
    assert len(got) == len(rows) and Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    own = defaultdict(int)
    for _, text, source in rows:
        own[source] += len((text or "").split())
    names = sorted(own, key=lambda s: (s is None, (s or "").encode()))
    aims = dict(zip(names, leveled([own[s] for s in names], [3, 1, 2], Fraction(3, 2), 2), strict=True))
    by_doc = {r[0]: (len((r[1] or "").split()), r[2]) for r in rows}
    taken = Counter()
    for r in got:
        size, source = by_doc[r.doc_id]
        assert (r.size, r.source_size) == (size, own[source]) and r.target == pytest.approx(float(aims[source]), rel=1e-12)
        assert 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
    assert {s: taken[s] for s in names} == {s: int(aims[s]) for s in names}


def test_reruns_agree(spark, docs):
    one = sorted(tuple(r) for r in mixing.mixed_rows(docs).collect() if r.doc_id is not None)
    two = sorted(tuple(r) for r in mixing.mixed_rows(docs.repartition(11)).collect() if r.doc_id is not None)
    assert one == two
    other = sorted(tuple(r) for r in mixing.mixed_rows(docs, seed=9, block=8).collect() if r.doc_id is not None)
    assert [r[:4] for r in one] == [r[:4] for r in other] and one != other


def test_slots_are_whole_blocks_of_each_pass(docs):
    rows, sources, taken = mixing.mixture(docs, block=16, shard=20)
    each = [r.asDict() for r in taken.collect()]
    size = {r.source_no: r.source_size for r in sources.collect()}
    slots, words = {}, defaultdict(list)
    for r in each:
        assert slots.setdefault((r["shard"], r["position"]), (r["source_no"], r["pass"], r["block"])) == (r["source_no"], r["pass"], r["block"])
        words[r["shard"], r["position"]].append((r["at"], r["n"]))
    assert len(set(slots.values())) == len(slots)  # no block twice in a pass
    short = Counter()
    for k, (s, _, b) in slots.items():
        spans = sorted(words[k])
        assert spans[0][0] == 0 and all(a + n == c for (a, n), (c, _) in zip(spans, spans[1:], strict=False))  # gapless from 0
        short[s] += sum(n for _, n in spans) != min(16, size[s] - 16 * b)
    assert max(short.values()) <= 1  # one cut block in a source at most
    per = Counter(k[0] for k in slots)
    assert max(per.values()) <= 20 and sum(n < 20 for n in per.values()) <= 1 + max(per) // (mixing.URN + 2)


def test_permutations():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        x = np.arange(n)
        for key in (0, 1, 2**63):
            p = mixing.permuted(x, n, np.uint64(key)).astype(np.int64)
            assert sorted(p.tolist()) == x.tolist() and (mixing.permuted(p, n, np.uint64(key), back=True) == x.astype(np.uint64)).all()
    assert (mixing.permuted(np.arange(1000), 1000, np.uint64(1)) != mixing.permuted(np.arange(1000), 1000, np.uint64(2))).mean() > 0.9


def test_every_size_of_a_cut_pass():
    for size in range(1, 40):
        for take in range(0, 2 * size + 1):
            urns = mixing.Urns([size, 50], [take, 17], block=8, shard=4, seed=3)
            got = [urns.draw(u) for u in range(urns.urns)]
            own = np.concatenate([g["n_words"][g["source_no"] == 0] for g in got])
            uses = Counter(np.concatenate([g["block"][g["source_no"] == 0] for g in got]).tolist())
            assert own.sum() == take and (own > 0).all() and max(uses.values(), default=0) <= 2, (size, take)


def test_empty_tables(spark, docs):
    assert mixing.mixed_rows(docs.limit(0)).count() == 0
    got = mixing.mixed_rows(docs.where("text is null or text = ''")).collect()
    assert got and all((r.size, r.source_size, r.target, r.taken) == (0, 0, 0.0, 0) for r in got)


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 5)
    with pytest.raises(ValueError):
        mixing.mixed_rows(spark.range(6).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.col("id").cast("string").alias("source")))
