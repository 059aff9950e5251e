"""Near-duplicates by shingle similarity against a brute-force version."""

import random
import re

import numpy as np
import pytest

from graphlens.llm import similar


def slow_set(text, width=5):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def slow_components(rows, similarity=0.8):
    """For (doc_id, text) rows, the smallest doc_id that each reaches."""
    sets = [slow_set(x) for _, x in rows]
    comp = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if comp[i] != comp[j] and (a == b or len(a & b) >= similarity * len(a | b) - 1e-9):
                old = comp[i]
                comp = [comp[j] if c == old else c for c in comp]
    least = {}
    for (d, _), c in zip(rows, comp):
        least[c] = min(d, least.get(c, d))
    return [least[c] for c in comp]


def make_rows(n=40, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}é" for i in range(300)]
    common = [" ".join(rng.choices(vocab, k=30)) for _ in range(3)]
    out = ["", None, " \n", "One", "one", "a b c", "A  B\nc", "a b c d", "x y z u v w", "x y z u v w"]
    for _ in range(n):
        words = rng.choices(vocab, k=rng.choice([6, 12, 45, 200, 900]))
        out.append(" ".join(words) if rng.random() < 0.6 else f"{rng.choice(common)} {' '.join(words)}")
        for _ in range(rng.choice([0, 1, 5])):
            near = list(words)
            for _ in range(rng.randint(1, max(1, len(words) // 50))):
                near[rng.randrange(len(near))] = rng.choice(vocab)
            words = rng.choice([words, near])
            out.append(" ".join(near))
    rng.shuffle(out)
    return [(i, x) for i, x in zip(rng.sample(range(10_000), len(out)), out)]


@pytest.mark.parametrize("shard, cluster_bytes", [(20_000, 32 << 20), (4, 2000)])
def test_against_brute_force(spark, shard, cluster_bytes):
    rows = make_rows()
    docs = spark.createDataFrame([(d, x, 1, "k") for d, x in rows], "doc_id long, text string, size int, key string")
    got = {r.doc_id: r.component_id for r in similar.similar_documents(docs, shard=shard, cluster_bytes=cluster_bytes).collect()}
    assert got == dict(zip([d for d, _ in rows], slow_components(rows)))
    assert len(set(got.values())) < len(got) - 20


def test_driver_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.component_id for r in similar.similar_documents(docs).collect()}
    assert got == dict(zip([d for d, _ in rows], slow_components(rows)))


def test_odd_rows(spark):
    schema = "doc_id long, text string"
    assert similar.similar_documents(spark.createDataFrame([], schema)).count() == 0
    far = " ".join(f"f{i}" for i in range(50))
    rows = [(4, "x y"), (4, "x y"), (None, "x y"), (4, far), (2, "X y"), (9, None), (8, "")]
    got = sorted((r.doc_id, r.component_id) for r in similar.similar_documents(spark.createDataFrame(rows, schema)).collect())
    assert got == [(2, 2), (4, 2), (4, 2), (4, 4), (8, 8), (9, 8)]


def test_prefixes_hold_a_common_shingle():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n, cut = int(rng.integers(1, 60)), 0
        a = rng.choice(10_000, n, replace=False)
        cut = int(rng.integers(0, n // 5 + 1))
        b = np.r_[a[cut:], 20_000 + np.arange(int(rng.integers(0, n // 5 + 1)))]
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            firsts = [set(np.sort(x)[: similar.prefix_size(np.array([len(x)]), 0.8)[0]].tolist()) for x in (a, b)]
            assert firsts[0] & firsts[1]


def test_fingerprints_of_similar_sets_lie_within_the_radius():
    rng = np.random.default_rng(1)
    for n in (9, 18, 45, 90, 450):
        for _ in range(400):
            h = rng.integers(0, 1 << 63, n + n // 9, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n + n // 9, dtype=np.uint64)
            a, b = h[:n], h[n // 9 :]
            away = similar.set_fingerprint(a) ^ similar.set_fingerprint(b)
            assert away.bit_count() <= similar.RADIUS and (away >> 64).bit_count() <= similar.HALF


def template(n, own, shared, seed=0):
    """n sets of `shared` shingles of a template and `own` ones of their own."""
    rng = np.random.default_rng(seed)
    common = rng.integers(0, 1 << 62, shared, dtype=np.uint64)
    return [np.unique(np.r_[common, rng.integers(0, 1 << 62, own, dtype=np.uint64)]) for _ in range(n)]


@pytest.mark.parametrize("own, shared", [(60, 140), (36, 164)])
def test_a_template_without_similar_sets(own, shared):
    import time

    sets, at = template(20_000, own, shared), time.time()
    yes = np.ones(len(sets), bool)
    assert similar._verified(np.arange(len(sets)), sets, yes, yes, 0.8) == [] and time.time() - at < 30


def test_a_template_of_copies():
    import time

    sets, at = template(20_000, 10, 190), time.time()
    yes = np.ones(len(sets), bool)
    assert len(similar._verified(np.arange(len(sets)), sets, yes, yes, 0.8)) == 19_999 and time.time() - at < 30


@pytest.mark.parametrize("seed", range(6))
def test_links_of_shards_against_all_pairs(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(25):
        base = rng.integers(0, 400, rng.integers(1, 60), dtype=np.uint64)
        for _ in range(rng.integers(1, 7)):
            keep = base[rng.random(len(base)) > rng.choice([0.02, 0.1, 0.2])]
            made = np.unique(np.r_[keep, rng.integers(0, 400, rng.integers(0, 6), dtype=np.uint64)])
            if len(made):
                sets.append(made)
    near = rng.random(len(sets)) < 0.5 if seed % 2 else np.ones(len(sets), bool)
    asks = ~near if seed % 2 else near

    def components(pairs):
        comp = list(range(len(sets)))
        for i, j in pairs:
            old = comp[i]
            comp = [comp[j] if c == old else c for c in comp]
        return {frozenset(k for k, c in enumerate(comp) if c == x) for x in comp}

    good = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9
    every = [(i, j) for i in range(len(sets)) for j in range(i) if (near[i] and asks[j] or near[j] and asks[i]) and good(sets[i], sets[j])]
    links = similar._verified(np.arange(len(sets)), sets, near, asks, 0.8)
    assert all(good(sets[a], sets[b]) for a, b in links) and components(links) == components(every) and len(every) > 4
