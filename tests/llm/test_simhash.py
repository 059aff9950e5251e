"""SimHash near-duplicates against a brute-force version."""

import random
import re

import numpy as np
import pytest
import xxhash

from graphlens.llm import simhash
from graphlens.llm.components import connected_components


def slow_fingerprint(text, width=4):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def slow_components(ids, fps, radius=4):
    comp = {i: i for i in range(len(ids))}
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and comp[i] != comp[j]:
                old = comp[i]
                comp = {k: comp[j] if v == old else v for k, v in comp.items()}
    return [min(d for k, d in enumerate(ids) if comp[k] == comp[i]) for i in range(len(ids))]


def make_texts(n=60, seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}é" for i in range(400)]
    out = ["", None, " \n\t", "One", "one", "a b c", "A  B\nc"]
    for _ in range(n):
        words = rng.choices(vocab, k=rng.choice([5, 40, 300]))
        out.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 2])):
            near = list(words)
            near[rng.randrange(len(near))] = rng.choice(vocab)
            out.append("\n".join(near))
    return out


def test_fingerprint_is_the_contract():
    for x in make_texts():
        assert simhash.fingerprint((x or "").encode()) == slow_fingerprint(x or "")


def test_long_text_in_steps(monkeypatch):
    monkeypatch.setattr(simhash, "STEP", 7)
    x = " ".join(map(str, range(100)))
    assert simhash.fingerprint(x.encode()) == slow_fingerprint(x)


@pytest.mark.parametrize("shard", [20_000, 3])
def test_against_brute_force(spark, shard):
    found = make_texts()
    ids = random.Random(1).sample(range(1000), len(found))
    docs = spark.createDataFrame([(i, x, 7, 8) for i, x in zip(ids, found)], "doc_id long, text string, fp int, node int")
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs, shard=shard).collect()}
    fps = [slow_fingerprint(x or "") for x in found]
    want = dict(zip(ids, slow_components(ids, fps)))
    assert {i: r.component_id for i, r in rows.items()} == want
    assert [rows[i].fingerprint for i in ids] == [f"{f:016x}" for f in fps]


def test_tree_finds_all_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base ^ np.uint64(5), base ^ np.uint64(1 << 40), base ^ np.uint64(0x1F)]))
    got = {(int(q), int(p)) for a, b in simhash.BKTree(fps, 4).within(fps, 4) for q, p in zip(a, b)}
    assert got == {(i, j) for i in range(len(fps)) for j in range(len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 4}


@pytest.mark.parametrize("blocks", [5, 6, 7])
def test_dense_group_in_shards(spark, blocks):
    fps = [int(x) for x in np.random.default_rng(1).integers(0, 1 << 12, 400)]
    ids = list(range(len(set(fps))))
    fps = sorted(set(fps))
    nodes = spark.createDataFrame(list(zip(fps, ids)), "fp long, node long")
    links = simhash.fingerprint_links(nodes, shard=50, blocks=blocks)
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert [got.get(i, i) for i in ids] == slow_components(ids, fps)


def test_empty_repeated_and_null_rows(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(4, "x y"), (4, "x y"), (None, "x y"), (2, "X y"), (None, "only here"), (9, None)], schema)
    got = sorted(f"{r.doc_id} {r.component_id}" for r in simhash.near_duplicates(docs).collect())
    assert got == sorted(["4 2", "4 2", "None 2", "2 2", "None None", "9 9"])


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(3, 3), (None, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 60)}


def test_blocks_follow_the_number_of_nodes():
    assert [simhash.block_count(n) for n in (0, 10**6, 10**8, 10**10, 10**11)] == [5, 5, 6, 7, 7]


@pytest.mark.parametrize("blocks", [5, 6, 7])
def test_near_fingerprints_share_a_key(spark, blocks):
    rng = np.random.default_rng(blocks)
    rows = []
    for k in range(200):
        x = int(rng.integers(0, 1 << 64, dtype=np.uint64))
        y = x
        for bit in rng.choice(64, 4, replace=False).tolist():
            y ^= 1 << bit
        rows += [(k, x - (1 << 64) if x >> 63 else x), (k, y - (1 << 64) if y >> 63 else y)]
    df = spark.createDataFrame(rows, "k int, fp long").select("k", simhash.F.explode(simhash.F.array(*simhash.block_keys(blocks, 4))).alias("key"))
    assert df.groupBy("k", "key").count().where("count = 2").select("k").distinct().count() == 200
