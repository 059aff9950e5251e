"""Removal of long repeats against a version that looks at every window."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from graphlens.llm import repeats


def corpus(seed, n=40):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(rng.choice([3, 30, 3000]))]
    passages = [rng.choices(vocab, k=rng.choice([45, 50, 51, 80, 200])) for _ in range(4)]
    out = ["", None, " \n", "a " * 49, "a " * 50, "a " * 300, "x y " * 90, "a " * 120 + "b " * 60]
    for _ in range(n):
        words = rng.choices(vocab, k=rng.choice([3, 60, 150]))
        for _ in range(rng.choice([0, 1, 2])):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)[rng.choice([0, 0, 5]) :]
        out.append(rng.choice([" ", "\n", "\t \r"]).join(words))
        if rng.random() < 0.3:
            out.append(out[-1])
        if rng.random() < 0.3:
            near = out[-1].split()
            near[rng.randrange(len(near))] = "EDIT"
            out.append(" ".join(near))
    return out


def ran(docs):
    return sorted(map(str, repeats.digest(repeats.without_repeats(docs)).collect()))


def want(rows):
    return sorted(f"Row(doc_id={d!r}, n_words={n}, n_removed={m}, kept_sha256={k!r})" for d, n, m, k in repeats.brute_force(rows))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    found = corpus(seed)
    rows = list(zip(random.Random(seed).sample(range(1000), len(found)), found))
    docs = spark.createDataFrame([(d, x, 1, "q", 2) for d, x in rows], "doc_id long, text string, k int, r string, crc int")
    assert ran(docs) == want(rows)


def test_empty_null_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert repeats.without_repeats(spark.createDataFrame([], schema)).count() == 0
    long, other = " ".join(map(str, range(70))), " ".join(map(str, range(10, 75)))
    rows = [(5, long), (5, long), (7, "z " + long), (None, long), (9, other), (9, "c d"), (8, None)]
    assert ran(spark.createDataFrame(rows, schema)) == want(rows)


def test_symbols_are_the_same_wherever_their_words_are(seed=4):
    rng = np.random.default_rng(seed)
    w = repeats.mix(rng.integers(0, 40, 3000).astype(np.uint64))
    first = np.r_[0, np.sort(rng.choice(3000, 20, replace=False)), 3000]
    name, a, b, ca, cb = repeats.symbols(w, first, 4)
    assert (np.diff(ca) >= 0).all() and (np.diff(cb) >= 0).all() and (a[1:] == b[:-1]).all() and len(name) < 1500
    inside = (ca >= first[np.searchsorted(first, a, "right") - 1]) & (cb <= first[np.searchsorted(first, a, "right")])
    for i in np.flatnonzero(inside)[::17]:
        alone = np.r_[repeats.mix(rng.integers(0, 40, 9).astype(np.uint64)), w[ca[i] : cb[i]], repeats.mix(rng.integers(0, 40, 9).astype(np.uint64))]
        name2, a2, b2, *_ = repeats.symbols(alone, np.array([0, len(alone)]), 4)
        at = np.flatnonzero(a2 == a[i] - ca[i] + 9)
        assert len(at) == 1 and name2[at[0]] == name[i] and b2[at[0]] - a2[at[0]] == b[i] - a[i]


def test_marks_cover_every_window_once():
    rng = np.random.default_rng(2)
    w, first = rng.integers(0, 1 << 60, 500).astype(np.uint64), np.array([0, 0, 30, 80, 129, 500])
    _, _, start, many = repeats.marks(w, first, 50)
    got = sorted(s + k for s, n in zip(start.tolist(), many.tolist()) for k in range(n))
    assert got == [i for lo, hi in zip(first, first[1:]) for i in range(lo, hi - 49)]


def test_runs_of_marks_are_one_row():
    w = np.array([1, 2] * 200 + list(range(100, 160)), np.uint64)
    key, region, start, many = repeats.marks(repeats.mix(w), np.array([0, len(w)]), 50)
    head, step, times = repeats.runs(np.zeros(len(key), int), key, region, start, many)
    assert len(head) < 60 < times.max()
    again = [(key[i], region[i], many[i], start[i] + j * d) for i, d, n in zip(head, step, times) for j in range(n)]
    assert sorted(again) == sorted(zip(key, region, many, start))


@pytest.mark.parametrize("period", [1, 2, 7, 49, 50, 51, 60, 75])
def test_periodic_texts(spark, period):
    rng = random.Random(period)
    unit = [f"u{i}" for i in range(period)]
    tail = [f"t{i}" for i in range(80)]
    rows = [(1, unit * 5 + tail), (2, unit * 9), (3, [*"abc", *unit * 7, *tail[:60]]), (4, tail), (5, unit * 3 + ["cut"] + unit * 4), (6, unit[1:] + unit * 6)]
    rng.shuffle(rows)
    rows = [(d, " ".join(x)) for d, x in rows]
    assert ran(spark.createDataFrame(rows, "doc_id long, text string")) == want(rows)


def test_symbols_of_copies_are_long(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
    rows = [(d, " ".join([f"h{d}", *base, f"t{d}"])) for d in range(6)] + [(9, " ".join(base[:900] + ["cut"] + base[901:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ran(docs) == want(rows)
    made = []
    for d, x in rows:
        w, first = repeats.words_of([x.encode()])
        k, r, s, n = repeats.marks(w, first, 50)
        made += [(d, 0, int(a), int(b), 1, 1, int(c.view(np.int64)), int(e.view(np.int64))) for a, b, c, e in zip(s, n, k, r)]
    top, _ = repeats.shared_symbols(spark.createDataFrame(made, "doc_id long, crc long, s int, n int, step int, times int, k long, r long"))
    got = top.collect()
    for d, _ in rows:
        own = sorted((r.s, r.n) for r in got if r.doc_id == d)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
        assert len(own) < 0.5 * sum(m[0] == d for m in made)


def test_texts_of_one_doc_id_with_equal_checksums_keep_their_own_cuts(spark):
    passage, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    end = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    ends = {zlib.crc32((x := f"{passage} {end(i)}").encode()): x for i in range(200_000)}
    two = next((ends[c], x) for i in range(400_000) if (c := zlib.crc32((x := f"{other} {end(-1 - i)}").encode())) in ends)
    rows = [(1, passage), (5, two[0]), (5, two[1])]
    got = repeats.digest(repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted(map(tuple, got.collect())) == sorted(repeats.brute_force(rows))
    kept = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 5").collect()
    assert sorted((r.n_removed, r.kept) for r in kept) == [(0, two[1]), (60, two[0].split()[-1])]
