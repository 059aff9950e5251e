"""The audit of filters against a simulation of every order, row by row."""

import re
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphlens.llm import audit

LONG = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, LONG, "a"), (2, LONG, "b"), (2, LONG, "b"), (3, "short", None), (4, None, None), (5, "", "a"), (6, "word " * 60, "a"), (7, LONG + " $", "a"), (None, LONG, "a"),
    (8, "AB" * 10 + " " + LONG, "b"), (9, "ALL CAPS HERE & MORE", "b"), (10, LONG.upper(), ""), (11, "é" * 30 + " A", "a"), (12, "\x1c \x0b\t", "c"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (4, 0, 1), (4, 1, None), (6, None, None), (9, 0, 1), (None, 1, 1)]


def simulated(rows, labels):
    fails = []
    for doc, text, _ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = doc is not None and any(d is not None and d < doc and (x or "") == t for d, x, _ in rows)
        fails.append({"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": copy})
    mark = lambda doc, k: doc is not None and any(x[0] == doc and x[k] == 1 for x in labels)
    out = []
    for part in {s or "" for _, _, s in rows}:
        own = [(d, f) for (d, _, s), f in zip(rows, fails, strict=True) if (s or "") == part]
        share = dict.fromkeys("ABCDE", 0)
        made = []
        for order in permutations("ABCDE"):
            left = list(own)
            for step, x in enumerate(order, 1):
                gone = [r for r in left if r[1][x]]
                left = [r for r in left if not r[1][x]]
                share[x] += len(gone)
                total = sum(f[x] for _, f in own)
                made.append((part, "".join(order), step, len(left), len(gone), total - len(gone), sum(f[x] and sum(f.values()) == 1 for _, f in own), sum(mark(d, 1) for d, _ in gone), sum(mark(d, 2) for d, _ in gone), x))
        out += [(*r[:-1], share[r[-1]]) for r in made]
    return sorted(out)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame([(*r, 7, "x") for r in ROWS], "doc_id long, text string, source string, mask int, part string"), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_every_order_against_a_simulation(tables):
    got = sorted(tuple(r) for r in audit.audit(*tables).collect())
    assert got == simulated(ROWS, LABELS) and len(got) == 600 * 4


def test_no_rows(tables):
    docs, labels = tables
    assert audit.audit(docs.limit(0), labels).count() == 0
    assert {r.good_lost for r in audit.audit(docs, labels.limit(0)).collect()} == {0}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 31), st.integers(0, 10**19), max_size=32))
def test_polynomial_against_the_mean_over_orders(counts):
    poly = audit.removal_polynomial(counts, 5)
    gone = audit.corners(poly, 5)
    assert all(gone[s] == sum(n for m, n in counts.items() if m & s) for s in range(32))
    want = [0] * 5
    for order in permutations(range(5)):
        before = 0
        for i in order:
            want[i] += gone[before | 1 << i] - gone[before]
            before |= 1 << i
    assert audit.shapley(poly, 5) == want
