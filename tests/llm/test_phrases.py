"""Phrases against a count of every phrase in memory."""

import re
from collections import Counter

import numpy as np
import pytest

from graphlens.llm import phrases

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, least, best, inside):
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(SMALL)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for (lang, g), a in f.items():
        if len(g) == 1 or a < least:
            continue
        score, k = min((10**6 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
        if len(g) == 2 and any(len(h) == 3 and own == lang and g in (h[:2], h[1:]) and b >= least and 100 * b >= inside * a for (own, h), b in f.items()):
            continue
        out.append((lang, -score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    ranks, rows = Counter(), []
    for lang, score, a, phrase, left, right in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= best:
            rows.append((lang, ranks[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return rows


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    words = ["the", "Of", "new", "york", "city", "é", "\x1c", "日本", "a\x00", "x-y", "23"]
    made = [(["en", "de", None, "und"][i % 4], "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ";"]) for _ in range(rng.integers(0, 90)))) for i in range(120)]
    return [*made, *[("en", "new york city hall new york")] * 9, ("fr", None), ("fr", ""), ("en", "same " * 3000), ("en", "w" * 5000), (None, ". , ;"), ("de", "Of\x0bthe\x0cnew\ryork")]


@pytest.mark.parametrize("options", [{}, {"least": 3, "best": 7, "inside": 20}])
def test_against_memory(spark, rows, options, monkeypatch):
    monkeypatch.setattr(phrases, "ROW", 700)
    monkeypatch.setattr(phrases, "KEYS", 500)
    docs = spark.createDataFrame([(*r, 3, 4) for r in rows], "lang string, text string, row int, n int").repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(docs, **options).collect())
    assert got == sorted(counted(rows, **({"least": 10, "best": 2000, "inside": 50} | options)))
    assert got


def test_no_rows(spark, rows):
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs.where("lang = 'fr'")).count() == 0


def test_scores_beyond_64_bits(spark):
    a = 9 * 10**15
    assert spark.range(1).selectExpr(f"{a}L as a", f"{a}L as l", f"{a + 7}L as r").selectExpr(phrases.score("a", "l", "r")).first()[0] == 10**6 * a * a // (a * (a + 7))


def test_radix_order():
    rng = np.random.default_rng(1)
    cols = [rng.integers(0, m, 5000).astype(np.uint32) for m in (3, 1 << 32, 70_000)]
    order = phrases.radix_order(cols)
    assert (order == np.lexsort(cols[::-1])).all()
    keys = phrases.packed([c[order] for c in cols])
    assert keys.to_pylist() == sorted(keys.to_pylist()) and (phrases.unpacked(keys[7:]) == np.stack(cols, 1)[order][7:]).all()
