"""SentencePiece counts, encoding and decoding against the library itself."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from graphlens.llm import lattice, pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = ["a", "b", "é", " ", " ", "  ", "\n", "\t", "the", "ing", ",", ".", "日", "🙂", "▁", "<s>", "</s>", "<unk>", "<0x0A>", "\x00", "Ⅳ", "er", "   "]


def make(n=400, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randrange(40))) for _ in range(n)] + ["", " ", "a" * 3000, " " * 2000, "ab" * 1500, "日" * 900, "the cat, sat. " * 3000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.mark.parametrize("seed", [0, 1])
def test_counts_are_the_library_s(library, seed):
    found = make(seed=seed)
    assert pieces.Counts(PATH).of(found) == [len(x) for x in library.encode(found)]


@pytest.mark.parametrize("alphabet", ["ab", "ethaoin", "abcdefghijklmnopqrstuvwxyzé日", "=", "-_=*", "0123456789", "\n\t", "th"])
def test_long_units_without_a_blank(library, alphabet):
    rng = random.Random(alphabet)
    found = ["".join(rng.choices(alphabet, k=k)) for k in (1, 2, 3, 50, 401, 5000, 30_000)]
    assert pieces.Counts(PATH).of(found) == [len(x) for x in library.encode(found)]


def test_generations_of_memos(library, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 5)
    monkeypatch.setattr(lattice, "KEPT", 5)
    counts, own = pieces.Counts(PATH), lattice.Lattice(pieces.vocabulary(PATH))
    assert own.units.kept == 5
    for x in make(60):
        own.turn()
        want = library.encode(x)
        assert counts.of([x]) == [len(want)] and own.text(x) == np.array(want, "<u4").tobytes()


def test_neighbours_are_those_of_the_merge():
    own, rng = lattice.lattice(PATH), random.Random(2)
    some = sorted(own.pieces)
    for _ in range(4000):
        a, b = rng.choice(some)[-3:], rng.choice(some)[:3]
        if a in own.pieces and b in own.pieces and not (b[0] == pieces.BLANK != a[-1]):
            assert own.neighbours(a, b) == (own.vocab.heap_merge(a + b) == [a, b])


def test_chunks_are_the_whole(library):
    own = lattice.lattice(PATH)
    for x in make(150, 7)[:-1]:
        if not x:
            continue
        want = np.array(library.encode(x), "<u4").tobytes()
        assert own.text(x) == want
        s = pieces.BLANK + x.replace(" ", pieces.BLANK)
        assert own.path(s) == own.back(own.reach(s, 0, "", len(s)), len(s))
        for size in (17, 40):
            rows = lattice.chunks(x, size, own.longest)
            ms = [own.transfer(s, lo, hi, b, e) for _, _, s, lo, hi, b, e in rows]
            states = lattice.boundary_states(ms, 3)
            assert b"".join(own.chunk(s, lo, hi, states[k], states[k + 1]) for k, _, s, lo, hi, _, _ in rows) == want
            if len(ms) > 2:
                a, b, c = ms[:3]
                assert lattice.product(lattice.product(a, b), c) == lattice.product(a, lattice.product(b, c))


def test_round_trip(spark, library):
    found = [*make(80), None, "word " * 700, "word " * 700, "x" * 900]
    ids = [*range(len(found) - 3), 500, 500, None]
    docs = spark.createDataFrame([(i, x, 1, 2) for i, x in zip(ids, found)], "doc_id long, text string, k int, ids int")
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_crc32, r.text_sha256) for r in lattice.round_trip(docs, PATH, size=64).collect())
    want = []
    for i, x in zip(ids, found):
        out = np.array(library.encode(x or ""), "<u4").tobytes()
        want.append((str(i), len(out) // 4, zlib.crc32(out), hashlib.sha256((x or "").replace("▁", " ").encode()).hexdigest()))
    assert got == sorted(want)


@pytest.mark.parametrize("block", [2, 64])
def test_whole_table_in_small_chunks(spark, library, block):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: bytes(r.ids) for r in lattice.encode(docs, PATH, size=300, block=block).collect()}
    assert got == {r.doc_id: np.array(library.encode(r.text or ""), "<u4").tobytes() for r in docs.collect()}


def test_decode(spark):
    docs = spark.createDataFrame([(1, "a  b\n"), (2, None), (3, "日Ⅳ")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in lattice.decode(lattice.encode(docs, PATH), PATH).collect()}
    assert got == {1: "a  b\n", 2: "", 3: "日Ⅳ"}


def test_token_counts(spark, library):
    docs = spark.createDataFrame([(1, "a b", 5), (1, "a b", 5), (None, None, 5), (3, "é " * 5000, 5)], "doc_id long, text string, n_tokens int")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in pieces.token_counts(docs, PATH).collect())
    n = len(library.encode("é " * 5000))
    assert got == sorted([("1", 3, 2, False)] * 2 + [("None", 0, 0, False), ("3", 15000, n, n > 4096)])
    assert pieces.token_counts(docs.limit(0), PATH).count() == 0 and lattice.round_trip(docs.limit(0), PATH).count() == 0
