"""Token files and packing against the library itself."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graphlens.llm import packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", None, "a", " a", "a ", "a  b", "a \t b", "a\n b", "a\t\n  \tb c", "x y z", "don't we'll  I'M", "1 23 456", "é ü   ß", "<|endoftext|> a <|endoftext|>b", "a <|endoft ext|>", "日本 語 🙂 x", "\x00 \x1c a \x85 b", "᠎ a", "a ᠎b", "w" * 3000, "ab " * 5000, "\n\n a\n\n\nb", "a.\nB c"]


def make(n=300, seed=3):
    rng = random.Random(seed)
    alphabet = ["a", "b", "é", " ", " ", "  ", "\n", "\t", ".", "'s", "1", " ", "the", "ing"]
    return ODD + ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_library_s(library):
    found = [x or "" for x in make()]
    want = [np.array(library.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in found]
    ids = tokens.Ids(PATH)
    assert ids.cut
    assert ids.encode(found) == want
    assert ids.encode(found) == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_tokenizers_go_through_whole(name):
    path = public_tokenizers.path(name)
    ids = tokens.Ids(path)
    assert not ids.cut
    assert ids.encode(["Hello World"])[0] == np.array(Tokenizer.from_file(path).encode("Hello World", add_special_tokens=False).ids, "<u4").tobytes()


def test_token_files(spark, library):
    found = make(60)
    ids = random.Random(1).sample(range(-50, 1000), len(found))
    docs = spark.createDataFrame([(i, x, 1, 2) for i, x in zip(ids, found)], "doc_id long, text string, part int, start int")
    got = tokens.token_files(docs, PATH, 2).orderBy("doc_id").collect()
    start = 0
    for r, (i, x) in zip(got, sorted(zip(ids, found), key=lambda p: p[0]), strict=True):
        want = np.array([*library.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)


def test_token_files_of_no_and_repeated_rows(spark):
    assert tokens.token_files(spark.createDataFrame([], "doc_id long, text string"), PATH, 2).count() == 0
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (0, None)], "doc_id long, text string")
    least = tokens.token_files(spark.createDataFrame([(-(1 << 63), "x"), (None, "y"), (None, "z"), (3, "w")], docs.schema), PATH, 2)
    assert [r.doc_id for r in least.orderBy("start").collect()] == [None, None, -(1 << 63), 3]
    got = sorted((r.start, str(r.doc_id), r.n_tokens) for r in tokens.token_files(docs, PATH, 2).collect())
    assert got == [(0, "None", 2), (2, "0", 1), (3, "1", 3), (6, "1", 3)]


def test_a_file_of_64_bit_offsets_and_narrow_ids(spark, tmp_path, library):
    uri = f"file://{tmp_path}/ids"
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(20)], "doc_id long, text string")
    rows = tokens.write_ids(docs, PATH, None, uri, partitions=3).orderBy("part").collect()
    assert sum(r.n_docs for r in rows) == 20 and rows[0].base == 0
    folder, all_ids = tokens.Folder(uri), []
    for r in rows:
        ids, at = folder.array(f"ids-{r.part:06d}.bin", np.dtype("<u2")), folder.array(f"offsets-{r.part:06d}.bin", np.dtype("<i8"))
        assert isinstance(ids, np.memmap) and r.base == sum(map(len, all_ids)) and at[-1] == len(ids)
        all_ids.append(ids)
    assert library.decode(np.concatenate(all_ids).tolist()) == "".join(f"text {k}" for k in range(20))
    assert not list((tmp_path / "ids").glob("*.part"))


def fewest(items, room):
    """Fewest bins by exhaustive search."""
    items, best = sorted(items, reverse=True), len(items)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] + items[k] <= room:
                go(k + 1, [*bins[:i], bins[i] + items[k], *bins[i + 1 :]])
        go(k + 1, [*bins, items[k]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_reduction_keeps_an_optimal_packing(seed):
    rng = random.Random(seed)
    room = rng.choice([7, 10, 13])
    items = [rng.randint(1, room) for _ in range(rng.randrange(1, 9))]
    fixed, left = packing.reduce_dominated(Counter(items), room)
    assert Counter(items) == Counter(left) + Counter({a: n for a in range(1, room + 1) if (n := sum(k * held.count(a) for k, held in fixed))})
    assert all(sum(held) <= room for _, held in fixed)
    rest = [a for a, n in left.items() for _ in range(n)]
    assert sum(n for n, _ in fixed) + fewest(rest, room) == fewest(items, room)


def check_packing(rows, room):
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= room
    return len(seqs)


def test_packing(spark, library):
    found = make(200) + ["the cat sat " * 700, "b c d e f g " * 1100]
    docs = spark.createDataFrame([(i, x, 5, "z") for i, x in enumerate(found)], "doc_id long, text string, nth int, length string").repartition(3)
    rows = packing.pack(docs, PATH, 0, 2048).collect()
    n = check_packing(rows, 2048)
    assert n == -(-sum(r.length for r in rows) // 2048)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, {})[r.piece] = r
    for i, x in enumerate(found):
        want = np.array([*library.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        own = [by[i][k] for k in range(len(by[i]))]
        assert [r.start for r in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) == len(want) and all(r.length == 2048 for r in own[1:])
        assert all(zlib.crc32(want[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)


def test_packing_edge_rows(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    docs = spark.createDataFrame([(1, None), (1, None), (None, "a")], "doc_id long, text string")
    rows = packing.pack(docs, PATH, 0, 2).collect()
    assert sorted(f"{r.doc_id} {r.length}" for r in rows) == ["1 1", "1 1", "None 2"] and check_packing(rows, 2) == 2
