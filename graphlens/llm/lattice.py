"""SentencePiece encoding and decoding as a max-plus path problem, so that giant documents are encoded in independent chunks.

A sequence of pieces is the model's BPE encoding of its text exactly if each two neighbours stay two when they are encoded alone. So the encoding is
the best path through the lattice of pieces when a step between such neighbours weighs 0 and any other minus infinity, and the best path is unique.
A state at a boundary is the piece that ends at it or reaches over it. A chunk's transfer matrix holds, for each state at its left boundary, the states at
its right boundary that a path of weight 0 reaches (all other entries are minus infinity); max-plus products of such matrices are associative.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import Memo, materialize, slices, texts
from graphlens.llm.pieces import BLANK, Vocabulary, vocabulary

#: Characters of a chunk. Documents of less than two chunks are encoded in one piece.
CHUNK = 1 << 15
#: Units whose ids a worker keeps, besides the generation before, and pairs whose weights it keeps.
KEPT, KEPT_PAIRS = 200_000, 300_000
#: Chunks whose matrices are multiplied to one in a round.
BLOCK = 64

_LETTERS = re.compile(r"[^\W\d_]+")

#: A state: how far its piece reaches beyond the boundary, and the piece's length. (0, 0) is a text's begin.
State = tuple[int, int]
#: The entries of a transfer matrix that aren't minus infinity.
Matrix = dict[State, frozenset[State]]
BEGIN: State = (0, 0)


def product(a: Matrix, b: Matrix) -> Matrix:
    """Max-plus product: from each left state of a, where weight 0 leads through a and b."""
    return {s: frozenset().union(*(b.get(m, ()) for m in mid)) for s, mid in a.items()}


def boundary_states(matrices: list[Matrix], block: int = BLOCK, entry: State = BEGIN, leave: State | None = None) -> list[State]:
    """The path's state at each boundary, from the entry state to the one where it leaves (the only one that it can reach, if none is given): a scan over products of blocks, then inside each block, then back."""
    first = range(0, len(matrices), block)
    whole = []
    for i in first:
        m = matrices[i]
        for x in matrices[i + 1 : i + block]:
            m = product(m, x)
        whole.append(m)
    ahead: list[frozenset[State]] = [frozenset([entry])]
    for m in whole:
        ahead.append(frozenset().union(*(m.get(s, ()) for s in ahead[-1])))
    reached = []
    for k, i in enumerate(first):
        reached.append(ahead[k])
        for m in matrices[i : i + block][:-1]:
            reached.append(frozenset().union(*(m.get(s, ()) for s in reached[-1])))
    (state,) = ahead[-1] if leave is None else (leave,)
    out = [state]
    for m, states in zip(reversed(matrices), reversed(reached), strict=True):
        (state,) = (s for s in states if state in m.get(s, ()))
        out.append(state)
    return out[::-1]


class Lattice:
    """Paths through the pieces of one vocabulary."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.rank = vocab, {x: vocab.rank[i] for x, i in vocab.id.items()}
        self.longest = max(map(len, self.rank))
        self.halves: dict[str, tuple[str, str]] = {}
        self.odd: set[str] = set()
        for x in sorted(self.rank, key=self.rank.get):
            symbols, pair = vocab.heap_merges(x)
            if pair and symbols == [x]:
                # Where a piece's halves have higher ranks, ranks don't tell the order of its merges; such pieces are compared by merging.
                rising = all(len(y) == 1 or y in self.halves and self.rank[y] < self.rank[x] for y in pair)
                self.halves.update({x: pair} if rising else {})
                self.odd.update(() if rising else (x,))
        self.pieces = {x for x in self.rank if self.joined(x)}
        self.tails = {x[k:] for x in self.pieces for k in range(len(x))}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.heads = {x[:k] for x in self.pieces for k in range(1, len(x))}
        self.units, self.rests = Memo(self._unit, KEPT), Memo(self._ids, KEPT)
        self.inside = {x[k : k + 2] for x in self.pieces for k in range(len(x) - 1)}

    def joined(self, x: str) -> bool:
        """x alone is encoded as one piece."""
        return len(x) == 1 or x in self.halves or x in self.odd

    def _spine(self, x: str, side: int) -> list[tuple[str, float]]:
        """x's symbols at one edge, from x down to a character, each with the rank of the merge that takes it away."""
        out, gone = [], float("inf")
        while True:
            out.append((x, gone))
            if x not in self.halves:
                return out
            gone, x = self.rank[x], self.halves[x][side]

    def _apart(self, a: str, b: str) -> bool:
        """No merge joins a symbol at the end of a with one at the begin of b while both are there."""
        rank = self.rank
        for x, x_gone in self._spine(a, 1):
            made_x = rank[x] if len(x) > 1 else -1
            for y, y_gone in self._spine(b, 0):
                m = rank.get(x + y)
                if m is not None and m < x_gone and m <= y_gone and made_x < y_gone and (rank[y] if len(y) > 1 else -1) < x_gone:
                    return False
        return True

    def neighbours(self, a: str, b: str) -> bool:
        """A step from a to b weighs 0: encoded alone, a + b are a and b. A character without a piece is apart from all."""
        ok = self.pairs.get((a, b))
        if ok is None:
            if a not in self.rank or b not in self.rank:
                ok = True
            elif a in self.odd or b in self.odd:
                ok = self.vocab.heap_merge(a + b) == [a, b]
            else:
                ok = self._apart(a, b)
            if len(self.pairs) > KEPT_PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = ok
        return ok

    def reach(self, s: str, start: int, last: str, end: int) -> list[str | None]:
        """For each place from start to end the piece of the weight-0 path that ends there, after the piece `last` that ends at start; None where no path does."""
        at: list[str | None] = [last]
        pieces, tails, rank, known, longest = self.pieces, self.tails, self.rank, self.pairs, self.longest
        for p in range(start + 1, end + 1):
            least, found = max(start, p - longest), []
            for j in range(p - 1, least - 1, -1):
                x = s[j:p]
                if x in pieces:
                    found.append(x)
                elif x not in tails:
                    break
            if not found and s[p - 1] not in rank:
                found.append(s[p - 1])
            while found:
                x = found.pop()
                before = at[p - len(x) - start]
                if before is not None and (not before or (ok := known.get((before, x))) or ok is None and self.neighbours(before, x)):
                    at.append(x)
                    break
            else:
                at.append(None)
        return at

    def ids(self, symbols: list[str]) -> list[int]:
        v = self.vocab
        return [i for x in symbols for i in ([v.id[x]] if x in v.id else [v.bytes[b] for b in x.encode()])]

    @staticmethod
    def back(at: list[str | None], p: int, start: int = 0) -> list[str]:
        """The path's pieces that end in (start, p]."""
        out = []
        while p > start:
            out.append(at[p])
            p -= len(at[p])
        return out[::-1]

    def path(self, s: str) -> list[str]:
        """The pieces of s, which begins and ends where no piece can cross: the path of weight 0, searched depth first with longer pieces first. As at most one such path leads to a place, a place without a way on needs no second visit."""
        heads, pieces, rank, known, dead = self.heads, self.pieces, self.rank, self.pairs, set()
        n, todo = len(s), [(0, "", self._from(s, 0, heads, pieces, rank))]
        while True:
            p, last, found = todo[-1]
            while found:
                x = found.pop()
                q = p + len(x)
                if q not in dead and (not p or (ok := known.get((last, x))) or ok is None and self.neighbours(last, x)):
                    break
            else:
                dead.add(p)
                todo.pop()
                continue
            if q == n:
                return [y for _, y, _ in todo[1:]] + [x]
            todo.append((q, x, self._from(s, q, heads, pieces, rank)))

    @staticmethod
    def _from(s: str, p: int, heads: set[str], pieces: set[str], rank: dict[str, int]) -> list[str]:
        """Pieces of s that begin at p, the longest last."""
        out = []
        for j in range(p + 1, len(s) + 1):
            x = s[p:j]
            if x in pieces:
                out.append(x)
            elif x not in heads:
                break
        return out if out or s[p] in rank else [s[p]]

    def _unit(self, x: str) -> bytes:
        """Ids of a unit given without its first blank, as little-endian uint32. Behind its leading letters it is cut where no piece holds both neighbours."""
        letters = _LETTERS.match(x)
        cut = letters.end() if letters else 0
        if 0 < cut < len(x) and x[cut - 1 : cut + 1] not in self.inside:
            return self.units[x[:cut]] + self.rests[x[cut:]]
        return self._ids(BLANK + x)

    def _ids(self, s: str) -> bytes:
        return array("I", self.ids(self.path(s))).tobytes()

    def turn(self) -> None:
        self.units.turn()
        self.rests.turn()

    def text(self, x: str) -> bytes:
        """Ids of a whole text in one piece."""
        return b"".join(map(self.units.__getitem__, self.vocab.units(x)))

    def _breaks(self, s: str, lo: int, hi: int) -> tuple[int, int]:
        """The first and last place in [lo, hi] where a blank follows another character, which no piece crosses; -1 if there is none."""
        first = next((p for p in range(max(lo, 1), min(hi, len(s) - 1) + 1) if s[p] == BLANK != s[p - 1]), -1)
        last = next((p for p in range(min(hi, len(s) - 1), max(lo, 1) - 1, -1) if s[p] == BLANK != s[p - 1]), -1)
        return first, last

    def entries(self, s: str, lo: int, begin: bool) -> list[State]:
        """All states that a boundary at lo may have."""
        if begin:
            return [BEGIN]
        out = []
        for o in range(self.longest):
            p = lo + o
            if p > len(s):
                break
            for n in range(o + 1, min(self.longest, p) + 1):
                if s[p - n : p] in self.pieces or n == 1 and s[p - 1] not in self.rank:
                    out.append((o, n))
        return out

    def _leave(self, s: str, at: list[str | None], start: int, hi: int, end: bool) -> frozenset[State]:
        """States at hi of the path whose pieces end where `at` says."""
        out = []
        for p in [hi] if end else range(hi, min(len(s), hi + self.longest - 1) + 1):
            x = at[p - start] if p - start < len(at) else None
            if x and len(x) > p - hi:
                out.append((p - hi, len(x)))
        return frozenset(out)

    def transfer(self, s: str, lo: int, hi: int, begin: bool, end: bool) -> Matrix:
        """The matrix of the chunk [lo, hi) of s, which holds some characters on either side. A path passes every break, so with one the matrix is a column times a row."""
        first, last = self._breaks(s, lo, hi)
        far = hi if end else min(len(s), hi + self.longest - 1)
        row = self._leave(s, self.reach(s, last, "", far), last, hi, end) if last >= 0 and last < hi else None
        out = {}
        for o, n in self.entries(s, lo, begin):
            p, t = lo + o, s[lo + o - n : lo + o]
            if row is not None:
                if p <= first and (p == first or self.reach(s, p, t, first)[-1] is not None):
                    out[o, n] = row
            elif states := self._leave(s, self.reach(s, p, t, far), p, hi, end):
                out[o, n] = states
        return out

    def chunk(self, s: str, lo: int, hi: int, left: State, right: State) -> bytes:
        """Ids of the pieces after the left state's up to the right state's, backtraced inside the chunk alone."""
        p, q, t = lo + left[0], hi + right[0], s[lo + left[0] - left[1] : lo + left[0]]
        first, last = self._breaks(s, p, q)
        if first < 0 or first >= q:
            return np.array(self.ids(self.back(self.reach(s, p, t, q), q - p)), "<u4").tobytes()
        head = self.back(self.reach(s, p, t, first), first - p)
        tail = self.back(self.reach(s, last, "", q), q - last) if last < q else []
        mid = s[first:last]
        units = self.vocab.units(mid[1:].replace(BLANK, " ")) if mid else []
        if mid and len(mid) == 1:
            units = [""]
        return np.array(self.ids(head), "<u4").tobytes() + b"".join(map(self.units.__getitem__, units)) + np.array(self.ids(tail), "<u4").tobytes()


@lru_cache(maxsize=4)
def lattice(path: str) -> Lattice:
    """One Lattice for each model file and worker."""
    return Lattice(vocabulary(path))


def chunks(text: str, size: int, around: int) -> list[tuple[int, int, str, int, int, bool, bool]]:
    """(number, of how many, characters with `around` more on either side, chunk's begin and end in them, first?, last?) of a text's normal form."""
    s = BLANK + text.replace(" ", BLANK)
    n = max(1, len(s) // size)
    out = []
    for k in range(n):
        lo, hi = k * size, len(s) if k == n - 1 else (k + 1) * size
        at = max(0, lo - around)
        out.append((k, n, s[at : hi + around], lo - at, hi - at, k == 0, k == n - 1))
    return out


def _flat(m: Matrix) -> list[int]:
    return [v for left, rights in m.items() for right in sorted(rights) for v in (*left, *right)]


def _matrix(flat: list[int]) -> Matrix:
    m: dict[State, set[State]] = {}
    for a, b, c, d in np.asarray(flat, np.int64).reshape(-1, 4).tolist():
        m.setdefault((a, b), set()).add((c, d))
    return {left: frozenset(rights) for left, rights in m.items()}


def states_of(matrices: DataFrame, most: int, block: int = BLOCK) -> DataFrame:
    """matrices(row long, k int, m array<int>) of at most `most` chunks a row -> (row, k, states array<int>): the states at each chunk's two boundaries.

    Spark rounds go up a tree: each multiplies the matrices of up to `block` neighbours, so that few are left of each row. Their scan gives the
    states at the topmost boundaries, and rounds down the tree those inside each product. No task holds more than `block` matrices of a row.
    """
    levels = [matrices]
    while most > block:
        most = -(-most // block)

        def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("k")
            return pd.DataFrame({"row": pdf["row"][:1], "k": pdf["k"][:1] // block, "m": [_flat(reduce(product, map(_matrix, pdf["m"])))]})

        levels.append(materialize(levels[-1].groupBy("row", F.floor(F.col("k") / block).alias("up")).applyInPandas(multiply, "row long, k int, m array<int>"), "products")[0])

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        ends = pdf["ends"].iloc[0] if "ends" in pdf else None
        entry, leave = (BEGIN, None) if ends is None else (tuple(ends[:2]), tuple(ends[2:]))
        states = boundary_states(list(map(_matrix, pdf["m"])), block, entry, leave)
        return pd.DataFrame({"row": pdf["row"], "k": pdf["k"], "states": [[*a, *b] for a, b in zip(states, states[1:], strict=False)]})

    made = "row long, k int, states array<int>"
    found = levels.pop().groupBy("row").applyInPandas(scan, made)
    while levels:
        above = found.select("row", F.col("k").alias("up"), F.col("states").alias("ends"))
        below = levels.pop().withColumn("up", F.floor(F.col("k") / block).cast("int"))
        found = below.join(above, ["row", "up"]).groupBy("row", "up").applyInPandas(scan, made)
    return found


def encode(docs: DataFrame, path: str, size: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(doc_id, ids binary: little-endian uint32), a row for each row of docs: the ids of its whole text as the sentencepiece library gives them for the BPE model at path, without begin and end.

    Texts of less than two chunks go in one piece. A longer one becomes rows of chunks, written to the shared folder: each gives its transfer
    matrix (a few hundred bytes), rounds combine a document's matrices to the states at its boundaries (see states_of), and each chunk is backtraced
    between its two states by a task of its own. Null and empty texts have no id. Repeated rows repeat. Other columns of docs are not looked at. No row gives no row.
    """
    plain = texts(docs)
    spark, kind = plain.sparkSession, plain.schema["doc_id"].dataType.simpleString()
    giant = F.length("text") + 1 >= 2 * size

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in slices(batches):
            own = lattice(path)
            own.turn()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.text(x.decode(errors="replace")) for x in found], pa.binary())], names=["doc_id", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in slices(batches):
            for i, x in enumerate(found):
                rows = chunks(x.decode(errors="replace"), size, lattice(path).longest)
                for at in range(0, len(rows), 64):
                    cols = list(zip(*rows[at : at + 64], strict=True))
                    same = [batch.column(c).take(pa.array([i] * len(cols[0]))) for c in (0, 2)]
                    yield pa.RecordBatch.from_arrays([*same, *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()), strict=True))], names=["doc_id", "row", "k", "n", "s", "lo", "hi", "begin", "end"])

    # Written once, so a row's number stays what it is; it tells rows apart whose ids and texts are alike.
    numbered = plain.where(giant).withColumn("row", F.monotonically_increasing_id())
    parts, _ = materialize(numbered.mapInArrow(cut, f"doc_id {kind}, row long, k int, n int, s string, lo int, hi int, begin boolean, end boolean"), "chunks")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["s", "lo", "hi", "begin", "end"]).to_pylist()
            flat = [_flat(lattice(path).transfer(r["s"], r["lo"], r["hi"], r["begin"], r["end"])) for r in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "k")), pa.array(flat, pa.list_(pa.int32()))], names=["row", "k", "m"])

    # A giant text's chunks were written by one task; they are dealt anew.
    even = parts.repartition("row", "k")
    made, _ = materialize(even.select("row", "k", "s", "lo", "hi", "begin", "end").mapInArrow(matrices, "row long, k int, m array<int>"), "matrices")
    most = parts.agg(F.max("n")).first()[0] or 0
    both = parts.select("doc_id", "row", "k", "s", "lo", "hi").join(states_of(made, most, block), ["row", "k"])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for r in batch.select(["s", "lo", "hi", "states"]).to_pylist():
                a, b, c, d = r["states"]
                lattice(path).turn()
                ids.append(lattice(path).chunk(r["s"], r["lo"], r["hi"], (a, b), (c, d)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row", "k")), pa.array(ids, pa.binary())], names=["doc_id", "row", "k", "ids"])

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [b"".join(x["ids"] for x in sorted(found, key=lambda x: x["k"])) for found in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    traced = both.mapInArrow(trace, f"doc_id {kind}, row long, k int, ids binary")
    whole = traced.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("k", "ids")).alias("found"))
    return plain.where(~giant).mapInArrow(short, f"doc_id {kind}, ids binary").unionByName(whole.select("doc_id", "found").mapInArrow(put_together, f"doc_id {kind}, ids binary"))


def decode_ids(ids: bytes, vocab: Vocabulary) -> str:
    """The text whose encoding the ids are: pieces and bytes in order, blanks as spaces, without the first blank."""
    held = vocab.__dict__.get("decoded")
    if held is None:
        held = vocab.decoded = {i: x.replace(BLANK, " ").encode() for i, x in vocab.text.items()} | {i: bytes([b]) for b, i in enumerate(vocab.bytes)}
    out = b"".join(map(held.__getitem__, np.frombuffer(ids, "<u4").tolist()))
    return out[1:].decode(errors="replace")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text string). Null ids give an empty text; ids that are no text pieces are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in slices(batches, "ids"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode_ids(x, vocabulary(path)) for x in found], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, size: int = CHUNK) -> DataFrame:
    """(doc_id, n_tokens long, ids_crc32 long, text_sha256 string), a row for each row of docs: its ids, and the hash of the text that they decode to (in UTF-8)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import zlib

        for batch, found in slices(batches, "ids"):
            v = vocabulary(path)
            cols = [pa.array([len(x) // 4 for x in found], pa.int64()), pa.array([zlib.crc32(x) for x in found], pa.int64()), pa.array([hashlib.sha256(decode_ids(x, v).encode()).hexdigest() for x in found])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_tokens", "ids_crc32", "text_sha256"])

    made = encode(docs, path, size)
    return made.mapInArrow(run, f"doc_id {made.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_crc32 long, text_sha256 string")
