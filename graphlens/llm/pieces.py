"""SentencePiece BPE on pre-tokens: the vocabulary as tables, and token counts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphlens.llm.common import slices, texts

#: The blank of SentencePiece; a fixed value.
BLANK = "▁"
#: Most pre-tokens whose results a worker keeps; beyond that it starts anew with the generation before at hand.
KEPT = 300_000
_UNITS = re.compile(f"{BLANK}+[^{BLANK}]*")


class Vocabulary:
    """A SentencePiece BPE model without normalisation, with byte fallback and a blank before the text.

    No piece has a blank behind another character, so a text is merged in units: a run of blanks and what follows up to the next blank.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.path, self.sp = path, sentencepiece.SentencePieceProcessor(model_file=path)
        sp, n = self.sp, self.sp.get_piece_size()
        self.plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id = {sp.id_to_piece(i): i for i in self.plain}
        self.text = {i: x for x, i in self.id.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        order = sorted(self.plain, key=lambda i: -sp.get_score(i))
        self.rank = {i: k for k, i in enumerate(order)}
        probes = ("ﬁ Ⅳ é  a", " x", "A​b\t")
        ok = all(sp.is_byte(b) for b in self.bytes) and not any(re.search(f"[^{BLANK}]{BLANK}", x) for x in self.id)
        if not ok or any("".join(sp.encode(x, out_type=str)) != "".join(y if y in self.id else "".join(f"<0x{b:02X}>" for b in y.encode()) for y in BLANK + x.replace(" ", BLANK)) for x in probes):
            raise ValueError("this model normalises texts, has no byte fallback or has pieces with a blank inside")
        pairs = {(self.id[x[:k]], self.id[x[k:]]): i for x, i in self.id.items() for k in range(1, len(x)) if x[:k] in self.id and x[k:] in self.id}
        self.pairs = pairs
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        at = np.argsort(keys)
        self.pair_keys, self.pair_to = keys[at], np.array(list(pairs.values()), np.int64)[at]
        self.rank_of = np.full(n, len(order), np.int64)
        self.rank_of[order] = np.arange(len(order))
        # Pieces of which all occurrences may be merged at once: each piece that has one of them as a half ranks behind it, so none of their neighbours comes first meanwhile.
        self.at_once = np.ones(n, bool)
        for (a, b), to in pairs.items():
            for half in (a, b):
                self.at_once[half] &= self.rank_of[half] < self.rank_of[to]

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, -1 where it makes none."""
        keys = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (a >= 0) & (b >= 0), self.pair_to[at], -1)

    def units(self, text: str) -> list[str]:
        """The units of a text, each without its first blank."""
        if not text:
            return []
        if "  " not in text and text[0] != " " and BLANK not in text:
            return text.split(" ")
        return [x[1:] for x in _UNITS.findall(BLANK + text.replace(" ", BLANK))]

    def heap_merge(self, unit: str) -> list[str]:
        """One unit (with its first blank) by merging the best pair again and again, the leftmost of equals."""
        return self.heap_merges(unit)[0]

    def heap_merges(self, unit: str) -> tuple[list[str], tuple[str, str] | None]:
        """heap_merge, and the last pair that it merged."""
        pair = None
        sym, n = list(unit), len(unit)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap: list[tuple[int, int, str, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (to := self.id.get(sym[i] + sym[j])) is not None:
                heapq.heappush(heap, (self.rank[to], i, sym[i], sym[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or sym[i] != a or sym[j] != b:
                continue
            pair = a, b
            sym[i], sym[j] = a + b, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -2
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in sym if x], pair

    def count_of(self, symbol: str) -> int:
        return 1 if symbol in self.id else len(symbol.encode())

    def merge_counts(self, units: list[str]) -> np.ndarray:
        """Token counts of units (with their first blanks): all are held as one ragged array of piece ids; each round merges the lowest-ranked pair of every unit at once, and units without a pair leave. Of equal pairs in a unit the leftmost is merged, and with it, where that can't change what comes next, all that don't overlap from left to right; so the rounds of a very long unit are about as many as its different pieces."""
        out = np.zeros(len(units), np.int64)
        if not any(units):
            return out
        chars = "".join(units)
        code = np.frombuffer(chars.encode("utf-32-le"), np.uint32)
        distinct, at = np.unique(code, return_inverse=True)
        ids = np.array([self.id.get(chr(c), -1 - len(chr(c).encode())) for c in distinct.tolist()], np.int64)
        sym = ids[at]
        own = np.repeat(np.arange(len(units)), [len(x) for x in units])
        last = own[1:] != own[:-1]
        to = np.full(len(sym), -1, np.int64)
        to[:-1] = np.where(last, -1, self.merged(sym[:-1], sym[1:]))
        none = np.int64(len(self.rank_of))
        while len(sym):
            start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            rank = np.where(to >= 0, self.rank_of[to], none)
            least = np.minimum.reduceat(rank, start)
            size = np.diff(np.r_[start, len(sym)])
            done = least == none
            if done.any():
                cost = np.where(sym >= 0, 1, -1 - sym)
                out[own[start[done]]] = np.add.reduceat(cost, start)[done]
                stay = np.repeat(~done, size)
                sym, own, to, rank = sym[stay], own[stay], to[stay], rank[stay]
                if not len(sym):
                    break
                size, least = size[~done], least[~done]
            hit = np.flatnonzero(rank == np.repeat(least, size))
            first = np.r_[True, own[hit[1:]] != own[hit[:-1]]]
            block = np.r_[True, first[1:] | (hit[1:] != hit[:-1] + 1)]  # pairs of a block overlap, each with the next
            nth = np.arange(len(hit)) - np.flatnonzero(block)[np.cumsum(block) - 1]
            hit = hit[first | self.at_once[to[hit]] & (nth % 2 == 0)]
            sym[hit] = to[hit]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            at = hit - np.arange(len(hit))  # where the merged symbols are after the others have gone
            sym, own, to = sym[stay], own[stay], to[stay]
            for i in (at, at[at > 0] - 1):
                j = np.minimum(i + 1, len(sym) - 1)
                to[i] = np.where((j > i) & (own[j] == own[i]), self.merged(sym[i], sym[j]), -1)
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One Vocabulary for each model file and worker."""
    return Vocabulary(path)


class Counts:
    """Token counts of whole texts, each distinct unit being merged once for a worker and generation."""

    def __init__(self, path: str):
        self.vocab, self.known, self.before = vocabulary(path), {}, {}

    def of(self, found: list[str]) -> list[int]:
        if len(self.known) > KEPT:
            self.before, self.known = self.known, {}
        known, before, need = self.known, self.before, set()
        parts = [self.vocab.units(x) for x in found]
        for p in parts:
            need.update(filterfalse(known.__contains__, p))
        for x in need & before.keys():
            known[x] = before[x]
        order = list(need.difference(known))
        known.update(zip(order, self.vocab.merge_counts([BLANK + x for x in order]).tolist(), strict=True))
        return [sum(map(known.__getitem__, p)) for p in parts]


@lru_cache(maxsize=4)
def _counts(path: str) -> Counts:
    return Counts(path)


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes long, n_tokens long, over_limit boolean), a row for each row of docs: the tokens of its whole text as the sentencepiece library gives them for the BPE model at path, without begin and end tokens.

    Null and empty texts have no token; special strings inside a text are text, as the library has it. Repeated rows repeat. Other columns of docs are not looked at. No row gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in slices(batches):
            n = np.array(_counts(path).of([x.decode(errors="replace") for x in found]), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    plain = texts(docs)
    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
