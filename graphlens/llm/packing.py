"""Packing documents into sequences: Martello-Toth dominance reduction, then best fit, over counts of piece lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens.llm.common import materialize, texts
from graphlens.llm.tokens import encoded

#: A run: so many equal sequences, each holding the lengths in this order.
Run = tuple[int, tuple[int, ...]]


def reduce_dominated(counts: dict[int, int], room: int) -> tuple[list[Run], dict[int, int]]:
    """Sequences that an optimal packing may hold, and the counts that are left (Martello and Toth's reduction, on counts).

    For each length a that is left, longest first, and its spare room - a:
    - nothing fits: a is alone;
    - a length fits exactly: the pair dominates all sets with a, for any of them fits into that companion's place;
    - two of the least don't fit together: the longest that fits dominates;
    - three don't, and the longest single companion is at least as long as any pair that fits: it dominates.
    Each rule fixes as many equal sets at once as the counts allow; a length that no rule holds for is passed over. What has been fixed leaves
    fewer companions to others, so all lengths are looked at again until no rule holds for any.
    """
    left, fixed = {k: v for k, v in counts.items() if v}, []
    lengths = sorted(left)

    def take(a: int, n: int) -> None:
        left[a] -= n
        if not left[a]:
            lengths.pop(bisect_left(lengths, a))

    def companion(a: int) -> int | None:
        """The length that a's sequence holds besides in some optimal packing, 0 for none; None if no rule tells."""
        spare = room - a
        if spare != a and left.get(spare) or spare == a and left[a] > 1:
            return spare
        free = lambda x: left[x] - (x == a)
        fits = bisect_right(lengths, spare)
        b = next((x for x in reversed(lengths[max(0, fits - 2) : fits]) if free(x)), 0)
        if not b:
            return 0
        low: list[int] = []
        for x in lengths[:fits]:
            low += [x] * min(3 - len(low), free(x))
            if len(low) == 3:
                break
        if len(low) < 2 or low[0] + low[1] > spare:
            return b
        if len(low) == 3 and sum(low) <= spare:
            return None
        i, j, pair = 0, fits - 1, 0  # the longest pair that fits, from both ends
        while i <= j:
            x, y = lengths[i], lengths[j]
            if x + y > spare or not free(y):
                j -= 1
                continue
            if free(x) and (x != y or free(x) > 1):
                pair = max(pair, x + y)
            i += 1
        return b if b >= pair else None

    changed = True
    while changed:
        changed = False
        for a in lengths[::-1]:
            while left[a] and (b := companion(a)) is not None:
                n = left[a] if not b else left[a] // 2 if a == b else min(left[a], left[b])
                fixed.append((n, (a, b) if b else (a,)))
                take(a, n)
                if b:
                    take(b, n)
                changed = True
    return fixed, {x: left[x] for x in lengths}


def best_fit(counts: dict[int, int], room: int) -> list[Run]:
    """Best fit, longest first: each length goes where the least space is left. Sequences with the same content are one run, so the work follows the number of different lengths and contents, not of documents."""
    open_: list[list[Run]] = [[] for _ in range(room + 1)]
    for a in sorted((x for x, n in counts.items() if n), reverse=True):
        todo = counts[a]
        for space in range(a, room):
            again = open_[space]
            while again and todo:
                n, held = again.pop()
                k = min(space // a, todo)
                full = min(n, todo // k)
                if n > full:
                    again.append((n - full, held))
                open_[space - k * a].append((full, (*held, *[a] * k)))
                todo -= full * k
                if todo and todo < space // a and n > full:
                    again.pop()
                    if n - full > 1:
                        again.append((n - full - 1, held))
                    open_[space - todo * a].append((1, (*held, *[a] * todo)))
                    todo = 0
            if not todo:
                break
        if todo:
            k = room // a
            if full := todo // k:
                open_[room - k * a].append((full, (a,) * k))
            if rest := todo % k:
                open_[room - rest * a].append((1, (a,) * rest))
    return [run for runs in open_ for run in runs]


class _Sums:
    """Sums of one, two and three of the lengths that are left, as bits of integers; made anew only when a length has gone."""

    def __init__(self, counts: Counter, room: int):
        self.counts, self.mask, self.stale = counts, (2 << room) - 1, True

    def refresh(self) -> None:
        if self.stale:
            self.lengths = sorted((a for a, n in self.counts.items() if n > 0), reverse=True)
            self.one = self.two = self.three = 0
            for a in self.lengths:
                self.one |= 1 << a
            for a in self.lengths:
                self.two |= self.one << a & self.mask
            for a in self.lengths:
                self.three |= self.two << a & self.mask
            self.stale = False

    def best(self, space: int) -> tuple[int, ...] | None:
        """Up to three lengths that fill a space best, the longest possible first; None if nothing fits."""
        self.refresh()
        below = (2 << space) - 1
        while reach := (self.one | self.two | self.three) & below:
            total = reach.bit_length() - 1
            if self.one >> total & 1:
                return (total,)
            for a in self.lengths:
                rest = total - a
                if rest > 0 and self.one >> rest & 1 and (a != rest or self.counts[a] > 1):
                    return a, rest
            for a in self.lengths:
                if total > a and self.two >> (total - a) & 1:
                    for b in self.lengths:
                        rest = total - a - b
                        if rest > 0 and self.one >> rest & 1 and not Counter((a, b, rest)) - self.counts:
                            return a, b, rest
            below = (1 << total) - 1  # only by more copies of a length than there are
        return None


def best_sets(counts: dict[int, int], room: int) -> list[Run]:
    """Best fit of sets: a sequence begins with the longest length that is left and takes, again and again, the up to three lengths that leave the least space. A content is used as often as the counts allow, so there are few contents."""
    left = Counter({a: n for a, n in counts.items() if n > 0})
    sums, out = _Sums(left, room), []
    while True:
        sums.refresh()
        if not sums.lengths:
            return out
        held = [sums.lengths[0]]
        left[held[0]] -= 1
        sums.stale = sums.stale or not left[held[0]]
        while (more := sums.best(room - sum(held))) is not None:
            held += more
            for a in more:
                left[a] -= 1
                sums.stale = sums.stale or not left[a]
        need = Counter(held)
        again = min(left[a] // k for a, k in need.items())
        for a, k in need.items():
            left[a] -= again * k
            sums.stale = sums.stale or not left[a]
        out.append((again + 1, tuple(held)))


def pack_counts(counts: dict[int, int], room: int) -> list[Run]:
    """Dominated sets are fixed; the rest goes by best fit of sets or of single lengths, whichever needs fewer sequences."""
    fixed, left = reduce_dominated(counts, room)
    return fixed + min((best_sets(left, room), best_fit(left, room)), key=lambda runs: sum(n for n, _ in runs))


def pieces(docs: DataFrame, path: str, end_id: int, room: int) -> DataFrame:
    """(doc_id, piece int, start long, length long, ids_crc32 long, part int, nth long): every whole text's ids and end_id; only texts longer than room are cut, into pieces of room, the first being the shorter one. nth counts the pieces of the same length before it in its part, which is the task that read it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, end = TaskContext.get().partitionId(), Counter(), np.array([end_id], "<u4").tobytes()
        for batch, found in encoded(batches, path):
            docs_, rows = [], []
            for doc, ids in zip(batch.column(0).to_pylist(), found, strict=True):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % room or room, n + 1, room)]
                for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    docs_.append(doc)
                    rows.append((k, i, j - i, zlib.crc32(ids[4 * i : 4 * j]), seen[j - i]))
                    seen[j - i] += 1
            cols = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([pa.array(docs_, batch.column(0).type), pa.array(cols[0].astype(np.int32)), *map(pa.array, cols[1:4]), pa.array(np.full(len(rows), part, np.int32)), pa.array(cols[4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    plain = texts(docs)
    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def places(runs: list[Run]) -> dict[int, np.ndarray]:
    """For each length its intervals of ranks: rows (first rank, first sequence, items of the length in a sequence, offset of the first of them). Places of a length in a run are consecutive inside a sequence."""
    at: Counter = Counter()
    out: dict[int, list] = {}
    seq = 0
    for n, held in runs:
        offset = 0
        for a, k in Counter(held).items():
            out.setdefault(a, []).append((at[a], seq, k, offset))
            at[a] += n * k
            offset += a * k
        seq += n
    return {a: np.array(x, np.int64) for a, x in out.items()}


def pack(docs: DataFrame, path: str, end_id: int = 0, room: int = 2048) -> DataFrame:
    """(doc_id, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long), a row for each piece of each row of docs.

    Only the count of pieces of each length, at most `room` numbers whatever the corpus, comes to the driver. There the dominance reduction fixes
    sets, best fit packs the rest, and the plan (runs of equal sequences, at most a few for each length) goes back with the tasks. A piece's place
    follows from its rank among the pieces of its length: its count inside the part and the parts' prefix sums. Null texts count as empty: a piece
    that is end_id alone. Repeated rows are packed each. Other columns of docs are not looked at. No row gives no piece.
    """
    cut, _ = materialize(pieces(docs, path, end_id, room), "pieces")
    counts = cut.groupBy("part", "length").count()
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan = places(pack_counts(totals, room))
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cut.join(counts.select("part", "length", before.alias("before")), ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = np.asarray(batch.column(3)), np.asarray(batch.column(5))
            seq, offset = np.empty_like(rank), np.empty_like(rank)
            order = np.argsort(length, kind="stable")
            keys, first = np.unique(length[order], return_index=True)
            for a, own in zip(keys.tolist(), np.split(order, first[1:]), strict=True):
                rows = plan[a][np.searchsorted(plan[a][:, 0], rank[own], side="right") - 1]
                nth = rank[own] - rows[:, 0]
                seq[own] = rows[:, 1] + nth // rows[:, 2]
                offset[own] = rows[:, 3] + nth % rows[:, 2] * a
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kinds = ", ".join(f"{c} {cut.schema[c].dataType.simpleString()}" for c in ("doc_id", "piece", "start", "length", "ids_crc32"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, f"{kinds}, sequence_id long, offset long")
