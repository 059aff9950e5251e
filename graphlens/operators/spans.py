"""Containment and overlap of spans by one sweep in order of their starts: sorted rows come past once, and only spans that still reach the current start are held."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Sweep:
    """Spans in order of (start, -end), one step each; logged steps can be taken back.

    ends holds the spans that reach the current start, by end: (end, number of the step, start). Of these, front holds those that can still be
    somebody's smallest container: by end and, since a shorter span that reaches as far always serves better, by length too. A span leaves front
    at most once, so a sweep costs a search for each step.
    """

    def __init__(self, logged: bool = False) -> None:
        self.ends: list[tuple[int, int, int]] = []
        self.front_ends: list[int] = []
        self.front: list[tuple[int, int, int]] = []  # (length, number of the step, start)
        self.n, self.log = 0, [] if logged else None

    def container(self, end: int) -> tuple[int, int, int] | None:
        """Of the spans so far the smallest one that reaches as far as end, the later of equals, as in front; for a span that begins where they are held."""
        at = bisect_left(self.front_ends, end)
        return self.front[at] if at < len(self.front) else None

    def inside(self, start: int, end: int) -> list[tuple[int, int, int]]:
        """The spans so far that reach into start to end but end inside, as in ends."""
        return self.ends[bisect_left(self.ends, (start,)) : bisect_left(self.ends, (end,))]

    def overlaps(self, start: int, end: int) -> bool:
        """inside() has any."""
        at = bisect_left(self.ends, (start,))
        return at < len(self.ends) and self.ends[at][0] < end

    def step(self, start: int, end: int) -> None:
        """Let go of what ends before start, and take this span up."""
        over, past = bisect_left(self.ends, (start,)), bisect_left(self.front_ends, start)
        gone, left, left_ends = self.ends[:over], self.front[:past], self.front_ends[:past]
        del self.ends[:over], self.front[:past], self.front_ends[:past]
        at = bisect_left(self.ends, (end, self.n))
        self.ends.insert(at, (end, self.n, start))
        hi = lo = bisect_right(self.front_ends, end)
        while lo and self.front[lo - 1][0] >= end - start:
            lo -= 1
        worse, worse_ends = self.front[lo:hi], self.front_ends[lo:hi]
        self.front[lo:hi], self.front_ends[lo:hi] = [(end - start, self.n, start)], [end]
        self.n += 1
        if self.log is not None:
            self.log.append((gone, left, left_ends, at, lo, worse, worse_ends))

    def back(self) -> None:
        """Take the last step back."""
        gone, left, left_ends, at, lo, worse, worse_ends = self.log.pop()
        self.front[lo : lo + 1], self.front_ends[lo : lo + 1] = worse, worse_ends
        del self.ends[at]
        self.ends[:0], self.front[:0], self.front_ends[:0] = gone, left, left_ends
        self.n -= 1


def _in_order(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    return spans.repartition(key).sortWithinPartitions(F.col(key), F.col(start), F.col(end).desc())


def _swept(batch: pa.RecordBatch, state: dict, key: str, start: str, end: str) -> Iterator[tuple[int, Sweep, int, int]]:
    """For each row that is a span: its number, the sweep over the spans of its key that begin before it, its start and end. Spans of one start are taken up together, after all of them have been looked at."""
    cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (key, start, end)]
    for i, (k, s, e) in enumerate(zip(*cols, strict=True)):
        if k is None or s is None or e is None:
            continue
        if "sweep" not in state or k != state["key"]:
            state.update(key=k, sweep=Sweep(), wait=[])
        if state["wait"] and state["wait"][0][0] != s:
            for span in state["wait"]:
                state["sweep"].step(*span)
            state["wait"] = []
        yield i, state["sweep"], s, e
        state["wait"].append((s, e))


def smallest_container(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """spans(key, start, end, ...: integers) -> plus parent: the start of the smallest span of the key that begins before it and contains it, the later one of equals, null if none does.

    One shuffle by key and one sort, which spills; a task holds the spans that reach the current row, not a key's. Rows without key, start or end
    get no parent and are none; rows of one start are no parents of each other.
    """
    kind = spans.schema[start].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            found: list[int | None] = [None] * batch.num_rows
            for i, sweep, s, e in _swept(batch, state, key, start, end):
                best = sweep.container(max(s, e))
                found[i] = best[2] if best else None
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, batch.column(batch.schema.get_field_index(start)).type)], names=[*batch.schema.names, "parent"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spans.schema)
    return _in_order(spans, key, start, end).mapInArrow(run, f"{schema}, parent {kind}")


def partial_overlaps(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """spans plus parent and parent_end: a row for each span and each span of its key that begins before it, reaches into it and ends inside. Only these pairs are made."""
    kinds = [spans.schema[c].dataType.simpleString() for c in (start, end)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            rows, parents = [], []

            def out(rows: list[int], parents: list[tuple[int, int]], batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                types = [batch.column(batch.schema.get_field_index(c)).type for c in (start, end)]
                taken = batch.take(pa.array(np.array(rows, np.int64)))
                return pa.RecordBatch.from_arrays([*taken.columns, pa.array([p[0] for p in parents], types[0]), pa.array([p[1] for p in parents], types[1])], names=[*batch.schema.names, "parent", "parent_end"])

            for i, sweep, s, e in _swept(batch, state, key, start, end):
                inside = sweep.inside(s, e)
                rows += [i] * len(inside)
                parents += [(begin, stop) for stop, _, begin in inside]
                if len(rows) > 50_000:
                    yield out(rows, parents)
                    rows, parents = [], []
            yield out(rows, parents)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spans.schema)
    return _in_order(spans, key, start, end).mapInArrow(run, f"{schema}, parent {kinds[0]}, parent_end {kinds[1]}")
