"""Near-duplicate documents by SimHash fingerprints, with BK-trees over shards of fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import discard, materialize, slices, texts
from graphlens.llm.components import connected_components

#: Shingles whose bits are counted at a time, so that a very long document needs bounded memory.
STEP = 1 << 16
#: Most fingerprints in one tree; a larger group is dealt into shards, each shard's tree being probed by every other shard.
SHARD = 20_000
#: Queries at nodes of trees that are looked at together.
PIECE = 1 << 16


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of UTF-8 text: A-Z lower-cased, words [^\\x20\\x09-\\x0D]+, shingles of `width` words joined by a space, repeats included; a shorter text is one shingle; no word gives 0. A bit is 1 if over half the XXH64 values have it."""
    words = text.lower().split()
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - width + 1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[:n].tolist()
    ends = ends[len(ends) - n :].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, STEP):
        h = np.array([digest(line[i:j], seed) for i, j in zip(starts[at : at + STEP], ends[at : at + STEP], strict=True)], np.dtype(">u8"))
        ones += np.add.reduce(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


class BKTree:
    """Metric trees under Hamming distance, one for each group of points: below a node, children are keyed by their integer distance to its pivot.

    All trees are held as arrays and grow level by level: what is left below a node is dealt by its distance to the pivot, and the first of each
    part is the next pivot. Queries descend together, each through its own group's tree and only along edges within the radius of its distance.
    """

    def __init__(self, points: np.ndarray, group: np.ndarray | int = 0):
        own = np.broadcast_to(np.asarray(group, np.int64), len(points))
        left = np.argsort(own, kind="stable")
        part, made = own[left], 0
        pivots, edges = [np.empty(0, np.int64)], []
        while len(left):
            head = np.r_[True, part[1:] != part[:-1]]
            pivots.append(left[head])
            edges.append(part[head])
            above = (np.cumsum(head) - 1)[~head]
            left = left[~head]
            part = (made + above) * 65 + np.bitwise_count(points[left] ^ points[pivots[-1][above]])
            made += len(pivots[-1])
            order = np.argsort(part, kind="stable")
            left, part = left[order], part[order]
        self.points, self.pivots, self.roots = points, np.concatenate(pivots), edges[0] if edges else np.empty(0, np.int64)
        self.edges = np.concatenate([np.empty(0, np.int64), *edges[1:]])  # of all nodes but the roots, ascending: parent * 65 + distance

    def within(self, queries: np.ndarray, radius: int, group: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query places, point places) of all pairs at most `radius` apart in one group, in pieces; without groups all queries go to the first tree."""
        asked = np.arange(len(queries))
        node = np.zeros(len(queries), np.int64) if group is None else np.minimum(np.searchsorted(self.roots, group), max(len(self.roots) - 1, 0))
        there = np.full(len(queries), len(self.roots) > 0) if group is None or not len(self.roots) else self.roots[node] == group
        todo = [(asked[there], node[there])]
        while todo:
            asked, node = todo.pop()
            if len(asked) > PIECE:
                todo += [(asked[at : at + PIECE], node[at : at + PIECE]) for at in range(0, len(asked), PIECE)]
                continue
            point = self.pivots[node]
            away = np.bitwise_count(queries[asked] ^ self.points[point]).astype(np.int64)
            near = away <= radius
            if near.any():
                yield asked[near], point[near]
            first = np.searchsorted(self.edges, node * 65 + np.maximum(away - radius, 0))
            many = np.searchsorted(self.edges, node * 65 + np.minimum(away + radius, 64), side="right") - first
            if total := int(many.sum()):
                at = np.repeat(first - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(total)
                todo.append((np.repeat(asked, many), len(self.roots) + at))


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of a[i] and b[i] for all i in the pointer array label, whose roots point to themselves and are the smallest of their set."""
    while len(a):
        while True:
            x, y = label[a], label[b]
            up = label[x]
            vp = label[y]
            if np.array_equal(up, x) and np.array_equal(vp, y):
                break
            a, b = up, vp
        keep = x != y
        x, y = x[keep], y[keep]
        if not len(x):
            return
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        a, b = x, y


def forest(fps: np.ndarray, node: np.ndarray, group: np.ndarray, in_tree: np.ndarray, asks: np.ndarray, radius: int, linked: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (a, b) of a spanning forest of the links between the rows in_tree and the rows that ask, in each group; linked(a, b) says of rows which of the pairs within the radius count."""
    names, at = np.unique(node, return_inverse=True)
    label = np.arange(len(names))
    tree, asking = np.flatnonzero(in_tree), np.flatnonzero(asks)
    for q, p in BKTree(fps[tree], group[tree]).within(fps[asking], radius, group[asking]):
        a, b = asking[q], tree[p]
        other = label[at[a]] != label[at[b]]
        a, b = a[other], b[other]
        if linked is not None and len(a):
            yes = linked(a, b)
            a, b = a[yes], b[yes]
        _merge(label, at[a], at[b])
    while not np.array_equal(label, up := label[label]):
        label = up
    a = np.flatnonzero(label != np.arange(len(label)))
    return names[a], names[label[a]]


def whole_groups(batches: Iterator[pa.RecordBatch], same: list[int], most: int = 1 << 18) -> Iterator[np.ndarray]:
    """Rows of integers that come sorted by the columns `same`, as arrays of whole groups of at least `most` rows (the last of fewer)."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.stack([np.asarray(c).astype(np.int64) for c in batch.columns], axis=1))
        if sum(map(len, held)) >= most:
            rows = np.concatenate(held)
            open_ = np.flatnonzero(np.any(rows[:, same] != rows[-1, same], axis=1))
            cut = int(open_[-1]) + 1 if len(open_) else 0
            if cut:
                yield rows[:cut]
            held = [rows[cut:]]
    if held and sum(map(len, held)):
        yield np.concatenate(held)


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp long): one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in slices(batches):
            fp = np.array([fingerprint(x, width, seed) for x in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    plain = texts(docs)
    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, fp long")


def block_count(nodes: int, radius: int = 4, group: int = 4096) -> int:
    """The least number of bit blocks whose keys leave about `group` of so many spread fingerprints to a key: with b blocks a key has b - radius of them, so more blocks make longer keys, and more of them."""
    b = radius + 1
    while nodes >> (64 * (b - radius) // b) > group and b < radius + 6:
        b += 1
    return b


def block_keys(blocks: int, radius: int) -> list[Column]:
    """Keys of column fp such that fingerprints within the radius share one at least: they differ in `radius` blocks at most, so some blocks - radius of them agree."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    chosen = list(combinations(range(blocks), blocks - radius))
    keys = []
    for k, own in enumerate(chosen):
        key = F.lit(0).cast("long")
        for x in own:
            lo, hi = cuts[x], cuts[x + 1]
            key = F.shiftleft(key, hi - lo).bitwiseOR(F.shiftrightunsigned("fp", 64 - hi).bitwiseAND(F.lit((1 << (hi - lo)) - 1)))
        keys.append(key * F.lit(len(chosen)) + F.lit(k))
    return keys


def group_links(rows: DataFrame, radius: int, shard: int, fits: Callable[[np.ndarray, np.ndarray], Callable] | None = None) -> DataFrame:
    """rows(key long, fp long, node long, more integers ...) -> (a, b): in each group of a key, links of a spanning forest over the pairs of nodes within the radius. fits(fp, more) gives what says of two arrays of rows which pairs count besides.

    A BK-tree over the group finds the pairs. A group emits a spanning forest, never all its pairs. A group of more than `shard` rows is dealt into
    shards: each shard's tree goes to every shard that probes it, so no task holds more than two shards of a group.
    """
    more = [c for c in rows.columns if c not in ("key", "fp", "node")]
    large = rows.groupBy("key").count().where(F.col("count") > shard).select("key", F.ceil(F.col("count") / shard).cast("int").alias("k"))
    rows = rows.join(large, "key", "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("i", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    rows = rows.select("fp", "node", "key", "i", *more, F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"))
    rows = rows.select("fp", "node", "key", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "i", *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, [2, 3, 4]):
            group = np.cumsum(np.r_[0, np.any(part[1:, 2:5] != part[:-1, 2:5], axis=1)])
            several = np.bincount(group)[group] > 1
            part, group = part[several], group[several]
            if len(part):
                fp = np.ascontiguousarray(part[:, 0]).view(np.uint64)
                a, b = forest(fp, part[:, 1], group, part[:, 5] == part[:, 3], part[:, 5] == part[:, 4], radius, fits and fits(fp, part[:, 6:]))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    order = ["key", "p", "q"]
    return rows.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long")


def fingerprint_links(nodes: DataFrame, radius: int = 4, shard: int = SHARD, blocks: int | None = None) -> DataFrame:
    """nodes(fp long, node long), fp distinct -> (a, b): for each pair of fingerprints within the radius, its ends are joined by links.

    Fingerprints within the radius agree on some of their bit blocks (see block_keys), so those that share a key meet in one group, and a
    BK-tree over the group finds its pairs (see group_links). The number of blocks follows the number of nodes: keys get longer, no pair gets lost.
    """
    key = block_keys(blocks or block_count(nodes.count(), radius), radius)
    return group_links(nodes.select(F.explode(F.array(*key)).alias("key"), "fp", "node"), radius, shard)


def near_duplicates(docs: DataFrame, width: int = 4, seed: int = 42, radius: int = 4, shard: int = SHARD) -> DataFrame:
    """(doc_id, fingerprint string of 16 hex digits, component_id long): one row for each row of docs.

    Fingerprints within `radius` bits link; component_id is the smallest doc_id reachable, the own one included. Texts that are null or
    without words have fingerprint 0, which links like any other. Equal fingerprints are one node, so copies cost one row each and are never
    paired. Repeated rows each get their row. A row without doc_id gets the component of its fingerprint, null if none of its texts has an id.
    No row, no result row. Other columns of docs are not looked at.
    """
    spark = docs.sparkSession
    own, _ = materialize(fingerprints(docs, width, seed), "fingerprints")
    nodes, at = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    links, links_at = materialize(fingerprint_links(nodes.where("node is not null"), radius, shard), "found")
    labels = connected_components(links)
    discard(spark, links_at)
    named = nodes.join(labels, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return own.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
