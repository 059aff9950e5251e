"""Near-duplicate documents by the similarity of their shingle sets: SimHash fingerprints in BK-trees give candidates, the sets themselves decide.

SimHash alone can't hold a similarity: texts of 0.8 differ by up to some 40 of 128 bits, and no index of bit blocks reaches so far. So the groups in
which trees are built come from the shingles: two sets of the wanted similarity share one of the rarest of each (the prefix of a set under one
order of all shingles), whatever the order is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import bounded, discard, materialize, mix, slices
from graphlens.llm.components import connected_components
from graphlens.llm.repeats import words_of
from graphlens.llm.simhash import SHARD, STEP, group_links

#: Bits of 128 by which fingerprints of candidates may differ, and of their first 64, by which the trees are built. At a similarity of 0.8 the means are 19.4
#: and 9.7 and the deviations 4.1 and 2.9, so one pair in a million lies beyond; unrelated texts differ by 64 bits and 5.7.
RADIUS, HALF = 40, 24
#: Frequent shingles that the order of prefixes knows, and from how many of a slice's documents, and what share of them, a shingle counts as frequent there. Any order is right; this one keeps groups small.
HEAVY, OFTEN, SHARE = 1 << 18, 3, 0.004
#: Bytes of text whose shingles are arrays at a time, and of the sets of a cluster that one task holds twice.
SLICE, CLUSTER_BYTES = 2 << 20, 16 << 20
#: Multiplier of a shingle's hash, odd; a fixed value.
STRIDE = 0x9E3779B97F4A7C15


def shingle_sets(found: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of `width` lower-case words of each text, ascending, and where each text's begin. A text of fewer words is one shingle, one without words has none."""
    w, first = words_of([x.lower() for x in found])
    size = np.diff(first)
    n = np.where(size >= width, size - width + 1, (size > 0).astype(np.int64))
    own = np.repeat(np.arange(len(found)), n)
    at = np.repeat(first[:-1] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
    h = np.zeros(len(at), np.uint64)
    last = np.minimum(first[1:][own], at + width)
    for j in range(width):
        here = at + j < last
        h[here] = (h[here] + w[at[here] + j]) * np.uint64(STRIDE)
    h = mix(h + (last - at).astype(np.uint64))
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return h[new], np.r_[0, np.cumsum(np.bincount(own[new], minlength=len(found)))]


def set_fingerprint(h: np.ndarray) -> int:
    """128-bit SimHash of a set of hashes, each counting once."""
    ones = np.zeros(128, np.int64)
    for at in range(0, len(h), STEP):
        part = h[at : at + STEP]
        both = np.stack([part, mix(part + np.uint64(STRIDE))], axis=1).astype(">u8")
        ones += np.unpackbits(both.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def prefix_size(n: np.ndarray, similarity: float) -> np.ndarray:
    """How many of a set's n shingles, the first in any common order, hold one that each set of that similarity has among its first."""
    return np.where(n > 0, n - np.ceil(similarity * n - 1e-9) + 1, 0).astype(np.int64)


def _may_link(first: np.ndarray, more: np.ndarray, similarity: float):
    """What tells of rows (halves of the fingerprint, size, place of the shared shingle in the prefix) whether two may be similar: by their bits, their sizes, and by what can follow if this shingle is the first that they share. Similar sets pass where it is."""
    other, size, place = np.ascontiguousarray(more[:, 0]).view(np.uint64), more[:, 1], more[:, 2]

    def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        away = np.bitwise_count(other[a] ^ other[b]).astype(np.int64) + np.bitwise_count(first[a] ^ first[b])
        least, both = np.minimum(size[a], size[b]), size[a] + size[b]
        most = np.minimum(size[a] - place[a], size[b] - place[b])
        return (away <= RADIUS) & (least >= similarity * (both - least) - 1e-9) & (most >= similarity / (1 + similarity) * both - 1e-9)

    return linked


def _verified(node: np.ndarray, sets: list[np.ndarray], near: np.ndarray, asks: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links of a spanning forest over the pairs of a set in `near` and one that asks which are similar enough.

    No pair is looked at that shares no shingle among the first of both, in the order from the rarest shingle here on: sets come by size, each asks
    the inverted lists of its first shingles and is then entered into them. Of two similar sets the smaller one has their first common shingle among
    its first size - 2 s / (1 + s) size + 1, the larger one among its first size - s size + 1, and behind its place both have enough left. Lists are
    kept by component, so that a set asks no other one of a component that it has joined.
    """
    names, at, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(names), np.int64)
    rank[np.lexsort((names, many))] = np.arange(len(names))
    alone = int((many == 1).sum())  # the ranks below are in one set each
    size = np.array([len(x) for x in sets])
    own = [np.sort(x) for x in np.split(rank[at], np.cumsum(size)[:-1])]
    parent, weight, out, here = list(range(len(sets))), [1] * len(sets), [], np.zeros(len(names), bool)
    lists: dict[str, dict[int, dict[int, list[tuple[int, int]]]]] = {"near": {}, "asks": {}}
    same = bool((near == asks).all())

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for b in np.argsort(size, kind="stable").tolist():
        n, mine, marked, failed = int(size[b]), own[b], False, set()
        least = np.ceil(similarity * n - 1e-9)
        first = mine[: n - int(least) + 1]
        sides = [lists["near"]] if same else [lists["near"]] * bool(asks[b]) + [lists["asks"]] * bool(near[b])
        for place, g in zip(range(len(first)), first.tolist(), strict=True):
            for held in [x[g] for x in sides if g in x] if g >= alone else ():
                for r in list(held):
                    if (to := root(r)) != r:
                        few, more = sorted((held.pop(r), held.pop(to, [])), key=len)
                        more += few
                        held[to] = more
                for r in list(held):
                    if root(r) == root(b):
                        continue
                    for a, place_a in reversed(held[r]):
                        need = int(np.ceil(similarity / (1 + similarity) * (n + size[a]) - 1e-9))
                        if size[a] < least or a in failed or min(n - place, size[a] - place_a) < need:
                            continue
                        if not marked:
                            here[mine], marked = True, True
                        both = int(np.count_nonzero(here[own[a]]))
                        if both >= similarity * (n + size[a] - both) - 1e-9:
                            out.append((int(node[b]), int(node[a])))
                            few, more = sorted((root(a), root(b)), key=weight.__getitem__)
                            parent[few] = more
                            weight[more] += weight[few]
                            break
                        failed.add(a)
        if marked:
            here[mine] = False
        entered = n - int(np.ceil(2 * similarity / (1 + similarity) * n - 1e-9)) + 1
        for place, g in enumerate(mine[:entered].tolist()):
            if g >= alone:
                for side in ("near",) if same else ("near",) * bool(near[b]) + ("asks",) * bool(asks[b]):
                    lists[side].setdefault(g, {}).setdefault(root(b), []).append((b, place))
    return out


def similar_documents(docs: DataFrame, width: int = 5, similarity: float = 0.8, shard: int = SHARD, cluster_bytes: int = CLUSTER_BYTES) -> DataFrame:
    """(doc_id, digest string: MD5 of the text, component_id, component_digest): one row for each row of docs with a doc_id.

    Documents link whose sets of `width`-word shingles (A-Z lower-cased) have at least that Jaccard similarity. component_id and component_digest name
    the reachable row with the smallest doc_id, and of its texts the one with the smallest digest. Texts that are null or without words are alike.

    1. One pass over the texts: the set's 128-bit hash, its size and fingerprint; equal sets are one node from there on. It also counts shingles
       that are frequent among neighbouring documents; the most frequent of them (HEAVY at most) come last in the order of shingles.
    2. A second pass gives each set's prefix. Nodes that share one meet in a group; a BK-tree over it finds the pairs of near fingerprints, of
       which the forest of those that may be similar by sizes and places of the shingle stays. Frequent shingles are in few prefixes, so groups are small; large ones go in shards.
    3. Candidates' components are clusters. Only texts in clusters are read a third time, and pairs inside a cluster that share one of their
       first shingles are decided by their sets (a cluster's own order of shingles leaves few others); a large cluster goes in shards too. The links that hold make the components.

    Repeated rows each get their row. Rows without doc_id are left out. Other columns of docs are not looked at. No row, no result row.
    """
    spark = docs.sparkSession
    plain = bounded(docs).where("`doc_id` is not null").select(F.col("`doc_id`").alias("doc_id"), F.coalesce(F.col("`text`"), F.lit("")).alias("text")).withColumn("digest", F.md5(F.col("text").cast("binary")))
    kind = plain.schema["doc_id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "digest", "s", "t", "fp", "fq", "size", "key", "many"]
        for batch, found in slices(batches, most=SLICE):
            h, first = shingle_sets(found, width)
            n, both, fps = len(found), [], []
            for lo, hi in zip(first.tolist(), first[1:].tolist(), strict=False):
                both.append(xxhash.xxh3_128_digest(h[lo:hi].tobytes()))
                fps.append(set_fingerprint(h[lo:hi]).to_bytes(16, "big"))
            s, t = np.frombuffer(b"".join(both), np.int64).reshape(-1, 2).T
            fp, fq = np.frombuffer(b"".join(fps), ">i8").astype(np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *map(pa.array, (s, t, fp, fq)), pa.array(np.diff(first).astype(np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names)
            key, many = np.unique(h, return_counts=True)
            often = many >= max(OFTEN, SHARE * n)
            if often.any():
                none = [pa.nulls(int(often.sum()), kind_) for kind_ in (batch.schema.field(0).type, batch.schema.field(2).type, *[pa.int64()] * 4, pa.int32())]
                yield pa.RecordBatch.from_arrays([*none, pa.array(key[often].view(np.int64)), pa.array(many[often])], names=names)

    made, made_at = materialize(plain.mapInArrow(sketch, f"doc_id {kind}, digest string, s long, t long, fp long, fq long, size int, key long, many long"), "sets")
    own = made.where("doc_id is not null").select("doc_id", "digest", "s", "t", "fp", "fq", "size")
    lead, n = F.min(F.struct("doc_id", "digest")).alias("lead"), own.count()
    # Written once, so the ids stay what they are.
    nodes, nodes_at = materialize(own.groupBy("s", "t").agg(F.first("fp").alias("fp"), F.first("fq").alias("fq"), F.first("size").alias("size"), lead).withColumn("node", F.monotonically_increasing_id()), "nodes", n)
    often = made.where("key is not null").groupBy("key").agg(F.sum("many").alias("many")).orderBy(F.desc("many"), "key").limit(HEAVY).toArrow()
    heavy, weight = np.asarray(often.column("key")).view(np.uint64), np.asarray(often.column("many"))
    order = np.argsort(heavy)
    heavy, weight = heavy[order], weight[order]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in slices(batches, most=SLICE):
            h, first = shingle_sets(found, width)
            n = np.diff(first)
            own_ = np.repeat(np.arange(len(n)), n)
            often_ = np.zeros(len(h), np.int64)
            if len(heavy):
                at = np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)
                often_ = np.where(heavy[at] == h, weight[at], 0)
            by = np.lexsort((h, often_, own_))
            nth = np.arange(len(h)) - np.repeat(first[:-1], n)
            within = nth < np.repeat(prefix_size(n, similarity), n)
            take = by[within]
            s = np.frombuffer(b"".join(xxhash.xxh3_128_digest(h[lo:hi].tobytes())[:8] for lo, hi in zip(first.tolist(), first[1:].tolist(), strict=False)), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[take].view(np.int64)), pa.array(s[own_[take]]), pa.array(nth[within].astype(np.int32))], names=["key", "s", "place"])

    keys, keys_at = materialize(plain.select("text").mapInArrow(prefixes, "key long, s long, place int"), "prefixes")
    shared, shared_at = materialize(keys.groupBy("key").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo < hi").select("key"), "keys")
    rows, rows_at = materialize(keys.join(shared, "key", "left_semi").distinct().join(nodes.select("s", "fp", "fq", "node", "size"), "s").select("key", "fp", "node", "fq", "size", "place"), "members")
    discard(spark, keys_at, shared_at)
    links, links_at = materialize(group_links(rows, HALF, shard, lambda fp, more: _may_link(fp, more, similarity)), "candidates")
    discard(spark, rows_at)
    clusters = connected_components(links)
    found = nodes.join(clusters.withColumnRenamed("component", "cluster"), "node")
    found, found_at = materialize(found.select("node", "cluster", "size", F.col("lead.doc_id").alias("lead_id"), F.col("lead.digest").alias("lead_digest")), "clusters", n)
    discard(spark, links_at)
    parts = found.groupBy("cluster").agg(F.ceil(F.sum("size") * 8 / F.lit(cluster_bytes)).cast("int").alias("k"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts_ in slices(batches, most=SLICE):
            h, first = shingle_sets(texts_, width)
            made_ = [h[lo:hi].tobytes() for lo, hi in zip(first.tolist(), first[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(made_, pa.binary())], names=[*batch.schema.names[1:], "set"])

    asked = found.join(parts, "cluster").withColumn("i", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    asked = plain.join(asked, (F.col("doc_id") == F.col("lead_id")) & (F.col("digest") == F.col("lead_digest"))).dropDuplicates(["node"])
    held = asked.select("text", "node", "cluster", "k", "i").mapInArrow(sets, "node long, cluster long, k int, i int, set binary")
    held = held.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("cluster", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "i", "node", "set")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(rows_: list[tuple]) -> list[tuple[int, int]]:
            p, q = rows_[0][0][1:]
            i, node = np.array([r[1:3] for r in rows_], np.int64).T
            return _verified(node, [np.frombuffer(r[3], np.uint64) for r in rows_], i == p, i == q, similarity) if len(rows_) > 1 else []

        group: list[tuple] = []
        for batch in batches:
            out: list[tuple[int, int]] = []
            cols = [c.to_pylist() for c in batch.columns]
            for cluster, p, q, i, node, set_ in zip(*cols, strict=True):
                if group and group[0][0] != (cluster, p, q):
                    out += of(group)
                    group = []
                group.append(((cluster, p, q), i, node, set_))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])
        if group and (out := of(group)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    by = ["cluster", "p", "q"]
    sure, sure_at = materialize(held.repartition(*by).sortWithinPartitions(*by).mapInArrow(decide, "a long, b long"), "links")
    named = nodes.select("node", "s", "t", "lead").join(connected_components(sure), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named, named_at = materialize(named, "named", n)
    least, least_at = materialize(named.groupBy("component").agg(F.min("lead").alias("least")), "least", n)
    out, _ = materialize(own.join(named.join(least, "component").select("s", "t", "least"), ["s", "t"]).select("doc_id", "digest", F.col("least.doc_id").alias("component_id"), F.col("least.digest").alias("component_digest")), "similar", n)
    discard(spark, made_at, nodes_at, found_at, sure_at, named_at, least_at)
    return out
