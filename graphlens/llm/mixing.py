"""Mixing sources to target weights: fixed-length blocks of words, drawn for output shards and found by pseudorandom permutations of block numbers."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens.llm.common import materialize, mix, numbered

_WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block, slots of an output shard, shards whose draws share one urn.
BLOCK, SHARD, URN = 512, 1024, 64
#: Sources that a draw knows; their sizes and targets go with the tasks.
MOST_SOURCES = 1 << 16
#: Rounds of the permutations' Feistel network.
ROUNDS = 4


def source_sizes(sized: DataFrame) -> DataFrame:
    """(source, source_no long, source_size long) of sized(source, size): numbers follow code points, null last."""
    sums, _ = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    return numbered(sums.withColumn("last", F.col("source").isNull()), ["last", "source"], "source_no").select("source", "source_no", "source_size")


def targets(sources: DataFrame, weights: tuple[int, ...], share: Fraction, most: int) -> DataFrame:
    """sources with target_num and target_den (decimal): sources share `share` of all sizes by weight (repeating, by source_no); a target above `most` times its source's size stops there and the excess is shared again, until none is above.

    Each round is one aggregate over the sources; only three sums come to the driver. The level, words for a unit of weight, only rises, so a
    source that has stopped stays so.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")).cast("long")
    rows = sources.withColumn("weight", weight)
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        stopped = F.lit(False) if level is None else F.col("weight").cast("decimal(38,0)") * level.numerator >= F.col("source_size").cast("decimal(38,0)") * most * level.denominator
        full, open_weight = rows.agg(F.coalesce(F.sum(F.when(stopped, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0))).first()
        after = (share * total - most * full) / open_weight if open_weight else level
        if after == level or after is None:
            break
        level = after
    num, den = (level.numerator, level.denominator) if level is not None else (0, 1)
    stopped = F.col("weight").cast("decimal(38,0)") * num >= F.col("source_size").cast("decimal(38,0)") * most * den
    return rows.withColumn("target_num", F.when(stopped, F.col("source_size").cast("decimal(38,0)") * most * den).otherwise(F.col("weight").cast("decimal(38,0)") * num)).withColumn("target_den", F.lit(den).cast("decimal(38,0)"))


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """Each x (below its n) under the pseudorandom permutation of 0..n-1 that its key names, or the number that it comes from (back): a Feistel network over the least even number of bits that holds n, walked until the result is below n."""
    x, n, key = (np.asarray(a, np.uint64) for a in np.broadcast_arrays(x, n, key))
    half = np.maximum(np.ceil(np.log2(np.maximum(n, 2).astype(np.float64)) / 2 + 1e-9), 1).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.copy(), np.arange(len(x))
    while len(todo):
        h, m, k = half[todo], low[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            with np.errstate(over="ignore"):
                if back:
                    left, right = right ^ (mix(left + mix(k + np.uint64(r))) & m), left
                else:
                    left, right = right, left ^ (mix(right + mix(k + np.uint64(r))) & m)
        out[todo] = left << h | right
        todo = todo[out[todo] >= n[todo]]
    return out


class Urns:
    """How many slots of each source every output shard has, and which block each slot is.

    Of each source the mix takes floor(target) words: whole passes over its blocks, and of one more pass, in that pass's own order, as many blocks
    as are needed, the last one cut. So no block is taken more often than the target's share of its source asks, rounded up. Slots are dealt to
    urns of URN * SHARD evenly (urn u of U has slots m * u // U to m * (u + 1) // U of a source with m), and inside an urn each shard's source
    counts are a multinomial draw given what the urn holds: without replacement, so that the totals hold exactly. Plain draws would miss small
    targets by their deviation and could take a text more often than allowed. All follows from the seed and the sizes, not from tasks.
    """

    def __init__(self, sizes: list[int], takes: list[int], block: int, shard: int, seed: int):
        self.block, self.shard, self.seed = block, shard, seed
        size, take = np.array(sizes, np.int64), np.array(takes, np.int64)
        self.blocks = -(-size // block)
        self.short = size - (self.blocks - 1) * block  # words of a source's last block
        passes, rest = take // np.maximum(size, 1), take % np.maximum(size, 1)
        numbers = np.arange(len(size))
        place = permuted(np.maximum(self.blocks - 1, 0), np.maximum(self.blocks, 1), self.keys(numbers, passes), back=True).astype(np.int64)
        # Of the cut pass: with the short block at `place`, m blocks hold m * block words up to there and block - short less from then on.
        more = -(-rest // block)
        more = np.where(more > place, -(-(rest + block - self.short) // block), more)
        more = np.where(rest > 0, more, 0)
        before = (more - 1) * block - np.where(more - 1 > place, block - self.short, 0)
        self.slots = passes * self.blocks + more
        self.cut = np.where(more > 0, rest - before, 0)  # words of the last slot
        self.urns = max(1, -(-int(self.slots.sum()) // (shard * URN)))

    def keys(self, source: np.ndarray, number: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(mix(mix(np.uint64(self.seed) + np.uint64(1)) + source.astype(np.uint64)) + number.astype(np.uint64))

    def draw(self, urn: int) -> dict[str, np.ndarray]:
        """The slots of one urn: shard, position, source_no, pass, block, n_words."""
        first, after = self.slots * urn // self.urns, self.slots * (urn + 1) // self.urns
        left, rng = after - first, np.random.Generator(np.random.PCG64([self.seed, urn]))
        shards, counts = max(1, -(-int(left.sum()) // self.shard)), []
        for _ in range(shards):
            counts.append(rng.multivariate_hypergeometric(left, min(self.shard, int(left.sum())), method="marginals"))
            left = left - counts[-1]
        held = np.array(counts)
        source = np.concatenate([rng.permutation(np.repeat(np.arange(len(first)), c)) for c in held]) if held.sum() else np.zeros(0, np.int64)
        order = np.argsort(source, kind="stable")
        nth = np.empty(len(source), np.int64)
        nth[order] = np.arange(len(source)) - np.repeat(np.cumsum(held.sum(0)) - held.sum(0), held.sum(0))
        slot = first[source] + nth
        blocks = self.blocks[source]
        turn = slot // np.maximum(blocks, 1)
        found = permuted(slot % np.maximum(blocks, 1), np.maximum(blocks, 1), self.keys(source, turn)).astype(np.int64)
        words = np.where(found == blocks - 1, self.short[source], self.block)
        words = np.where((slot == self.slots[source] - 1) & (self.cut[source] > 0), np.minimum(self.cut[source], words), words)
        per = held.sum(1)
        shard = np.repeat(np.arange(shards), per) + urn * (URN + 2 + len(first) // self.shard)
        return {"shard": shard, "position": np.arange(len(source)) - np.repeat(np.cumsum(per) - per, per), "source_no": source, "pass": turn, "block": found, "n_words": words}


def slots(sources: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = 0) -> DataFrame:
    """(shard, position, source_no, pass, block, n_words: long): every slot of the mix, from sources(source_no, source_size, target_num, target_den). Urns are drawn in tasks of their own. More than MOST_SOURCES sources are an error: their sizes go with the tasks."""
    spark = sources.sparkSession
    known = sources.select("source_no", "source_size", F.expr("target_num div target_den").alias("take")).limit(MOST_SOURCES + 1).collect()
    if len(known) > MOST_SOURCES:
        raise ValueError(f"a mix of more than {MOST_SOURCES} sources")
    known.sort()
    urns = Urns([r[1] for r in known], [r[2] for r in known], block, shard, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for urn in batch.column(0).to_pylist():
                got = urns.draw(urn)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in got.values()], names=list(got))

    tasks = min(urns.urns, 4 * spark.sparkContext.defaultParallelism + urns.urns // 16)
    return spark.range(0, urns.urns if known else 0, 1, tasks).mapInArrow(run, "shard long, position long, source_no long, pass long, block long, n_words long")


def placed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, sources): rows(row, doc_id, source_no, size, start) gives each row of docs its first word's place among the words of its source, ordered by doc_id (null first) and size; sources(source, source_no, source_size).

    Places are running sums over a range partitioning plus the sums of the partitions before, so a source with a third of all rows is spread
    over tasks as any other rows are.
    """
    sized, _ = materialize(docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(_WORD)).cast("long").alias("size")), "sizes")
    sources, _ = materialize(source_sizes(sized), "numbers")
    by_no, _ = materialize(sized.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source_no", "size"), "sized")
    order = ["source_no", "doc_id", "size"]

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            source, size = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            sums = np.cumsum(size) - size
            new = np.flatnonzero(np.r_[True, source[1:] != source[:-1]])
            base = sums[new].copy()
            if source[0] == last:
                base[0] -= total
            start = sums - np.repeat(base, np.diff(np.r_[new, len(source)]))
            last, total = source[-1], int(start[-1] + size[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(start)], names=[*batch.schema.names, "own"])

    kind = by_no.schema["doc_id"].dataType.simpleString()
    summed = by_no.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(running, f"doc_id {kind}, source_no long, size long, own long")
    rows, _ = materialize(summed.withColumn("row", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("row", 33).alias("part")
    sums = rows.groupBy(part, "source_no").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    based = rows.withColumn("part", part).join(sums.select("part", "source_no", before.alias("before")), ["part", "source_no"])
    return based.select("row", "doc_id", "source_no", "size", (F.col("own") + F.col("before")).alias("start")), sources


def portions(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source_no, block, row, skip: words of the row before, at: place in the block, n: words), for each block that a row has words in."""
    each = rows.where("size > 0").select("*", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
    begin = F.greatest("start", F.col("block") * block)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return each.select("source_no", "block", "row", (begin - F.col("start")).alias("skip"), (begin - F.col("block") * block).alias("at"), (end - begin).alias("n"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2, block: int = BLOCK, shard: int = SHARD, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, sources, taken): taken(shard, position, source_no, pass, block, row, skip, at, n) says which words of which row stand where in the mix: word `skip` of the row is word `at` of the slot, and n words follow on.

    A block's slots and its rows' portions meet by (source_no, block): at most `most` slots each, so nothing multiplies.
    """
    rows, sources = placed(docs)
    rows, _ = materialize(rows, "rows")
    aimed, _ = materialize(targets(sources, weights, share, most), "targets")
    # Written before the join: Spark takes a table that Python makes out of a few urns for as small as these, and would broadcast it.
    drawn, _ = materialize(slots(aimed, block, shard, seed), "slots")
    found = drawn.join(portions(rows, block), ["source_no", "block"])
    n = F.least("n", F.col("n_words") - F.col("at"))
    return rows, aimed, found.withColumn("n", n).where("n > 0").select("shard", "position", "source_no", "pass", "block", "row", "skip", "at", "n")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target double, taken long), a row for each row of docs, from mixture(): how many of its words the mix takes, repeats counted.

    Null texts have no words, null sources are one source after all others; rows without words take part with size 0; repeated rows are rows each,
    told apart by their place. No text is taken more than `most` times. An empty table gives an empty one; a table without any word has targets 0.
    Extra columns are not looked at.
    """
    rows, sources, taken = mixture(docs, **options)
    sums = taken.groupBy("row").agg(F.sum("n").alias("taken"))
    target = F.col("target_num").cast("double") / F.col("target_den").cast("double")
    return rows.join(sums, "row", "left").join(sources, "source_no").select("doc_id", "size", "source_size", target.alias("target"), F.coalesce("taken", F.lit(0)).alias("taken"))
