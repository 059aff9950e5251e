"""Connected components of a link table, as alternating star contractions in DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import discard, materialize


def _nearest(links: DataFrame) -> DataFrame:
    """The least partner of each a. Aggregated before the shuffle, so a node with very many links is a few rows there."""
    return links.groupBy("a").agg(F.min("b").alias("m"))


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links(a long, b long), any direction, repeats and loops allowed -> (node long, component long), the component being its smallest node.

    A large-star step hangs each node's larger partners on the least of its neighbourhood; a small-star step hangs a node and its smaller
    partners on the least of them. Both keep the components. The rounds end when the links are stars already (their digest stays the same),
    after about log(nodes) rounds. Each round is written to the shared folder; nothing but counts comes to the driver. Nodes without links
    are not in the result; rows with a null end are ignored; an empty table gives an empty one.
    """
    spark = links.sparkSession
    start = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = materialize(start, "links")
    digest = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    for _ in range(rounds):
        if not digest[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Aggregates are written before they are joined, so that a join can split the rows of a node with very many links.
        n = digest[0]
        least, least_path = materialize(_nearest(both).select("a", F.least("a", "m").alias("m")), "least", 2 * n)
        large, large_path = materialize(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large", n)
        small, small_path = materialize(_nearest(large), "small", n)
        joined = large.join(small, "a")
        after = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        nxt, new_path = materialize(after, "links", 2 * n)
        new_digest = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(spark, path, least_path, large_path, small_path)
        now, path, same, digest = nxt, new_path, new_digest == digest, new_digest
        if same:
            break
    else:
        raise RuntimeError(f"links did not become stars within {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
