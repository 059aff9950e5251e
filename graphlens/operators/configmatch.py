"""Hosts of external calls in configuration: values, service names, first labels, text; the strongest of a file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions.hosts import normalize_host
from graphlens.operators.joins import token_hits
from graphlens.schema import MATCH_TIERS
from graphlens.sources.configs import token_boundary


def match_config(edges: DataFrame, index: dict[str, DataFrame], done: DataFrame | None = None) -> DataFrame:
    """(call_id, path, kind, confidence, key_path, value, line, hit): for each external candidate with a host and each configuration file the strongest match. Pairs in `done` (call_id, path) are left out.

    Three tiers are equi-joins on the normalised host, an alias and the first label (of more than two characters); distinct hosts are joined, not
    calls. Only files that no reader took are searched as text, by the tokens in it.
    """
    calls = edges.where("status = 'external_candidate'").select("call_id", normalize_host(F.col("host")).alias("host")).where("host is not null")
    hosts = calls.select("host").distinct().withColumn("label", F.substring_index("host", ".", 1))
    value = hosts.join(index["hosts"], "host").select("host", "path", "key_path", "value", "line", F.col("host").alias("hit"))
    alias = hosts.join(index["aliases"], F.col("host") == F.col("alias")).select("host", "path", F.concat(F.lit("<"), "key_path", F.lit(">")).alias("key_path"), "value", F.lit(0).alias("line"), F.col("value").alias("hit"))
    label = hosts.where("length(label) > 2").join(index["services"], F.col("label") == F.col("name")).select("host", "path", F.concat(F.lit("<"), "reason", F.lit(">")).alias("key_path"), F.col("name").alias("value"), F.lit(0).alias("line"), F.col("name").alias("hit"))
    text = token_hits(hosts.select("host"), "host", index["texts"], "value", token_boundary(F.col("host")))
    text = text.groupBy("host", "path").agg(F.min_by(F.struct("key_path", F.substring(F.trim("value"), 1, 200).alias("value"), "line"), "line").alias("at")).select("host", "path", "at.*", F.col("host").alias("hit"))
    tiers = [df.withColumn("tier", F.lit(k)).withColumn("kind", F.lit(kind)).withColumn("confidence", F.lit(sure)) for k, (df, (kind, sure)) in enumerate(zip((value, alias, label, text), MATCH_TIERS, strict=True))]
    w = Window.partitionBy("host", "path").orderBy("tier", "line")
    best = reduce(DataFrame.unionByName, tiers).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "tier")
    found = calls.join(best, "host").drop("host")
    return found.join(done.select("call_id", "path"), ["call_id", "path"], "left_anti") if done is not None else found


def with_matches(edges: DataFrame, matches: DataFrame) -> DataFrame:
    """edges plus config_matches: the paths in order."""
    paths = matches.groupBy("call_id").agg(F.array_sort(F.collect_set("path")).alias("config_matches"))
    return edges.join(paths, "call_id", "left").withColumn("config_matches", F.coalesce("config_matches", F.array().cast("array<string>")))
