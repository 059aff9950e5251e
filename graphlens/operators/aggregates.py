"""Counters, breakdowns and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counters(events: DataFrame) -> DataFrame:
    """(key, n) from rows with a key."""
    return events.groupBy("key").agg(F.count("*").alias("n"))


def with_prefix(made: DataFrame, prefix: str) -> DataFrame:
    """The counters whose key begins with prefix, without it."""
    return made.where(F.col("key").startswith(prefix)).select(F.substring("key", len(prefix) + 1, 1 << 30).alias("key"), "n")


def most_common(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent values, ties to the smaller value."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def breakdown(df: DataFrame, key: str) -> DataFrame:
    """(key, n, percent of all rows with two decimals). The window goes over one row a value, after the aggregate."""
    made = df.groupBy(key).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return made.withColumn("percent", F.round(F.lit(100.0) * F.col("n") / total, 2))


def zero_filled(df: DataFrame, dimensions: dict[str, DataFrame]) -> DataFrame:
    """Counts for every combination of the dimensions' values, 0 where df has no row."""
    made = df.groupBy(*dimensions).agg(F.count("*").alias("n"))
    grid = reduce(lambda a, b: a.crossJoin(b), (d.distinct() for d in dimensions.values()))
    return grid.join(made, list(dimensions), "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def tagged(column: str, parts: dict[str, DataFrame]) -> DataFrame:
    """All parts under each other, column naming the part."""
    return reduce(DataFrame.unionByName, (df.withColumn(column, F.lit(name)) for name, df in parts.items()))
