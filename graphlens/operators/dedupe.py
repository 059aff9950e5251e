"""Order-sensitive row operators: first wins, suffixes, boundaries, carried values, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. Spark limits the groups before the shuffle, so a key with very many rows sends few."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_per(df: DataFrame, keys: list[str], order: list[str | Column], n: int) -> DataFrame:
    """The first n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def suffixed(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Repeated values get ~2, ~3, ... in order."""
    n = F.row_number().over(Window.partitionBy(column).orderBy(*order))
    return df.withColumn("_n", n).withColumn(column, F.when(F.col("_n") > 1, F.concat(column, F.lit("~"), F.col("_n").cast("string"))).otherwise(F.col(column))).drop("_n")


def next_boundary(df: DataFrame, keys: list[str], start: str) -> DataFrame:
    """Plus end: the place before the next row's start, null for the last row of a key."""
    return df.withColumn("end", F.lead(start).over(Window.partitionBy(*keys).orderBy(start)) - 1)


def carried(df: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    """column's last value so far, as a section's name holds for the lines below it."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def capped(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """All rows, within_cap for the first n of a key, and overflow: how many more the key has. Nothing is dropped."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    totals = df.groupBy(*keys).agg(F.greatest(F.count("*") - n, F.lit(0)).alias("overflow"))
    return df.withColumn("within_cap", nth <= n).join(totals, keys)
