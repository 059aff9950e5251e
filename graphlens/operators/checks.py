"""Checks of one source of truth against another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.functions.args import tail_name


def identifiers_in_place(calls: DataFrame, files: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """One row: checked, missed, ok. A recorded call's line must hold the callee's last name at its byte column; a share of misses below tolerance is ok. Calls without a column aren't checked."""
    lines = files.select(F.col("path").alias("file"), F.posexplode(F.split("text", "\n")).alias("n", "text")).withColumn("callee_line", F.col("n") + 1)
    both = calls.where("callee_col >= 0").join(lines, ["file", "callee_line"], "left").withColumn("name", tail_name(F.col("callee_expr")))
    there = F.substr(F.encode("text", "utf-8"), F.col("callee_col") + 1, F.octet_length("name")) == F.encode("name", "utf-8")
    made = both.agg(F.count("*").alias("checked"), F.count_if(~F.coalesce(there, F.lit(False))).alias("missed"))
    return made.withColumn("ok", F.col("missed") <= F.col("checked") * tolerance)


def definitions_beside_spans(definitions: DataFrame, spans: DataFrame) -> DataFrame:
    """(file, both, parser_only, index_only): names by position that the parser, the index or both have, in files that both know."""
    d = definitions.select("file", "name_line", "name_col").distinct().withColumn("d", F.lit(True))
    s = spans.where("not is_local and kind in ('function', 'method', 'class')").select("file", "name_line", "name_col").distinct().withColumn("s", F.lit(True))
    known = d.select("file").intersect(s.select("file"))
    both = d.join(s, ["file", "name_line", "name_col"], "full").join(known, "file", "left_semi")
    return both.groupBy("file").agg(F.count_if(F.col("d") & F.col("s")).alias("both"), F.count_if(F.col("s").isNull()).alias("parser_only"), F.count_if(F.col("d").isNull()).alias("index_only"))


def near_paths(results: DataFrame, calls: DataFrame) -> DataFrame:
    """Tool results whose paths are longer or shorter than the repository's: the same line and last name, and one path ending in the other behind a slash. Results' columns with the call's file."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    c = calls.select(F.col("file").alias("_file"), "line").distinct().withColumn("_base", base("_file"))
    r = results.withColumn("_base", base("file"))
    ends = lambda a, b: (F.col(a) == F.col(b)) | F.col(a).endswith(F.concat(F.lit("/"), F.col(b)))
    return r.join(c, ["line", "_base"]).where(ends("file", "_file") | ends("_file", "file")).drop("file", "_base").withColumnRenamed("_file", "file")
