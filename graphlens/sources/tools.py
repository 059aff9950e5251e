"""Outputs of external tools as provider tables: index JSON, structural matches, data-flow results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.schema import FLOW_RESULTS

_OCC = "struct<range:array<int>,symbol:string,symbol_roles:int,symbolRoles:int,enclosing_range:array<int>,enclosingRange:array<int>>"
_INDEX = f"relative_path string, relativePath string, language string, occurrences array<{_OCC}>, symbols array<struct<symbol:string,kind:string,display_name:string,displayName:string>>"


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(occurrences, infos) of index JSON: an object with documents, a list of documents, or one document a line; snake or camel keys."""
    raw = spark.read.option("multiLine", "false").text(path, wholetext=True)
    nested = F.from_json("value", f"documents array<struct<{_INDEX.replace(' string', ':string').replace(' array', ':array')}>>")["documents"]
    listed = F.from_json("value", f"array<struct<{_INDEX.replace(' string', ':string').replace(' array', ':array')}>>")
    lines = F.transform(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, f"struct<{_INDEX.replace(' string', ':string').replace(' array', ':array')}>"))
    docs = raw.select(F.explode(F.coalesce(F.when(F.size(nested) > 0, nested), F.when(F.col("value").rlike(r"^\s*\["), listed), lines)).alias("d")).select("d.*")
    docs = docs.withColumn("file", F.replace(F.coalesce("relative_path", "relativePath"), F.lit("\\"), F.lit("/"))).where("file is not null")
    occ = docs.select("file", F.explode("occurrences").alias("o")).select("file", "o.symbol", F.coalesce("o.symbol_roles", "o.symbolRoles", F.lit(0)).alias("roles"), "o.range", F.coalesce("o.enclosing_range", "o.enclosingRange").alias("enclosing_range"))
    infos = docs.select("file", F.explode("symbols").alias("s")).select("file", "s.symbol", "s.kind", F.coalesce("s.display_name", "s.displayName").alias("display_name"))
    return occ.where("symbol is not null and range is not null"), infos


def read_pattern_matches(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """(file, line, label) of structural matches: lines count from 0 there, the label is the rule's last part, and paths may be absolute."""
    rows = spark.read.schema("file string, ruleId string, range struct<start:struct<line:int,column:int>>").json(path)
    file = F.replace(F.col("file"), F.lit("\\"), F.lit("/"))
    prefix = root.rstrip("/") + "/"
    return rows.select(F.when(F.lit(bool(root)) & file.startswith(prefix), F.substr(file, F.lit(len(prefix) + 1))).otherwise(file).alias("file"), (F.col("range.start.line") + 1).alias("line"), F.regexp_replace("ruleId", "^[a-z]+--", "").alias("label"))


def read_flow_results(spark: SparkSession, path: str) -> DataFrame:
    """Data-flow results with a fixed schema; a damaged line is an error."""
    return spark.read.schema(FLOW_RESULTS).option("mode", "FAILFAST").json(path)
