"""Where results go: graph tables and JSON, reports as CSV and JSON, a vector table with upserts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def graph_json(nodes: DataFrame, edges: DataFrame, meta: dict) -> dict:
    """{nodes, edges, meta} of one repository, for an API; at scale read the tables."""
    import json

    return {"nodes": [json.loads(x) for x in nodes.orderBy("id").toJSON().collect()], "edges": [json.loads(x) for x in edges.orderBy("src", "dst", "kind", "label").toJSON().collect()], "meta": meta}


def flat(df: DataFrame) -> DataFrame:
    """Arrays of strings joined by ' | ', structures left out: rows for a CSV file."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind == "array<string>":
            out.append(F.array_join(f.name, " | ").alias(f.name))
        elif not kind.startswith(("array", "struct", "map")):
            out.append(F.col(f.name))
    return df.select(*out)


def write_reports(edges: DataFrame, gaps: DataFrame, folder: str) -> None:
    """edges, unresolved and gaps as CSV with a header, and all edges as JSON lines."""
    for name, df in (("edges", edges), ("unresolved", edges.where("status = 'unresolved'")), ("gaps", gaps)):
        flat(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(os.path.join(folder, name))
    edges.write.mode("overwrite").json(os.path.join(folder, "report"))


def upsert_vectors(spark: SparkSession, path: str, run_id: str, rows: DataFrame) -> DataFrame:
    """Vectors (id, embedding, ...) of a run replace those of the same ids; each run is a partition of the table, and a new version is written before the old one goes."""
    new = rows.withColumn("run_id", F.lit(run_id))
    at = os.path.join(path, f"run_id={run_id}")
    try:
        old = spark.read.parquet(at).withColumn("run_id", F.lit(run_id))
        new = old.join(rows.select("id"), "id", "left_anti").unionByName(new)
    except Exception as e:  # a first run has no partition yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    next_ = os.path.join(path, f"_next_{run_id}")
    new.drop("run_id").write.mode("overwrite").parquet(next_)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(fs_path(at), True)
    fs.rename(fs_path(next_), fs_path(at))
    return spark.read.parquet(at)


def reference_lines(references: DataFrame) -> DataFrame:
    """(value): JSON lines of an index's references, {"at": "file:line:col", "targets": [...]}, targets in order; write them with .write.text."""
    at = F.concat_ws(":", "file", F.col("line").cast("string"), F.col("col").cast("string"))
    target = F.concat_ws(":", "def_file", F.col("def_line").cast("string"), F.col("def_col").cast("string"))
    made = references.groupBy(at.alias("at")).agg(F.array_sort(F.collect_set(target)).alias("targets"))
    return made.select(F.to_json(F.struct("at", "targets")).alias("value"))
