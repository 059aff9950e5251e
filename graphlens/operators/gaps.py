"""Gaps: what was not analysed and why, as rows."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.operators.dedupe import first_wins

FIELDS = ("stage", "scope", "kind", "path", "detail", "impact", "count", "samples")


def gap(rows: DataFrame, stage: str, scope: str, kind: str | Column, path: Column | None = None, detail: Column | None = None, impact: str = "", count: Column | None = None, samples: Column | None = None) -> DataFrame:
    """A gap for each row."""
    text = lambda x: F.coalesce(x.cast("string"), F.lit("")) if x is not None else F.lit("")
    return rows.select(
        F.lit(stage).alias("stage"), F.lit(scope).alias("scope"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), text(path).alias("path"), text(detail).alias("detail"), F.lit(impact).alias("impact"),
        (count.cast("long") if count is not None else F.lit(1).cast("long")).alias("count"), (samples if samples is not None else F.array().cast("array<string>")).alias("samples"),
    )


def merged(*parts: DataFrame) -> DataFrame:
    """All gaps; of those with the same stage, scope, kind, path and detail the first part's."""
    rows = None
    for k, df in enumerate(parts):
        own = df.select(*FIELDS).withColumn("_part", F.lit(k))
        rows = own if rows is None else rows.unionByName(own)
    return first_wins(rows, ["stage", "scope", "kind", "path", "detail"], ["_part", "count", "impact"]).drop("_part")


def summary(gaps: DataFrame) -> DataFrame:
    """(kind, n): the sum of counts, the largest first when ordered by (-n, kind)."""
    return gaps.groupBy("kind").agg(F.sum("count").alias("n"))


def to_dict(row) -> dict:
    return {k: (list(row[k]) if k == "samples" and row[k] is not None else row[k]) for k in FIELDS if not (k == "samples" and not row[k])}


def from_dict(value: object) -> dict:
    """A gap from JSON: unknown keys are ignored; no object, or no stage, scope or kind, is an error."""
    if not isinstance(value, dict) or any(not isinstance(value.get(k), str) for k in ("stage", "scope", "kind")):
        raise ValueError("a gap is an object with stage, scope and kind")
    base = {"path": "", "detail": "", "impact": "", "count": 1, "samples": []}
    return base | {k: v for k, v in value.items() if k in FIELDS and v is not None}


def write_atomic(path: str, text: str) -> None:
    """The whole text or the old file: a temporary file beside it, synced and renamed."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, part = tempfile.mkstemp(dir=folder, suffix=".part")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise


def write_gaps(gaps: DataFrame, path: str) -> None:
    """gaps.json: one list, in a fixed order. A report is small: gaps are aggregated and capped by discovery."""
    rows = gaps.orderBy("stage", "kind", "path", "detail").collect()
    write_atomic(path, json.dumps([to_dict(r) for r in rows], indent=2, sort_keys=True) + "\n")


def read_gaps(spark: SparkSession, path: str) -> DataFrame:
    from graphlens.schema import GAPS

    with open(path, encoding="utf-8") as f:
        value = json.load(f)
    if not isinstance(value, list):
        raise ValueError("gaps are a list")
    rows = [from_dict(x) for x in value]
    return spark.createDataFrame([tuple(r[k] for k in FIELDS) for r in rows], GAPS)
