"""Incremental runs: files that arrive in a folder are extracted as a stream, each batch replacing the rows of its files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphlens.operators.extract import extracted
from graphlens.schema import FILES


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """FILES rows that are added to a folder as Parquet."""
    return spark.readStream.schema(FILES).parquet(folder)


def extract_stream(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Extracted rows of each batch below out, as a partition of the batch's number: a batch that runs twice writes the same partition."""

    def write(batch: DataFrame, number: int) -> None:
        extracted(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The rows of each file's last batch."""
    rows = spark.read.parquet(out)
    last = rows.groupBy("file").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["file", "batch"])
