"""What the operators share: the cluster's shared folder, written tables, hashing, batches of whole texts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Odd multipliers of a 64-bit finaliser and of polynomial hashes; fixed values.
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of text that a Python worker turns into arrays at a time.
SLICE_BYTES = 4 << 20


#: Keys of a generation of a worker's memo.
KEPT = 300_000
#: Rows and bytes of an Arrow batch to or from a Python worker: whole texts are long, and a batch is held on both sides at once.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: Rows of a file of a table of short rows.
FILE_ROWS = 30_000


def bounded(df: DataFrame) -> DataFrame:
    """df, whose session from now on sends texts to Python workers in small batches."""
    for key, n in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        df.sparkSession.conf.set(f"spark.sql.execution.arrow.{key}", str(n))
    return df


def shared_root(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir. Where that is unset, a new folder of this machine if Spark runs in this process alone (tests), else an error: on a cluster each machine would write to a disk of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="graphlens-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/graphlens/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, rows: int | None = None, batch: int = BATCH_ROWS) -> tuple[DataFrame, str]:
    """Write df as Parquet into the shared folder and read it again: lineage ends there, so a lost executor costs no recomputation of earlier steps. Returns the table and its path. Where it is known about how many rows there are, files follow their number, so that small tables aren't one file for each shuffle partition. Tables of numbers may go to Python workers in larger batches, here alone."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df = bounded(df if rows is None else df.coalesce(1 + rows // FILE_ROWS))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        df.write.parquet(path)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that no later step reads."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with a column `name` of numbers 0, 1, 2 ... in that order: ranges of it are sorted in tasks of their own and written, then each begins where the counts of those before end."""
    at, _ = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    split = at.withColumn("_part", F.shiftright("_at", 33))
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    based = split.join(split.groupBy("_part").count().select("_part", before.alias("_before")), "_part")
    return based.withColumn(name, F.col("_before") + F.col("_at") - F.shiftleft("_part", 33)).drop("_at", "_part", "_before")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and whole text alone, the text never null: extra columns, whatever their names, stay outside."""
    return bounded(docs).select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each Arrow batch in runs of rows of about `most` bytes of text (a longer text alone in its run), with the texts as UTF-8."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        n, at = batch.num_rows, 0
        if not n:
            continue
        ends = np.cumsum(np.asarray(pa.compute.binary_length(col).fill_null(0), dtype=np.int64))
        while at < n:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(at, to - at), [x or b"" for x in col.slice(at, to - at).cast(pa.large_binary()).to_pylist()]
            at = to


class Memo(dict):
    """What make(key) gives, kept in a worker for so many keys and the generation before them."""

    def __init__(self, make: Callable, kept: int = KEPT):
        self.make, self.kept, self.before = make, kept, {}

    def turn(self) -> None:
        """Begin a new generation if this one is full."""
        if len(self) > self.kept:
            self.before = dict(self)
            self.clear()

    def __missing__(self, key):
        v = self[key] = self.before[key] if key in self.before else self.make(key)
        return v


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX_A
        x = (x ^ (x >> np.uint64(27))) * MIX_B
        return x ^ (x >> np.uint64(31))
