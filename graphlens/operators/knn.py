"""Exact nearest chunks by cosine distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.round(1 - F.round(dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)), 5), 5)


#: Rows of a block of items and of one of queries; queries up to so many are sent to all tasks; what two ways of summing and rounding may differ by.
ITEMS, QUERIES, FEW, SLACK = 4096, 256, 4096, 2e-5


def nearest(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """items(id, embedding), queries(query_id, query) -> (query_id, id, distance, rank): for each query the k nearest items, ties to the smaller id.

    Both sides go in blocks, whose products are matrix products; of a pair of blocks a query keeps its k best and what may tie with them by
    rounding, so each block of items is a few rows for a query before anything is merged. Items meet the query blocks by number: by a broadcast up to
    FEW queries, else by a shuffle. Vectors that are null, zero or hold no finite number take no part, nor do those of another length than
    the query's. No item or no query gives no row.
    """
    id_type, query_type = items.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    n = queries.count()

    def usable(df: DataFrame, v: str) -> DataFrame:
        d = df.withColumn("v", F.col(v).cast("array<double>"))
        return d.where("v is not null").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(2))
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                for at in range(0, len(own), ITEMS):
                    part = batch.take(pa.array(own[at : at + ITEMS]))
                    m = np.asarray(part.column(1).flatten()).astype(float)
                    yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(part.column(0).type)), pa.array([m.tobytes()], pa.binary()), pa.array([dim], pa.int32())], names=["ids", "m", "dim"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, m, asked, dim in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3).to_pylist(), strict=True):
                x = np.frombuffer(m.as_buffer()).reshape(-1, dim)
                q = np.array([a["v"] for a in asked.as_py()])
                near = (q @ x.T) / np.sqrt(np.outer((q * q).sum(1), (x * x).sum(1)))
                least = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(q), -np.inf)
                rows, cols = np.nonzero(near >= (least - SLACK)[:, None])
                yield pa.RecordBatch.from_arrays([asked.values.field("query_id").take(pa.array(rows)), ids.values.take(pa.array(cols)), pa.array(near[rows, cols])], names=["query_id", "id", "near"])

    count = max(1, -(-n // QUERIES))
    asked = usable(queries, "query").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(count))).groupBy("dim", "block").agg(F.collect_list(F.struct("query_id", "v")).alias("asked"))
    made = usable(items, "embedding").select("id", "v", "dim").mapInArrow(blocks, f"ids array<{id_type}>, m binary, dim int").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    pairs = made.join(F.broadcast(asked) if n <= FEW else asked, ["dim", "block"]).select("ids", "m", "asked", "dim")
    found = pairs.mapInArrow(best, f"query_id {query_type}, id {id_type}, near double").select("query_id", "id", F.round(1 - F.round("near", 5), 5).alias("distance"))
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
