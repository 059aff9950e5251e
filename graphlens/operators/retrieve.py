"""Embedding, indexing and question answering over chunks, with injected models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.operators.chunks import retrieval_context
from graphlens.operators.knn import nearest

#: Texts of a batch, and neighbours of a question. Fixed values.
BATCH, K = 64, 8

Embed = Callable[[list[str]], list[list[float]]]


def hashed_words(texts: list[str], size: int = 256) -> list[list[float]]:
    """A stand-in where no model is given: counts of words by a fixed hash, of length 1."""
    import zlib

    out = np.zeros((len(texts), size))
    for k, x in enumerate(texts):
        for w in x.lower().split():
            out[k, zlib.crc32(w.encode()) % size] += 1
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()


def embed(chunks: DataFrame, model: Embed = hashed_words) -> DataFrame:
    """chunks plus embedding array<float> of length 1, in batches; a model loads once in a worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made: list[list[float]] = []
            for i in range(0, len(pdf), BATCH):
                made += model(list(pdf["code"].iloc[i : i + BATCH]))
            v = np.asarray(made, float).reshape(len(pdf), -1)
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield pdf.assign(embedding=list(v.astype(np.float32)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)
    return chunks.mapInPandas(run, f"{fields}, embedding array<float>")


def ask(spark: SparkSession, index: DataFrame, question: str, model: Embed = hashed_words, k: int = K, answer: Callable[[str, str], str] | None = None) -> dict:
    """The k nearest chunks of a question, their context, and an answer from it if there is a generator."""
    q = spark.createDataFrame([("q", [float(x) for x in model([question])[0]])], "query_id string, query array<double>")
    found = nearest(index.select("id", "embedding"), q, k).join(index.drop("embedding"), "id")
    rows = found.orderBy("rank").select("id", "path", "start_line", "end_line", "distance").collect()
    context = retrieval_context(found).select("context").collect()
    text = context[0].context if context else ""
    return {"sources": [r.asDict() for r in rows], "context": text, "answer": answer(question, text) if answer else None}
