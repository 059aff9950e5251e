"""The pipeline's stages, and all of it against a brute-force version."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_similar import slow_components
from test_tokens import check_packing
from tokenizers import Tokenizer

import corpus_pipeline
from graphlens.llm import quality, repeats

DIR = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    score = model.numpy(np.array([quality.statistics(x.encode()) for _, x in rows]))
    rows = [r for r, s in zip(rows, score, strict=True) if s >= 0.3]
    comp = slow_components(rows)
    rows = [r for r, c in zip(rows, comp, strict=True) if r[0] == c]
    want_rows = list(zip(rows, repeats.brute_force(rows), strict=True))
    now = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        now = spark.createDataFrame(stage(spark, now, DIR).collect(), docs.schema)
    kept = {r.doc_id: r.text for r in now.collect()}
    # Every text: the kept words of those that lost some, and the others as they were.
    for (d, x), (_, _, gone, digest) in want_rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", kept[d] or "")
        assert hashlib.sha256(" ".join(words).encode()).hexdigest() == digest and (gone or (kept[d] or "") == x)
    assert sum(gone > 0 for _, (_, _, gone, _) in want_rows) > 3
    left = [(d, kept[d] or "") for (d, _), _ in want_rows]
    got = corpus_pipeline.run(spark, DIR).collect()
    check_packing(got, 2048)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {d for d, _ in left} == set(kept) and len(left) > 100
    for d, x in left:
        own = sorted(by[d], key=lambda r: r.piece)
        want = np.array([*library.encode(x, add_special_tokens=False).ids, 0], "<u4")
        assert [zlib.crc32(want[r.start : r.start + r.length].tobytes()) for r in own] == [r.ids_crc32 for r in own] and sum(r.length for r in own) == len(want)
    assert len({r.sequence_id for r in got}) <= -(-sum(r.length for r in got) // 2048) + 1


def test_stages_keep_the_columns_and_clean_rows(spark):
    base = spark.read.parquet(f"{DIR}/documents.parquet")
    docs = base.withColumn("spans", F.lit(1)).withColumn("log_words", F.lit("x")).withColumn("component_id", F.lit(2.0))
    docs = docs.unionByName(docs.where("doc_id < 3")).unionByName(docs.where("doc_id in (4, 5)").withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(None).cast("string")))
    names = docs.schema.names
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DIR).collect(), docs.schema)
        assert docs.schema.names == names, name
    assert docs.where("doc_id is null").count() == 2
    assert docs.where("doc_id is not null").count() == docs.where("doc_id is not null").select("doc_id").distinct().count()
    assert docs.where("n_chars <> length(text)").count() == 0


def test_near_duplicate_stage_drops_near_copies_alone(spark):
    words = [f"w{i}" for i in range(100)]
    near, far, copy = " ".join([*words[:50], "other", *words[51:]]), " ".join(words[:50] + [f"x{i}" for i in range(50)]), "\n".join(words).upper()
    rows = [(5, " ".join(words)), (6, near), (3, copy), (7, far), (7, "quite another text of this id"), (7, far), (8, "quite another text of this id"), (None, near)]
    docs = spark.createDataFrame([(d, x, "a", 1) for d, x in rows], "doc_id long, text string, component_id string, __digest int")
    got = corpus_pipeline.near_duplicate_filter(spark, docs.withColumnRenamed("__digest", "digest"), DIR)
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted([(3, copy), (7, far), (7, "quite another text of this id"), (0, near)])
    assert got.columns == ["doc_id", "text", "component_id", "digest"]


def test_repeat_stage_cuts_long_repeats_alone(spark):
    passage, other = " ".join(f"p{i}" for i in range(60)), " ".join(f"q{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"{passage}\nend", 1), (2, f"start\n {passage} tail", 1), (3, f"{other}\n{other}", 1), (4, f"z {other}", 1), (5, None, 1)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.repeat_filter(spark, docs, DIR).collect()}
    assert got[2] == ("start tail", 10) and got[1][0] == f"{passage}\nend" and got[3][0] == f"{other}\n{other}" and got[4][0] == f"z {other}" and got[5][0] is None


def test_empty_table(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DIR).collect(), docs.schema)
    assert corpus_pipeline.packed(spark, docs, DIR).count() == 0


@pytest.mark.parametrize("k", range(4))
def test_stages_are_named(k):
    name, stage = corpus_pipeline.STAGES[k]
    assert isinstance(name, str) and callable(stage)
