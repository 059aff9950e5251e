"""Registered queries: their names, and SQL beside the operator."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from graphlens.llm import catalog


def test_names():
    names = list(catalog.queries())
    assert [n for n in names if n != "pipeline"] == sorted((n for n in names if n != "pipeline"), key=lambda n: int(n[2:].split("_")[0])) and len(names) == 14
    assert set(names) <= set(__spark_entry__.queries()) and set(catalog.oracle_sql()) <= set(names)
    assert len(corpus_pipeline.STAGES) == 4 and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", ["op12_phrases", "op13_audit"])
def test_beside_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    want = db.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, "/root/testdata/sf0.01").select(*want.columns).collect()
    assert sorted(tuple(r) for r in got) == sorted(want.fetchall()) and got


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_repeats_beside_sql(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    want = sorted(db.execute(catalog.oracle_sql()["op5_repeats"]).fetchall())
    got = sorted(tuple(r) for r in catalog.op5_repeats(spark, f"/root/testdata/{sf}").select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == want and sum(r[2] for r in got) > 0
