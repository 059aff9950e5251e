"""Incremental extraction as a stream."""

from graphlens.schema import FILES
from graphlens.streaming import incremental


def test_later_batches_replace_a_file_s_rows(spark, tmp_path):
    files, out, check = (str(tmp_path / n) for n in ("files", "out", "check"))

    def add(*rows):
        spark.createDataFrame([(p, "python", False, t, len(t), False, None, None) for p, t in rows], FILES).write.mode("append").parquet(files)
        incremental.extract_stream(incremental.file_stream(spark, files), out, check).awaitTermination(60)

    add(("a.py", "def f(): pass"), ("b.py", "def g(): pass"))
    add(("a.py", "def h(): pass"))
    got = {(r.file, r.b) for r in incremental.latest(spark, out).where("what = 'definition'").collect()}
    assert got == {("a.py", "h"), ("b.py", "g")}
