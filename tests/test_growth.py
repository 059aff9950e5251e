"""Tables of many rows behind few: what joins make of them, and what is broadcast."""

import time

from pyspark.sql import functions as F

from graphlens.operators import dataflow, extract, resolve


def rows_made(spark, df, node: str) -> int:
    """The most rows that an operator of this kind made while df ran."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    df.write.format("noop").mode("overwrite").save()
    for _ in range(50):
        last = store.executionsList().last()
        if store.executionsCount() > before and last.completionTime().isDefined() and last.metricValues() is not None:
            break
        time.sleep(0.1)
    values, nodes, most = store.executionMetrics(last.executionId()), store.planGraph(last.executionId()).allNodes(), 0
    for k in range(nodes.size()):
        metrics = nodes.apply(k).metrics()
        for m in range(metrics.size()):
            value = values.get(metrics.apply(m).accumulatorId())
            if node in nodes.apply(k).name() and metrics.apply(m).name() == "number of output rows" and value.isDefined():
                most = max(most, int(value.get().replace(",", "")))
    return most


def _calls(spark, n: int):
    file = F.concat(F.lit("f"), F.col("id") % 5)
    return resolve.with_call_id(spark.range(n).select(F.lit("m").alias("caller"), F.when(F.col("id") % 2 == 0, "x.g").otherwise("g").alias("callee_expr"), file.alias("file"), F.col("id").cast("int").alias("callee_line"), F.lit(1).alias("callee_col"), F.col("id").cast("int").alias("ord")))


def _definitions(spark, n: int, names: int):
    """n rows that Spark takes for a few: they come from one row by a generator."""
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    made = spark.range(1).select(k.alias("k")).withColumn("name", F.concat(F.lit("g"), (F.col("k") % names).cast("string")))
    return made.select(F.concat(F.lit("d::"), "name").alias("qualified_name"), "name", F.lit("d").alias("file"), F.col("k").cast("int").alias("ord"), (F.col("k") % names).cast("int").alias("name_line"), F.lit(1).alias("name_col"))


def test_repeated_definitions_of_a_place_meet_a_call_once(spark):
    calls, definitions = _calls(spark, 300), _definitions(spark, 2000, 10)  # each definition 200 times
    refs = calls.select("file", F.col("callee_line").alias("line"), F.lit(1).alias("col"), F.lit("d").alias("def_file"), (F.col("ord") % 12).alias("def_line"), F.lit(1).alias("def_col"))
    edges = resolve.resolve(calls, definitions, refs, calls.select("file"))
    assert rows_made(spark, edges, "Join") <= 300
    got = {r.ord: r for r in edges.collect()}
    assert len(got) == 300 and all(r.resolved_targets == ([f"d::g{k % 12}"] if k % 12 < 10 else []) and r.unmapped_def_files == ([] if k % 12 < 10 else ["d"]) for k, r in got.items())


def test_no_table_of_definitions_or_references_is_broadcast(spark):
    calls, definitions = _calls(spark, 300), _definitions(spark, 20000, 20000)
    refs = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(19999))).alias("line")).select(F.lit("f1").alias("file"), "line", F.lit(1).alias("col"), F.lit("d").alias("def_file"), F.lit(7).alias("def_line"), F.lit(1).alias("def_col"))
    assert rows_made(spark, resolve.resolve(calls, definitions, refs, calls.select("file").where("file = 'f1'")), "BroadcastExchange") <= 300
    assert rows_made(spark, resolve.resolve(calls, definitions), "BroadcastExchange") <= 300


def test_gaps_count_a_lost_place_once_for_each_call(spark):
    calls, definitions = _calls(spark, 300), _definitions(spark, 2000, 10)
    refs = calls.select("file", F.col("callee_line").alias("line"), F.lit(1).alias("col"), F.lit("d").alias("def_file"), (F.col("ord") % 12).alias("def_line"), F.lit(1).alias("def_col"))
    files = spark.createDataFrame([("d", "too_large")], "path string, skip_reason string")
    gaps = resolve.unmapped_gaps(resolve.resolve(calls, definitions, refs, calls.select("file")), files)
    assert rows_made(spark, gaps, "Join") <= 300
    assert [(r.path, r["count"], r.detail) for r in gaps.collect()] == [("d", 50, "too_large")]


def test_no_table_of_facts_is_broadcast(spark):
    k = F.explode(F.sequence(F.lit(0), F.lit(999)))
    text = F.concat(F.lit("def go(u):\n    http.get(u)\ngo('h"), "k", F.lit(".example.com')\n"))
    files = spark.range(1).select(k.alias("k")).select(F.concat(F.lit("f"), "k", F.lit(".py")).alias("path"), text.alias("text"), F.lit("python").alias("language"), F.lit(False).alias("skipped"), F.lit(False).alias("is_config"))
    found = extract.tables(extract.extracted(files))
    edges = resolve.resolve(resolve.with_call_id(found["calls"]), found["definitions"])
    edges = edges.withColumn("status", F.when(F.col("callee_expr") == "http.get", "external_candidate").otherwise(F.col("status"))).withColumn("host", F.lit(None).cast("string"))
    assert rows_made(spark, dataflow.linked(dataflow.facts(files), edges), "BroadcastExchange") <= 300
    results = dataflow.results(files, edges)
    assert rows_made(spark, results, "BroadcastExchange") <= 300
    got = {r.file: [f.source.code for f in r.flows] for r in results.collect()}
    assert got == {f"f{n}.py": [f"'h{n}.example.com'"] for n in range(1000)}


def test_a_round_above_the_limit_is_merged(spark, monkeypatch):
    monkeypatch.setattr(dataflow, "FEW", 1)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "node int, other int")
    starts = spark.createDataFrame([("a", 1), ("b", 4)], "start string, node int")
    assert sorted(tuple(r) for r in dataflow.reached(starts, edges).collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 4), ("b", 5)]
