"""Where an external call goes: literals, constants set above the call, data-flow results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.functions.args import classify, first_argument, identifier_roots, string_literal_value
from graphlens.functions.hosts import env_key, is_plausible_host, literal_text, static_host, url_authority
from graphlens.functions.text import append_note
from graphlens.operators.joins import asof_before


def literals(edges: DataFrame) -> DataFrame:
    """External candidates whose first argument is a literal get literal, literal_method and host (the authority of a URL, else the body itself); literal_reason says why an interpolated one has none. Adds argument and shape."""
    made = edges.withColumn("argument", F.when(F.col("status") == "external_candidate", first_argument("arg_text"))).withColumn("shape", F.when(F.col("argument").isNotNull(), classify(F.col("argument"))))
    made = made.withColumn("_body", F.when(F.col("argument").isNotNull(), string_literal_value(F.col("argument"))))
    made = made.withColumn("_static", static_host("argument", "_body"))
    ok = F.col("_body").isNotNull() & F.col("_static.reason").isNull()
    made = made.withColumn("literal", F.when(ok, F.col("_body"))).withColumn("literal_method", F.when(ok, "literal")).withColumn("host", F.when(ok, F.coalesce(F.col("_static.host"), F.nullif("_body", F.lit("")))))
    return made.withColumn("literal_reason", F.when(F.col("_body").isNotNull(), F.col("_static.reason"))).drop("_body", "_static")


def constants(edges: DataFrame, assignments: DataFrame) -> DataFrame:
    """External candidates without a literal whose argument names a variable: the last assignment above the call in its file, of the first name (by rank) whose last assignment is a usable string. Adds constprop_name.

    An as-of join by file and name for each candidate name, which makes no pair of a use and an assignment; then the best rank.
    """
    todo = edges.where("status = 'external_candidate' and coalesce(literal, '') = ''").select("call_id", "file", "line", F.posexplode(F.filter(identifier_roots(F.col("argument")), lambda x: ~x.contains("."))).alias("rank", "name"))
    # Of a line, uses come before all assignments.
    uses = todo.select("file", "name", F.struct("line", F.lit(-1).alias("ord")).alias("at"), F.struct("call_id", "rank").alias("use"))
    sets = assignments.select("file", "name", F.struct("line", "ord").alias("at"), F.struct("value", F.col("host").alias("set_host")).alias("s"))
    last = asof_before(uses, sets, ["file", "name"], "at", "s", "use").where("s.value is not null")
    best = last.groupBy("use.call_id").agg(F.min_by(F.struct("name", "s.value", "s.set_host"), "use.rank").alias("_s"))
    made = edges.join(best, "call_id", "left")
    hit = F.col("_s").isNotNull()
    for column, value in (("literal", F.col("_s.value")), ("literal_method", F.lit("const_prop")), ("host", F.col("_s.set_host"))):
        made = made.withColumn(column, F.when(hit, value).otherwise(F.col(column)))
    return made.withColumn("constprop_name", F.col("_s.name")).drop("_s")


def flows(edges: DataFrame, results: DataFrame | None) -> DataFrame:
    """External candidates without a host, by data-flow results (file, line, flows): one distinct plausible literal is the host; else an environment variable, then a parameter, is the source and the call needs review. Adds flow_source_kind, flow_source, flow_conditions, needs_review, review_reason.

    Without results every such call is noted as not traced.
    """
    open_ = (F.col("status") == "external_candidate") & F.col("host").isNull()
    base = edges.withColumn("needs_review", F.lit(False)).withColumn("review_reason", F.lit(None).cast("string"))
    blank = F.lit(None).cast("string")
    if results is None:
        made = base.withColumn("flow_source_kind", blank).withColumn("flow_source", blank).withColumn("flow_conditions", F.array().cast("array<string>"))
        return made.withColumn("review_reason", F.when(open_, append_note(F.col("review_reason"), F.lit("data flow was not traced"))).otherwise(F.col("review_reason")))
    one = results.groupBy("file", "line").agg(F.flatten(F.collect_list("flows")).alias("_flows"))
    made = base.join(one, ["file", "line"], "left").withColumn("_flows", F.when(open_, F.col("_flows")))
    code = lambda kind: F.transform(F.filter("_flows", lambda f: f["kind"] == kind), lambda f: f["source"]["code"])
    texts = F.array_distinct(F.filter(F.transform(code("literal"), literal_text), is_plausible_host))
    keys = F.array_distinct(F.array_compact(F.transform(code("env"), env_key)))
    made = made.withColumn("_texts", texts).withColumn("_keys", keys).withColumn("_params", F.array_distinct(code("parameter")))
    single = F.size("_texts") == 1
    kind = F.when(F.size("_texts") > 0, "literal").when(F.size("_keys") > 0, "env").when(F.size("_params") > 0, "parameter")
    source = F.when(kind == "literal", F.get("_texts", F.lit(0))).when(kind == "env", F.get("_keys", F.lit(0))).when(kind == "parameter", F.get("_params", F.lit(0)))
    made = made.withColumn("flow_source_kind", kind).withColumn("flow_source", source)
    made = made.withColumn("flow_conditions", F.coalesce(F.array_distinct(F.flatten(F.transform("_flows", lambda f: F.transform(f["conditions"], lambda c: c["code"])))), F.array().cast("array<string>")))
    value = F.get("_texts", F.lit(0))
    made = made.withColumn("literal", F.when(open_ & single, value).otherwise(F.col("literal"))).withColumn("literal_method", F.when(open_ & single, "joern").otherwise(F.col("literal_method")))
    note = F.when(F.size("_texts") > 1, "several hosts reach the call").when(kind == "env", F.concat(F.lit("host comes from the environment variable "), source)).when(kind == "parameter", F.concat(F.lit("host comes from the parameter "), source)).when(open_ & kind.isNull(), "no source reaches the call").when(open_ & single & (F.size("flow_conditions") > 0), "the host depends on conditions")
    made = made.withColumn("host", F.when(open_ & single, F.coalesce(url_authority(value), value)).otherwise(F.col("host")))
    made = made.withColumn("needs_review", F.col("needs_review") | (open_ & note.isNotNull())).withColumn("review_reason", F.when(open_, append_note(F.col("review_reason"), note)).otherwise(F.col("review_reason")))
    return made.drop("_flows", "_texts", "_keys", "_params")
