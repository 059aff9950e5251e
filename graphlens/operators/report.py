"""Reports of a run: counters from the reasons on edges, percentages, what is left and why."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.functions.args import head_name
from graphlens.operators.aggregates import breakdown, most_common
from graphlens.operators.gaps import summary
from graphlens.operators.resolve import possible_misses


def stage_counters(edges: DataFrame) -> DataFrame:
    """(key, n): how the stages dealt with calls, from the columns they left. One pass over the edges."""
    external = F.col("status") == "external_candidate"

    def key(prefix: str, c: Column) -> Column:
        return F.concat(F.lit(prefix), c.cast("string"))

    keys = [
        key("resolve.", F.col("status")), key("resolve.via.", F.col("resolved_via")), key("external.via.", F.col("external_via")), key("external.pattern.", F.col("external_pattern")),
        key("external.shape.", F.col("shape")), key("literal.bail.", F.col("literal_reason")), key("method.", F.col("literal_method")), key("flow.", F.col("flow_source_kind")),
        key("infer.", F.col("inference_grounding")), F.when(external & F.col("needs_review"), F.lit("needs_review")), F.when(external & F.col("host").isNull(), F.lit("external.without_host")), F.when(F.col("hinted"), F.lit("external.hinted")),
    ]
    return edges.select(F.explode(F.array_compact(F.array(*keys))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def match_counters(matches: DataFrame) -> DataFrame:
    """(kind, confidence, n) of configuration matches, each once by kind, by confidence and in all (null: all)."""
    return matches.groupingSets([[F.col("kind"), F.col("confidence")], [F.col("confidence")], []], "kind", "confidence").agg(F.count("*").alias("n"))


def quality_report(edges: DataFrame, definitions: DataFrame, gaps: DataFrame, top: int = 10) -> dict[str, DataFrame]:
    """statuses with percentages, the commonest roots of unresolved calls, unresolved calls that some definition's name fits, gaps by kind."""
    open_ = edges.where("status = 'unresolved'").select(head_name(F.col("callee_expr")).alias("root"))
    return {"statuses": breakdown(edges, "status"), "unresolved_roots": most_common(open_, "root", top), "possible_misses": possible_misses(edges, definitions), "gaps": summary(gaps)}


def index_totals(files: DataFrame, occurrences: DataFrame, references: DataFrame) -> DataFrame:
    """One row of an index's totals: files and languages it has, those it lacks, references."""
    has = occurrences.select(F.col("file").alias("path")).distinct().withColumn("has", F.lit(True))
    code = files.where("not is_config and language <> 'other'").join(has, "path", "left")
    made = code.agg(F.count_if(F.col("has")).alias("files_indexed"), F.count_if(F.col("has").isNull()).alias("files_missing"), F.array_sort(F.collect_set(F.when(F.col("has"), F.col("language")))).alias("languages"), F.array_sort(F.array_except(F.collect_set("language"), F.collect_set(F.when(F.col("has"), F.col("language"))))).alias("languages_missing"))
    return made.join(references.agg(F.count("*").alias("references")), F.lit(True))


def workspaces(runs: dict[str, DataFrame]) -> DataFrame:
    """(workspace, edges, needs_review, external) over the edges of several runs."""
    rows = reduce(DataFrame.unionByName, (e.select(F.lit(name).alias("workspace"), "status", "needs_review") for name, e in runs.items()))
    return rows.groupBy("workspace").agg(F.count("*").alias("edges"), F.count_if("needs_review").alias("needs_review"), F.count_if(F.col("status") == "external_candidate").alias("external"))
