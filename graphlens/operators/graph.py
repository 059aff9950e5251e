"""The property graph: nodes and edges from the tables, first wins, and its statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.operators.dedupe import first_wins


def distinct_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each id, the first by ord."""
    return first_wins(nodes, ["id"], ["ord", "type", "label"])


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One row for each (src, dst, kind, label), the first by ord, with call_count: how many there were."""
    keys = ["src", "dst", "kind", "label"]
    rest = [c for c in edges.columns if c not in keys]
    keyed = edges.withColumn("label", F.coalesce("label", F.lit("")))
    # One aggregate gives both, in one shuffle with partial results before it.
    made = keyed.groupBy(*keys).agg(F.min(F.struct("ord", *[c for c in rest if c != "ord"])).alias("_first"), F.count("*").alias("call_count"))
    return made.select(*keys, *(F.col(f"_first.{c}").alias(c) for c in rest), "call_count")


def degree_by_type(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(type, nodes, degree): how many nodes of a type there are and how many ends of edges they have."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").alias("d"))
    return nodes.join(ends, "id", "left").groupBy("type").agg(F.count("*").alias("nodes"), F.sum(F.coalesce("d", F.lit(0))).alias("degree"))


def file_nodes(files: DataFrame) -> DataFrame:
    return files.where("not is_config").select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("file").alias("type"), F.col("path").alias("label"), "path", "language", F.lit(0).alias("ord"))


def _wide(df: DataFrame) -> DataFrame:
    return df.select("id", "type", "label", F.col("path") if "path" in df.columns else F.lit(None).cast("string").alias("path"), F.col("language") if "language" in df.columns else F.lit(None).cast("string").alias("language"), "ord")


def assemble(files: DataFrame, definitions: DataFrame, imports: DataFrame, edges: DataFrame, matches: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the property graph: files, definitions, modules that call, external services and configuration files; contains, imports, calls, calls_external and configured_in. The first row of an id or of (src, dst, kind, label) wins; edges whose ends are missing and calls of itself are left out."""
    defs = definitions.select(F.concat(F.lit("def:"), "qualified_name").alias("id"), F.col("kind").alias("type"), F.col("name").alias("label"), F.col("file").alias("path"), F.lit(1).alias("ord"))
    modules = edges.where(F.col("caller").endswith("::<module>")).select(F.concat(F.lit("def:"), "caller").alias("id"), F.lit("module").alias("type"), F.col("file").alias("label"), F.col("file").alias("path"), F.lit(2).alias("ord")).distinct()
    outside = edges.where("status = 'external_candidate'")
    service = F.concat(F.lit("ext:"), F.coalesce("host", F.concat(F.lit("unresolved:"), "external_pattern")))
    services = outside.select(service.alias("id"), F.lit("external").alias("type"), F.coalesce("host", "external_pattern").alias("label"), F.lit(3).alias("ord")).distinct()
    nodes = _wide(file_nodes(files)).unionByName(_wide(defs)).unionByName(_wide(modules)).unionByName(_wide(services))
    number = lambda c: F.lpad(F.coalesce(F.col(c).cast("string"), F.lit("")), 10, "0")
    place = lambda df, k: F.concat_ws("/", F.lit(str(k)), *[F.col(c) if c == "file" else number(c) for c in ("file", "line", "ord") if c in df.columns])
    row = lambda df, src, dst, kind, label, line, note, ord_: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), label.alias("label"), line.alias("line"), note.alias("detail"), place(df, ord_).alias("ord"))
    blank, none = F.lit(""), F.lit(None).cast("int")
    of = lambda p, c: F.concat(F.lit(p), F.col(c))
    contains = row(definitions, of("file:", "file"), of("def:", "qualified_name"), "contains", blank, F.col("start_line"), blank, 0)
    contains = contains.unionByName(row(edges.where(F.col("caller").endswith("::<module>")), of("file:", "file"), of("def:", "caller"), "contains", blank, none, blank, 1))
    stem = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^(.+?)(?:\.[^.]*)?$", 1)
    targets = files.where("not is_config").groupBy(stem.alias("stem")).agg(F.min("path").alias("target"), F.sort_array(F.collect_set("path")).alias("all"))
    wanted = imports.withColumn("stem", F.element_at(F.split(F.replace("raw", F.lit("."), F.lit("/")), "/"), -1))
    linked = wanted.join(targets, "stem").withColumn("target", F.get(F.filter("all", lambda p: p != F.col("file")), F.lit(0))).where("target is not null")
    linked = row(linked, of("file:", "file"), of("file:", "target"), "imports", F.col("raw"), F.col("line"), blank, 2)
    inner = edges.where("status = 'internal'").withColumn("target", F.get("resolved_targets", F.lit(0))).where("target <> caller")
    calls = row(inner, of("def:", "caller"), of("def:", "target"), "calls", blank, F.col("line"), F.coalesce("resolved_via", blank), 3)
    note = F.concat_ws(" | ", "literal_method", F.when(F.col("needs_review"), F.concat(F.lit("needs review: "), F.coalesce("review_reason", F.lit(""))))) if "needs_review" in edges.columns else blank
    out = row(outside, of("def:", "caller"), service, "calls_external", F.col("external_pattern"), F.col("line"), note, 4)
    parts = [contains, linked, calls, out]
    if matches is not None:
        hits = matches.select("call_id", "path", F.col("key_path"), F.concat_ws("/", "kind", "confidence").alias("how")).join(outside, "call_id")
        nodes = nodes.unionByName(_wide(matches.select(F.concat(F.lit("cfg:"), "path").alias("id"), F.lit("config").alias("type"), F.col("path").alias("label"), "path", F.lit(4).alias("ord")).distinct()))
        parts.append(row(hits, service, of("cfg:", "path"), "configured_in", F.col("key_path"), none, F.col("how"), 5))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    nodes = distinct_nodes(nodes)
    ids = nodes.select("id")
    all_ = all_.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes.drop("ord"), distinct_edges(all_).drop("ord")
