"""Which definition a call means: positions from an index where there is one, names else; and which calls go outside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.functions.args import enclosing_class, head_name, tail_name
from graphlens.operators.joins import first_pattern, preferred_targets

#: Calls of client libraries by the whole callee, in the order in which they win. Fixed values.
CLIENT_PATTERNS = (
    (r"^requests\.(get|post|put|delete|patch|head|request)$", "python-requests"),
    (r"^requests\.Session$", "python-requests"),
    (r"^httpx\.(get|post|put|delete|patch|request|Client|AsyncClient)$", "python-httpx"),
    (r"^urllib\.request\.urlopen$", "python-urllib"),
    (r"^http\.client\.HTTPS?Connection$", "python-http.client"),
    (r"^aiohttp\.ClientSession$", "python-aiohttp"),
    (r"^boto3\.client$", "aws-sdk"),
    (r"^fetch$", "js-fetch"),
    (r"^axios\.(get|post|put|delete|patch|request)$", "js-axios"),
    (r"^axios$", "js-axios"),
    (r"^\$\.ajax$", "js-jquery"),
    (r"^(http|https)\.request$", "node-http"),
    (r"^(http|https)\.get$", "node-http"),
    (r"^superagent\.(get|post|put|delete)$", "js-superagent"),
    (r"^grpc\.Client$", "grpc-client"),
    (r"^(HttpClient|RestTemplate|OkHttpClient)$", "java-http-client"),
    (r"^http\.(Get|Post|NewRequest)$", "go-net-http"),
    (r"^resty\.New$", "go-resty"),
    (r"^(Net::HTTP)$", "ruby-net-http"),
)
#: Libraries of network clients that the catalogue lacks; their calls are counted, not taken for external. Fixed values.
CLIENT_HINTS = (
    "smtplib", "smtp", "firestore", "firebase_admin", "boto3", "psycopg2", "pymongo", "redis", "kafka", "sqlalchemy", "elasticsearch", "grpc",
    "websocket", "websockets", "ftplib", "paramiko", "urllib3", "httplib2", "google.cloud", "azure", "stripe", "twilio", "sendgrid", "openai",
)


def with_call_id(calls: DataFrame) -> DataFrame:
    """calls plus call_id: file and place in it, since one line may hold several calls."""
    return calls.withColumn("call_id", F.concat_ws("#", "file", F.col("ord").cast("string")))


def _indexed(hits: DataFrame, d: DataFrame) -> DataFrame:
    """(call_id, scip_targets, unmapped) of calls with the places that an index gives: distinct target names in the order of the definitions, null if
    there are none, and the distinct files of places where no definition is.

    A name that is defined more than once at a place counts once before the join, so a call meets each of its targets once, however often that is repeated.
    """
    once = d.groupBy("qualified_name", "def_file", "name_line", "name_col").agg(F.min("def_ord").alias("def_ord"))
    here = (F.col("at_file") == F.col("def_file")) & (F.col("def_line") == F.col("name_line")) & (F.col("def_col") == F.col("name_col"))
    known = hits.join(once.hint("merge"), here, "left").select("call_id", "qualified_name", "def_file", "def_ord", F.when(F.col("qualified_name").isNull(), F.col("at_file")).alias("lost"))
    rows = known.groupBy("call_id", "qualified_name", "lost").agg(F.min(F.struct("def_file", "def_ord")).alias("at"))
    there = F.when(F.col("qualified_name").isNotNull(), F.struct("at", "qualified_name"))
    made = rows.groupBy("call_id").agg(F.array_sort(F.collect_list(there)).alias("_t"), F.array_sort(F.collect_list("lost")).alias("unmapped"))
    return made.select("call_id", F.when(F.size("_t") > 0, F.transform("_t", lambda x: x["qualified_name"])).alias("scip_targets"), "unmapped")


def resolve(calls: DataFrame, definitions: DataFrame, scip_refs: DataFrame | None = None, scip_covered: DataFrame | None = None, tail_names: bool = False) -> DataFrame:
    """calls(with call_id) -> edges: plus status, resolved_via, resolved_targets, unmapped_def_files.

    In a file that the index covers its references decide: a position with definitions that the parser has too is internal, one with other
    definitions internal_unmapped. Elsewhere a bare name of the same file, or self.x in its class, is internal (lexical_fallback); with tail_names
    also any definition of the last part of the name, those of the same file first. The rest is unresolved. Provider tables may be missing.
    Tables that grow with calls or definitions are merged, not broadcast: Spark's guess of their size is far too low behind Python's rows or short columns.
    """
    d = definitions.select("qualified_name", "name", F.col("file").alias("def_file"), F.col("ord").alias("def_ord"), "name_line", "name_col")
    c = calls.select("call_id", "file", "caller", "callee_expr", "callee_line", "callee_col")
    base = calls
    if scip_refs is not None and scip_covered is not None:
        refs = scip_refs.select("file", F.col("line").alias("callee_line"), F.col("col").alias("callee_col"), F.col("def_file").alias("at_file"), "def_line", "def_col")
        hits = c.join(scip_covered.select("file").distinct(), "file", "left_semi").join(refs.hint("merge"), ["file", "callee_line", "callee_col"])
        covered = scip_covered.select("file").distinct().withColumn("covered", F.lit(True))
        base = base.join(covered, "file", "left").join(_indexed(hits.select("call_id", "at_file", "def_line", "def_col"), d).hint("merge"), "call_id", "left")
    else:
        none = F.lit(None).cast("array<string>")
        base = base.withColumn("covered", F.lit(None).cast("boolean")).withColumn("scip_targets", none).withColumn("unmapped", none)
    bare = ~F.col("callee_expr").contains(".")
    own = F.when(head_name(F.col("callee_expr")).isin("self", "cls", "this") & (F.size(F.split("callee_expr", "[.]")) == 2), enclosing_class(F.col("caller")))
    wanted = F.when(bare, F.concat("file", F.lit("::"), "callee_expr")).when(own.isNotNull(), F.concat("file", F.lit("::"), own, F.lit("."), tail_name(F.col("callee_expr"))))
    names = d.groupBy("qualified_name").agg(F.min("def_ord").alias("_o")).select(F.col("qualified_name").alias("_wanted"), F.lit(True).alias("_wants"), F.lit(True).alias("_there"))
    # Calls that want no name are dealt by their own ids, not all to one task; the flag keeps those from names.
    base = base.withColumn("_wants", wanted.isNotNull()).withColumn("_wanted", F.coalesce(wanted, F.col("call_id")))
    base = base.join(names.hint("merge"), ["_wanted", "_wants"], "left").withColumn("lexical", F.when(F.col("_there"), F.array("_wanted")))
    if tail_names:
        tails = preferred_targets(c.select("call_id", "file", tail_name(F.col("callee_expr")).alias("name")), definitions, "call_id", "qualified_name", "ord")
        base = base.join(tails.withColumnRenamed("targets", "tail_targets").hint("merge"), "call_id", "left")
    else:
        base = base.withColumn("tail_targets", F.lit(None).cast("array<string>"))
    lexical = F.col("covered").isNull() & F.col("lexical").isNotNull()
    tail = F.col("covered").isNull() & F.col("tail_targets").isNotNull()
    via = F.when(F.col("scip_targets").isNotNull(), "scip").when(lexical, "lexical_fallback").when(tail, "tail_name")
    targets = F.when(via == "scip", F.col("scip_targets")).when(via == "lexical_fallback", F.col("lexical")).when(via == "tail_name", F.col("tail_targets")).otherwise(F.array().cast("array<string>"))
    made = base.withColumn("resolved_via", via).withColumn("resolved_targets", targets).withColumn("unmapped_def_files", F.coalesce("unmapped", F.array().cast("array<string>")))
    status = F.when(F.col("resolved_via").isNotNull(), "internal").when(F.size("unmapped_def_files") > 0, "internal_unmapped").otherwise("unresolved")
    return made.withColumn("status", status).drop("covered", "scip_targets", "unmapped", "_wanted", "_wants", "_there", "lexical", "tail_targets")


def flag_external(edges: DataFrame, pattern_matches: DataFrame | None = None) -> DataFrame:
    """edges plus external_pattern, external_via, hinted: calls that aren't internal and that a structural match (file, line, label) or the catalogue names are external candidates."""
    if pattern_matches is not None:
        one = pattern_matches.groupBy("file", "line").agg(F.min("label").alias("_label"))
        edges = edges.join(one, ["file", "line"], "left")
    else:
        edges = edges.withColumn("_label", F.lit(None).cast("string"))
    open_ = ~F.col("status").startswith("internal")
    label = F.when(open_, F.coalesce("_label", first_pattern(F.col("callee_expr"), CLIENT_PATTERNS)))
    via = F.when(label.isNotNull(), F.when(F.col("_label").isNotNull(), "ast_grep").otherwise("regex_fallback"))
    made = edges.withColumn("external_pattern", label).withColumn("external_via", via).drop("_label")
    hinted = open_ & F.col("external_pattern").isNull() & F.exists(F.array(*map(F.lit, CLIENT_HINTS)), lambda x: F.contains(F.lower("callee_expr"), x))
    return made.withColumn("status", F.when(F.col("external_pattern").isNotNull(), "external_candidate").otherwise(F.col("status"))).withColumn("hinted", hinted)


def unmapped_gaps(edges: DataFrame, files: DataFrame) -> DataFrame:
    """internal_unmapped gaps: calls per defining file, with why that file was skipped if it was."""
    from graphlens.operators.gaps import gap

    rows = edges.where("status = 'internal_unmapped'").select(F.explode("unmapped_def_files").alias("path")).groupBy("path").agg(F.count("*").alias("n"))
    why = rows.join(files.select("path", "skip_reason"), "path", "left")
    return gap(why, "resolve", "file", "internal_unmapped", path=F.col("path"), detail=F.coalesce("skip_reason", F.lit("its definitions are not known")), impact="calls into the file have no target", count=F.col("n"))


def resolution_totals(edges: DataFrame) -> DataFrame:
    """One row of totals: edges, internal by tier, unmapped, external, unresolved."""
    s, via = F.col("status"), F.col("resolved_via")
    return edges.agg(F.count("*").alias("edges"), F.count_if(s == "internal").alias("internal"), F.count_if(via == "scip").alias("via_scip"), F.count_if(via == "lexical_fallback").alias("via_lexical"), F.count_if(s == "internal_unmapped").alias("unmapped"), F.count_if(s == "external_candidate").alias("external"), F.count_if(s == "unresolved").alias("unresolved"))


def possible_misses(edges: DataFrame, definitions: DataFrame) -> DataFrame:
    """Unresolved calls whose last name some definition has."""
    names = definitions.select(F.col("name").alias("_tail")).distinct()
    return edges.where("status = 'unresolved'").withColumn("_tail", tail_name(F.col("callee_expr"))).join(names, "_tail", "left_semi").drop("_tail")
