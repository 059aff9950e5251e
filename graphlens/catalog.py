"""Driver queries: each applies an operator of this library, or its relational shape, to the provided tables, beside the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.functions import args, hosts, text
from graphlens.operators import aggregates, chunks, dedupe, graph, joins, knn, spans

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(run: Query) -> Query:
        _QUERIES[run.__name__] = run
        if sql:
            _SQL[run.__name__] = sql
        return run

    return add


def queries() -> dict[str, Query]:
    from graphlens import stages  # noqa: F401  registers its queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_NORM = r"""nullif(lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^.*@', ''), ':[^:]*$', ''), '\.+$', '')), '')"""


# ------------------------------------------------------------------ hosts and call sites


@query("SELECT page_id, nullif(regexp_extract(url, '://([^/?#]*)', 1), '') AS host FROM pages")
def host_from_url(spark, d):
    return t(spark, d, "pages").select("page_id", hosts.url_authority(F.col("url")).alias("host"))


@query(f"SELECT page_id, {_NORM} AS host FROM pages")
def normalize_host(spark, d):
    return t(spark, d, "pages").select("page_id", hosts.normalize_host(F.col("url")).alias("host"))


@query(f"SELECT host, count(*) AS n_pages, min(page_id) AS first_page FROM (SELECT page_id, {_NORM} AS host FROM pages) WHERE host IS NOT NULL GROUP BY host")
def external_service_rollup(spark, d):
    found = t(spark, d, "pages").select("page_id", hosts.normalize_host(F.col("url")).alias("host")).where("host is not null")
    return found.groupBy("host").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"))


@query("""SELECT page_id, CAST(ord AS BIGINT) AS ord, target FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS ord FROM pages)""")
def call_site_extract(spark, d):
    found = t(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("ord", "target"))
    return found.select("page_id", (F.col("ord") + 1).cast("long").alias("ord"), "target")


def _expressions(spark, d) -> DataFrame:
    """Argument expressions out of the tables: quoted urls, part names, props, calls and names."""
    pages, part, events = t(spark, d, "pages"), t(spark, d, "part"), t(spark, d, "events")
    made = pages.select(F.concat(F.lit('"'), "url", F.lit('"')).alias("expr")).unionByName(part.select(F.col("p_name").alias("expr"))).unionByName(events.select(F.col("props").alias("expr")))
    return made.unionByName(part.select(F.concat(F.lit("self."), "p_brand").alias("expr"))).unionByName(events.select(F.concat(F.lit("get("), F.col("event_id").cast("string"), F.lit(")")).alias("expr"))).unionByName(events.select("event_type").toDF("expr"))


@query(r"""WITH e AS (SELECT '"' || url || '"' AS expr FROM pages UNION ALL SELECT p_name FROM part UNION ALL SELECT props FROM events UNION ALL SELECT 'self.' || p_brand FROM part UNION ALL SELECT 'get(' || event_id || ')' FROM events UNION ALL SELECT event_type FROM events)
SELECT CASE WHEN expr IS NULL OR expr = '' THEN 'empty' WHEN trim(expr) = '<expr>' THEN 'opaque_placeholder' WHEN regexp_full_match(trim(expr), '[fFrRbBuU]{0,2}"([^"\\]|\\.)*"') OR regexp_full_match(trim(expr), '[fFrRbBuU]{0,2}''([^''\\]|\\.)*''') OR regexp_full_match(trim(expr), '`[^`]*`') THEN 'string_literal'
 WHEN regexp_full_match(trim(expr), '[A-Za-z_$][\w$]*') THEN 'bare_identifier' WHEN regexp_full_match(trim(expr), 'self\.\w+') THEN 'self_attribute' WHEN regexp_full_match(trim(expr), '[A-Za-z_$][\w$]*(\.[A-Za-z_$][\w$]*)+') THEN 'dotted_name'
 WHEN contains(expr, '+') OR contains(expr, '%') OR contains(expr, '.format(') THEN 'concatenation' WHEN regexp_matches(trim(expr), '^[fF]["'']') THEN 'fstring' WHEN starts_with(trim(expr), '`') THEN 'template_literal' WHEN contains(expr, '(') THEN 'call_expression' ELSE 'other_expression' END AS shape, count(*) AS n FROM e GROUP BY 1""")
def arg_shape_histogram(spark, d):
    return _expressions(spark, d).groupBy(args.classify(F.col("expr")).alias("shape")).agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, regexp_extract(text, 'token\s*=\s*"([^"]{3,200})"', 1) AS value FROM documents WHERE regexp_matches(text, 'token\s*=\s*"[^"]{3,200}"')""")
def literal_assignments(spark, d):
    p = r'token\s*=\s*"([^"]{3,200})"'
    return t(spark, d, "documents").where(F.col("text").rlike(p)).select("doc_id", F.regexp_extract("text", p, 1).alias("value"))


# ------------------------------------------------------------------ resolution and joins


@query("""WITH s AS (SELECT s_suppkey, s_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey), c AS (SELECT c_custkey, c_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
j AS (SELECT c_custkey, s_suppkey, c_nationkey = s_nationkey AS same FROM c JOIN s USING (n_regionkey)), m AS (SELECT *, bool_or(same) OVER (PARTITION BY c_custkey) AS any_same FROM j)
SELECT c_custkey, count(*) AS n_targets, min(s_suppkey) AS first_target, bool_or(same) AS preferred FROM m WHERE same OR NOT any_same GROUP BY c_custkey""")
def tail_name_resolution(spark, d):
    nation = t(spark, d, "nation").select("n_nationkey", "n_regionkey")
    defs = t(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("s_nationkey").alias("file"), F.col("n_regionkey").alias("name"))
    calls = t(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("c_nationkey").alias("file"), F.col("n_regionkey").alias("name"))
    return joins.preferred_matches_summary(calls, defs, "c_custkey", "s_suppkey")


@query("SELECT doc_id, lang, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unresolved_calls(spark, d):
    return t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "lang", "n_chars")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def covered_semi(spark, d):
    wanted = t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t(spark, d, "lineitem").join(wanted, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_quantity")


_PATTERNS = (("^STANDARD .*", "standard"), (".*BRASS$", "brass"), (".*(COPPER|NICKEL)$", "soft-metal"), ("^PROMO .*", "promo"))


@query("SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(p_type, '{p}') THEN '{label}'" for p, label in _PATTERNS) + " END AS label FROM part")
def client_pattern_first_match(spark, d):
    return t(spark, d, "part").select("p_partkey", joins.first_pattern(F.col("p_type"), _PATTERNS).alias("label"))


@query("""SELECT p.event_id, p.user_id, c.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY user_id, ts) c ON p.user_id = c.user_id AND p.ts > c.ts""")
def asof_last_assignment(spark, d):
    events = t(spark, d, "events")
    uses = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    sets = events.where("event_type = 'click'").select("user_id", "ts", "value")
    return joins.asof_before(uses, sets, ["user_id"], "ts", "value", "event_id").select("event_id", "user_id", F.col("value").alias("last_value"))


_SPANS = "SELECT l_orderkey AS k, l_linenumber AS s, min(l_linenumber + CAST(l_quantity AS BIGINT)) AS e FROM lineitem GROUP BY 1, 2"


def _spans(spark, d) -> DataFrame:
    return t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("s")).agg(F.min(F.col("l_linenumber") + F.col("l_quantity").cast("long")).alias("e"))


@query(f"""WITH x AS ({_SPANS}) SELECT c.k, c.s, min_by(p.s, (p.e - p.s) * 100000 - p.s) AS parent FROM x c LEFT JOIN x p ON p.k = c.k AND p.s < c.s AND p.e >= c.e GROUP BY c.k, c.s""")
def span_parent(spark, d):
    return spans.smallest_container(_spans(spark, d), "k", "s", "e").select("k", "s", "parent")


@query(f"""WITH x AS ({_SPANS}) SELECT c.k, c.s, p.s AS other FROM x c JOIN x p ON p.k = c.k AND p.s < c.s AND p.e >= c.s AND p.e < c.e""")
def span_partial_overlap(spark, d):
    return spans.partial_overlaps(_spans(spark, d), "k", "s", "e").select("k", "s", F.col("parent").alias("other"))


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def text_token_match(spark, d):
    return joins.contained_passages(t(spark, d, "documents"), t(spark, d, "benchmark")).select("item_id", "doc_id")


@query("""WITH m AS (SELECT c_custkey, s_suppkey, 1 AS tier FROM customer JOIN supplier ON right(c_name, 6) = right(s_name, 6) UNION ALL SELECT c_custkey, s, 2 FROM customer JOIN (SELECT s_nationkey, min(s_suppkey) AS s FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey
UNION ALL SELECT c_custkey, s, 3 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT n_regionkey AS r, min(s_suppkey) AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) ON n_regionkey = r)
SELECT c_custkey, s_suppkey, tier FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY tier, s_suppkey) AS n FROM m) WHERE n = 1""")
def tiered_match(spark, d):
    customer, supplier, nation = t(spark, d, "customer"), t(spark, d, "supplier"), t(spark, d, "nation")
    by_name = customer.join(supplier, F.expr("right(c_name, 6) = right(s_name, 6)")).select("c_custkey", "s_suppkey")
    by_nation = customer.join(supplier.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("s_suppkey")), "c_nationkey").select("c_custkey", "s_suppkey")
    regions = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.min("s_suppkey").alias("s_suppkey"))
    by_region = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(regions, "n_regionkey").select("c_custkey", "s_suppkey")
    return joins.strongest_tier([by_name, by_nation, by_region], ["c_custkey"], ["s_suppkey"]).select("c_custkey", "s_suppkey", "tier")


@query("""SELECT event_id, 'k' AS key, props->>'k' AS value FROM events WHERE props->>'k' IS NOT NULL""")
def props_flatten(spark, d):
    entries = F.explode(F.from_json("props", "map<string,string>"))
    return t(spark, d, "events").select("event_id", entries).select("event_id", "key", "value").where("value is not null")


# ------------------------------------------------------------------ windows, ranks, sets


@query("SELECT doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def first_wins_dedupe(spark, d):
    docs = t(spark, d, "documents").withColumn("h", F.sha2("text", 256))
    return dedupe.first_wins(docs, ["h"], ["doc_id"]).select("doc_id", "n_chars")


@query("SELECT doc_id, source || '/' || lang || CASE WHEN n > 1 THEN '~' || n ELSE '' END AS id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents)")
def duplicate_suffix(spark, d):
    return dedupe.suffixed(t(spark, d, "documents").withColumn("id", F.concat_ws("/", "source", "lang")), "id", ["doc_id"]).select("doc_id", "id")


@query("SELECT conv_id, turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - 1, turn) AS end_turn FROM conversations")
def next_boundary(spark, d):
    return dedupe.next_boundary(t(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], "turn").select("conv_id", "turn", F.coalesce("end", "turn").alias("end_turn"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events")
def section_carry(spark, d):
    marked = t(spark, d, "events").withColumn("mark", F.when(F.col("event_type") == "signup", F.col("value")))
    return dedupe.carried(marked, ["user_id"], ["ts", "event_id"], "mark").select("event_id", F.col("mark").alias("section"))


@query("SELECT source, doc_id, n <= 10 AS within_cap, greatest(total - 10, 0) AS overflow FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY source) AS total FROM documents)")
def cap_overflow(spark, d):
    return dedupe.capped(t(spark, d, "documents"), ["source"], ["doc_id"], 10).select("source", "doc_id", "within_cap", "overflow")


@query("SELECT event_type AS key, count(*) AS n FROM events GROUP BY 1")
def counters(spark, d):
    return aggregates.counters(t(spark, d, "events").select(F.col("event_type").alias("key")))


@query("SELECT substr(o_orderpriority, 3) AS key, count(*) AS n FROM orders WHERE starts_with(o_orderpriority, '1-') OR starts_with(o_orderpriority, '2-') GROUP BY 1")
def counters_prefix(spark, d):
    made = aggregates.counters(t(spark, d, "orders").select(F.col("o_orderpriority").alias("key")))
    return aggregates.with_prefix(made, "1-").unionByName(aggregates.with_prefix(made, "2-"))


@query("SELECT root, n FROM (SELECT split_part(text, ' ', 1) AS root, count(*) AS n FROM documents GROUP BY 1) ORDER BY n DESC, root LIMIT 20")
def top_roots(spark, d):
    return aggregates.most_common(t(spark, d, "documents").select(F.substring_index("text", " ", 1).alias("root")), "root", 20)


@query("SELECT o_orderstatus AS status, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM orders GROUP BY 1")
def status_breakdown(spark, d):
    return aggregates.breakdown(t(spark, d, "orders").select(F.col("o_orderstatus").alias("status")), "status")


@query("SELECT r_name, s.status, count(o_orderkey) AS n FROM region CROSS JOIN (SELECT DISTINCT o_orderstatus AS status FROM orders) s LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = s.status GROUP BY 1, 2")
def zero_filled(spark, d):
    orders, customer, nation, region = (t(spark, d, n) for n in ("orders", "customer", "nation", "region"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", F.col("o_orderstatus").alias("status"))
    return aggregates.zero_filled(rows, {"r_name": region.select("r_name"), "status": orders.select(F.col("o_orderstatus").alias("status"))})


@query("""WITH g AS (SELECT 'too_large' AS kind, doc_id FROM documents WHERE n_chars > 8000 UNION ALL SELECT 'minified', doc_id FROM documents WHERE n_chars >= 2000 AND n_chars / (n_chars - length(replace(text, chr(10), '')) + 1) > 300 UNION ALL SELECT 'unlabelled', doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id))
SELECT kind, count(*) AS n, min(doc_id) AS first_doc FROM g GROUP BY kind""")
def gap_report(spark, d):
    docs, labels = t(spark, d, "documents"), t(spark, d, "labels")
    lines = F.col("n_chars") - F.length(F.replace("text", F.lit("\n"))) + 1
    found = aggregates.tagged("kind", {"too_large": docs.where("n_chars > 8000").select("doc_id"), "minified": docs.where((F.col("n_chars") >= 2000) & (F.col("n_chars") / lines > 300)).select("doc_id"), "unlabelled": docs.join(labels, "doc_id", "left_anti").select("doc_id")})
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("""WITH l AS (SELECT DISTINCT lang, source FROM documents JOIN labels USING (doc_id)), u AS (SELECT DISTINCT lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels x WHERE x.doc_id = d.doc_id))
SELECT 'both' AS side, lang, source FROM (SELECT * FROM l INTERSECT SELECT * FROM u) UNION ALL SELECT 'labelled', lang, source FROM (SELECT * FROM l EXCEPT SELECT * FROM u) UNION ALL SELECT 'unlabelled', lang, source FROM (SELECT * FROM u EXCEPT SELECT * FROM l)""")
def language_set_ops(spark, d):
    docs, labels = t(spark, d, "documents"), t(spark, d, "labels")
    has, lacks = docs.join(labels, "doc_id", "left_semi").select("lang", "source"), docs.join(labels, "doc_id", "left_anti").select("lang", "source")
    return aggregates.tagged("side", {"both": has.intersect(lacks), "labelled": has.subtract(lacks), "unlabelled": lacks.subtract(has)})


# ------------------------------------------------------------------ files and chunks


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS line_count, sha256(text) AS sha, length(text) AS n FROM documents")
def file_stats(spark, d):
    c = F.col("text")
    return t(spark, d, "documents").select("doc_id", text.line_count(c).cast("long").alias("line_count"), F.sha2(c, 256).alias("sha"), F.length(c).cast("long").alias("n"))


@query("SELECT doc_id, length(text) >= 50000 AND length(text) / (length(text) - length(replace(text, chr(10), '')) + 1) > 300 AS minified, length(text) > 400000 AS too_large FROM documents")
def minified_flag(spark, d):
    return t(spark, d, "documents").select("doc_id", text.looks_minified(F.col("text")).alias("minified"), (F.length("text") > text.MAX_OTHER_BYTES).alias("too_large"))


_CHUNKS = """WITH RECURSIVE big AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE length(text) > 8000),
w AS (SELECT doc_id, ls, 1 AS i, 1 AS part, CAST(length(ls[1]) + 1 AS BIGINT) AS acc FROM big UNION ALL SELECT doc_id, ls, i + 1, CASE WHEN acc >= 8000 THEN part + 1 ELSE part END, CASE WHEN acc >= 8000 THEN 0 ELSE acc END + length(ls[i + 1]) + 1 FROM w WHERE i < len(ls)),
c AS (SELECT doc_id, CAST(0 AS INT) AS part, 1 AS start_line, length(text) - length(replace(text, chr(10), '')) + 1 AS end_line, length(text) AS n FROM documents WHERE length(text) <= 8000
UNION ALL SELECT doc_id, part, min(i), max(i), sum(length(ls[i]) + 1) - 1 FROM w GROUP BY doc_id, part)"""


@query(_CHUNKS + " SELECT doc_id, CAST(part AS INT) AS part, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line, CAST(n AS INT) AS n FROM c")
def chunk_documents(spark, d):
    made = chunks.split_oversized(t(spark, d, "documents").select("doc_id", F.col("text").alias("code"), F.lit(1).alias("start_line")), 8000)
    return made.select("doc_id", "part", "start_line", "end_line", F.length("code").alias("n"))


@query(_CHUNKS + " SELECT part > 0 AS oversized, count(*) AS n, count(DISTINCT doc_id) AS docs FROM c GROUP BY 1")
def chunk_kind_counts(spark, d):
    made = chunks.split_oversized(t(spark, d, "documents").select("doc_id", F.col("text").alias("code"), F.lit(1).alias("start_line")), 8000)
    return made.groupBy((F.col("part") > 0).alias("oversized")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


# ------------------------------------------------------------------ retrieval

_COS = "round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_inner_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 5)"


@query(f"SELECT vec_id, distance FROM (SELECT b.vec_id, round(1 - {_COS}, 5) AS distance FROM embeddings a, embeddings b WHERE a.vec_id = 0) ORDER BY distance, vec_id LIMIT 8")
def knn_top8(spark, d):
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = e.where("id = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    return knn.nearest(e, q, 8).select(F.col("id").alias("vec_id"), "distance")


@query(f"SELECT label, vec_id, distance, rank FROM (SELECT a.label, b.vec_id, round(1 - {_COS}, 5) AS distance, row_number() OVER (PARTITION BY a.label ORDER BY round(1 - {_COS}, 5), b.vec_id) AS rank FROM (SELECT * FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1) a, embeddings b) WHERE rank <= 3")
def knn_per_label(spark, d):
    e = t(spark, d, "embeddings")
    q = dedupe.first_wins(e, ["label"], ["vec_id"]).select(F.col("label").alias("query_id"), F.col("embedding").alias("query"))
    return knn.nearest(e.select(F.col("vec_id").alias("id"), "embedding"), q, 3).select(F.col("query_id").alias("label"), F.col("id").alias("vec_id"), "distance", F.col("rank").cast("long").alias("rank"))


@query("SELECT conv_id, string_agg('### ' || role || ' (' || turn || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY turn, role, text) AS context FROM conversations GROUP BY conv_id")
def rag_context(spark, d):
    block = F.concat(F.lit("### "), "role", F.lit(" ("), F.col("turn").cast("string"), F.lit(")\n"), "text")
    return chunks.context_blocks(t(spark, d, "conversations"), ["conv_id"], ["turn", "role", "text"], block).select("conv_id", "context")


# ------------------------------------------------------------------ graph

_NODES = "SELECT 'region:' || r_regionkey AS id, 'region' AS type, r_name AS label FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name FROM customer"
_EDGES = """SELECT DISTINCT * FROM (SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'contains' AS kind, '' AS label FROM nation UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'contains', '' FROM customer UNION ALL SELECT 'customer:' || o_custkey, 'status:' || o_orderstatus, 'calls', o_orderpriority FROM orders)"""


def _graph(spark, d) -> tuple[DataFrame, DataFrame]:
    region, nation, customer, orders = (t(spark, d, n) for n in ("region", "nation", "customer", "orders"))

    def node(kind: str, df: DataFrame, key: str, label: str) -> DataFrame:
        return df.select(F.concat(F.lit(f"{kind}:"), F.col(key)).alias("id"), F.lit(kind).alias("type"), F.col(label).alias("label"))

    nodes = node("region", region, "r_regionkey", "r_name").unionByName(node("nation", nation, "n_nationkey", "n_name")).unionByName(node("customer", customer, "c_custkey", "c_name"))

    def edge(df: DataFrame, a: Column, b: Column, kind: str, label: Column) -> DataFrame:
        return df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("kind"), label.alias("label"))

    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c))
    edges = edge(nation, key("region", "n_regionkey"), key("nation", "n_nationkey"), "contains", F.lit(""))
    edges = edges.unionByName(edge(customer, key("nation", "c_nationkey"), key("customer", "c_custkey"), "contains", F.lit("")))
    return nodes, edges.unionByName(edge(orders, key("customer", "o_custkey"), key("status", "o_orderstatus"), "calls", F.col("o_orderpriority")))


@query(_NODES)
def graph_nodes(spark, d):
    return graph.distinct_nodes(_graph(spark, d)[0].withColumn("ord", F.lit(0))).select("id", "type", "label")


@query(f"SELECT src, dst, kind, label FROM ({_EDGES})")
def graph_edges(spark, d):
    return graph.distinct_edges(_graph(spark, d)[1].withColumn("ord", F.lit(0))).select("src", "dst", "kind", "label")


@query(f"WITH e AS ({_EDGES}), n AS ({_NODES}), deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id) SELECT type, count(*) AS nodes, CAST(sum(coalesce(degree, 0)) AS BIGINT) AS degree FROM n LEFT JOIN deg USING (id) GROUP BY type")
def node_degree(spark, d):
    nodes, edges = _graph(spark, d)
    return graph.degree_by_type(nodes, graph.distinct_edges(edges.withColumn("ord", F.lit(0))))


@query("SELECT lang, CASE WHEN quality IS NULL THEN 'unparsed' WHEN quality = 1 THEN 'scip' ELSE 'treesitter_only' END AS coverage, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2")
def symbol_coverage(spark, d):
    both = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    coverage = F.when(F.col("quality").isNull(), "unparsed").when(F.col("quality") == 1, "scip").otherwise("treesitter_only")
    return both.groupBy("lang", coverage.alias("coverage")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ further shapes of the inventory


@query(r"""SELECT p_partkey, regexp_extract(p_type, '[^ ]*$') AS tail, split_part(p_type, ' ', 1) AS head FROM part""")
def dotted_tail_head(spark, d):
    dotted = F.replace("p_type", F.lit(" "), F.lit("."))
    return t(spark, d, "part").select("p_partkey", args.tail_name(dotted).alias("tail"), args.head_name(dotted).alias("head"))


@query("SELECT o_custkey, count(*) AS orders, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS internal, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS external, sum(CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 1 ELSE 0 END)::BIGINT AS unresolved FROM orders GROUP BY 1")
def resolution_totals(spark, d):
    s = F.col("o_orderstatus")
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.count_if(s == "F").alias("internal"), F.count_if(s == "O").alias("external"), F.count_if(~s.isin("F", "O")).alias("unresolved"))


@query("SELECT user_id, count(DISTINCT event_type) AS kinds, count(*) AS n FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def ambiguous_hosts(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("kinds"), F.count("*").alias("n")).where("kinds > 1")


@query("SELECT count(DISTINCT sha1(text)) AS unique_prompts, count(*) AS prompts FROM conversations WHERE role = 'user'")
def unique_prompts(spark, d):
    return t(spark, d, "conversations").where("role = 'user'").agg(F.countDistinct(F.sha1("text")).alias("unique_prompts"), F.count("*").alias("prompts"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem) WHERE n <= 3")
def slowest_three(spark, d):
    return dedupe.top_per(t(spark, d, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"], 3).select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT c_custkey AS member, min(o_totalprice) AS host, min_by(o_orderkey, (o_totalprice, o_orderkey)) AS first_order FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def first_by_order(spark, d):
    both = t(spark, d, "customer").join(t(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    return both.groupBy(F.col("c_custkey").alias("member")).agg(F.min("o_totalprice").alias("host"), F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("first_order"))


@query("SELECT n_name || '.' || lower(r_name) AS alias, n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT n_name || '.' || lower(r_name) || '.svc', n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey")
def dns_alias_expansion(spark, d):
    both = t(spark, d, "nation").join(t(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    alias = F.explode(F.slice(F.transform(hosts.service_dns_names(F.col("n_name"), F.col("r_name")), lambda x: F.concat("n_name", F.substr(x, F.length("n_name") + 1))), 2, 2))
    return both.select(alias.alias("alias"), "n_nationkey")


@query("SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z_]+'), lambda x: length(x) > 12))) AS roots FROM documents")
def long_identifiers(spark, d):
    found = F.array_distinct(F.filter(F.regexp_extract_all("text", F.lit("([A-Za-z_]+)"), 1), lambda x: F.length(x) > 12))
    return t(spark, d, "documents").select("doc_id", F.size(found).cast("long").alias("roots"))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN text ELSE substr(text, 1, 97) || CASE WHEN length(text) > 97 THEN CASE WHEN length(text) > 100 THEN '...' ELSE substr(text, 98) END ELSE '' END END AS label FROM conversations")
def shortened_labels(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).otherwise(text.shorten(F.col("text"), 100)).alias("label"))
