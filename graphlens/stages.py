"""Driver queries on the cascade's own stages: the provided tables stand for calls, definitions, assignments and files, and DuckDB's SQL says what a stage makes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.catalog import query, t
from graphlens.operators import configmatch, dataflow, extract, infer, resolve, structure, symbols, trace
from graphlens.sources import configs, repository

# ------------------------------------------------------------------ calls and definitions

_DEFS = "SELECT 'f' || s_nationkey || '.py::s' || (s_suppkey % 97) AS q, 's' || (s_suppkey % 97) AS name, 'f' || s_nationkey || '.py' AS file, s_suppkey AS o FROM supplier"
_CALLS = "SELECT c_custkey AS id, 'f' || c_nationkey || '.py' AS file, CASE c_custkey % 3 WHEN 0 THEN 's' ELSE 'obj.s' END || (c_custkey % 120) AS callee, 's' || (c_custkey % 120) AS tail FROM customer"
_RESOLVED = f"""WITH d AS ({_DEFS}), c AS ({_CALLS}), one AS (SELECT name, file, q, min(o) AS o FROM d GROUP BY ALL), own AS (SELECT name, file, list(q ORDER BY o) AS own FROM one GROUP BY ALL),
every AS (SELECT name, list(q ORDER BY file, o) AS everywhere FROM one GROUP BY name), names AS (SELECT DISTINCT q FROM d),
r AS (SELECT c.id, c.file, c.callee, c.tail, CASE WHEN names.q IS NOT NULL THEN 'lexical_fallback' WHEN everywhere IS NOT NULL THEN 'tail_name' END AS via, CASE WHEN names.q IS NOT NULL THEN [names.q] ELSE coalesce(own, everywhere) END AS targets
FROM c LEFT JOIN names ON NOT contains(c.callee, '.') AND names.q = c.file || '::' || c.callee LEFT JOIN own ON own.name = c.tail AND own.file = c.file LEFT JOIN every ON every.name = c.tail)"""


def _definitions(spark, d) -> DataFrame:
    n, file = F.concat(F.lit("s"), F.col("s_suppkey") % 97), F.concat(F.lit("f"), "s_nationkey", F.lit(".py"))
    return t(spark, d, "supplier").select(F.concat(file, F.lit("::"), n).alias("qualified_name"), n.alias("name"), file.alias("file"), F.col("s_suppkey").cast("int").alias("ord"), F.lit(1).alias("name_line"), F.lit(0).alias("name_col"))


def _calls(spark, d) -> DataFrame:
    file = F.concat(F.lit("f"), "c_nationkey", F.lit(".py"))
    callee = F.concat(F.when(F.col("c_custkey") % 3 == 0, "s").otherwise("obj.s"), F.col("c_custkey") % 120)
    made = t(spark, d, "customer").select(F.concat(file, F.lit("::<module>")).alias("caller"), callee.alias("callee_expr"), F.col("c_custkey").cast("int").alias("line"), F.lit("").alias("arg_text"), file.alias("file"), F.lit(0).alias("callee_line"), F.lit(0).alias("callee_col"), F.col("c_custkey").cast("int").alias("ord"))
    return resolve.with_call_id(made)


def _resolved(spark, d) -> DataFrame:
    return resolve.resolve(_calls(spark, d), _definitions(spark, d), tail_names=True)


@query(_RESOLVED + " SELECT id, CASE WHEN via IS NULL THEN 'unresolved' ELSE 'internal' END AS status, via, array_to_string(coalesce(targets, []), ',') AS targets FROM r")
def stage_resolve(spark, d):
    return _resolved(spark, d).select(F.col("line").cast("long").alias("id"), "status", F.col("resolved_via").alias("via"), F.array_join("resolved_targets", ",").alias("targets"))


@query(_RESOLVED + " SELECT count(*) AS edges, count(*) FILTER (via IS NOT NULL) AS internal, count(*) FILTER (via = 'lexical_fallback') AS via_lexical, count(*) FILTER (via IS NULL) AS unresolved FROM r")
def stage_resolution_totals(spark, d):
    return resolve.resolution_totals(_resolved(spark, d)).select("edges", "internal", "via_lexical", "unresolved")


@query(f"WITH c AS ({_CALLS}), d AS ({_DEFS}), n AS (SELECT DISTINCT q, name FROM d) SELECT id FROM c WHERE NOT EXISTS (SELECT 1 FROM n WHERE NOT contains(callee, '.') AND q = c.file || '::' || callee) AND EXISTS (SELECT 1 FROM n WHERE n.name = c.tail)")
def stage_possible_misses(spark, d):
    edges = resolve.resolve(_calls(spark, d), _definitions(spark, d))
    return resolve.possible_misses(edges, _definitions(spark, d)).select(F.col("line").cast("long").alias("id"))


_CALLEES = ("requests.get", "axios.post", "self.session.run", "http.Get", "fetch", "plain", "grpc.Client", "Redis.connect", "google.cloud.run")


@query(f"""WITH c AS (SELECT o_orderkey AS id, (CAST({list(_CALLEES)} AS VARCHAR[]))[CAST(o_custkey % {len(_CALLEES)} + 1 AS INT)] AS callee, CASE WHEN o_orderpriority = '1-URGENT' THEN 'matched' END AS label FROM orders),
p AS (SELECT id, callee, coalesce(label, {"coalesce(" + ", ".join(f"CASE WHEN regexp_matches(callee, '{a}') THEN '{b}' END" for a, b in resolve.CLIENT_PATTERNS) + ")"}) AS label, label AS own FROM c)
SELECT id, label, CASE WHEN own IS NOT NULL THEN 'ast_grep' WHEN label IS NOT NULL THEN 'regex_fallback' END AS via, CASE WHEN label IS NULL THEN 'unresolved' ELSE 'external_candidate' END AS status, label IS NULL AND len(list_filter(CAST({list(resolve.CLIENT_HINTS)} AS VARCHAR[]), lambda x: contains(lower(callee), x))) > 0 AS hinted FROM p""")
def stage_external(spark, d):
    orders = t(spark, d, "orders")
    callee = F.get(F.array(*map(F.lit, _CALLEES)), (F.col("o_custkey") % len(_CALLEES)).cast("int"))
    edges = orders.select(F.col("o_orderkey").alias("id"), F.lit("f.py").alias("file"), F.col("o_orderkey").cast("int").alias("line"), callee.alias("callee_expr"), F.lit("unresolved").alias("status"))
    matches = orders.where("o_orderpriority = '1-URGENT'").select(F.lit("f.py").alias("file"), F.col("o_orderkey").cast("int").alias("line"), F.lit("matched").alias("label"))
    return resolve.flag_external(edges, matches).select("id", F.col("external_pattern").alias("label"), F.col("external_via").alias("via"), "status", "hinted")


@query("""WITH o AS (SELECT l_orderkey AS f, l_partkey || '/' || l_orderkey % 10 AS symbol, l_linenumber AS line, l_suppkey % 7 AS col FROM lineitem)
SELECT DISTINCT 'f' || r.f AS file, CAST(r.line + 1 AS INT) AS line, CAST(r.col AS INT) AS col, 'f' || x.f AS def_file, CAST(x.col AS INT) AS def_col FROM o r JOIN o x ON x.symbol = r.symbol AND x.line = 1 AND r.line <> 1""")
def stage_references(spark, d):
    symbol = F.concat(F.col("l_partkey"), F.lit("/"), F.col("l_orderkey") % 10)
    made = t(spark, d, "lineitem").select(F.concat(F.lit("f"), "l_orderkey").alias("file"), symbol.alias("symbol"), F.when(F.col("l_linenumber") == 1, 1).otherwise(0).alias("roles"), F.array(F.col("l_linenumber").cast("int"), (F.col("l_suppkey") % 7).cast("int")).alias("range"))
    return symbols.references(made).select("file", "line", "col", "def_file", "def_col")


# ------------------------------------------------------------------ where calls go


def _traced(spark, d) -> DataFrame:
    k, url = F.col("page_id") % 4, F.col("url")
    arg = F.when(k == 0, F.concat(F.lit('"'), url, F.lit('", 5'))).when(k == 1, F.lit("base_url, x")).when(k == 2, F.concat(F.lit('f"'), F.substring_index(url, "#", 1), F.lit('/{x}"'))).otherwise(F.lit('f"http://{host}/a"'))
    return t(spark, d, "pages").select(F.col("page_id").alias("call_id"), F.lit("external_candidate").alias("status"), arg.alias("arg_text"))


@query("""SELECT page_id AS call_id, CASE page_id % 4 WHEN 0 THEN url WHEN 2 THEN split_part(url, '#', 1) || '/{x}' END AS literal, CASE WHEN page_id % 4 IN (0, 2) THEN nullif(regexp_extract(url, '://([^/?#]*)', 1), '') END AS host,
CASE WHEN page_id % 4 = 3 THEN 'host_is_interpolated' END AS literal_reason, CASE page_id % 4 WHEN 1 THEN 'bare_identifier' ELSE 'string_literal' END AS shape FROM pages""")
def stage_literals(spark, d):
    return trace.literals(_traced(spark, d)).select("call_id", "literal", "host", "literal_reason", "shape")


@query("""WITH s AS (SELECT user_id, event_type AS name, ts, CASE WHEN event_id % 5 > 0 THEN 'http://h' || event_id || '.example.com/' END AS value, event_id FROM events WHERE event_type IN ('click', 'view')),
u AS (SELECT event_id, user_id, ts, unnest(['click', 'view']) AS name FROM events WHERE event_type = 'purchase'),
f AS (SELECT u.event_id, u.name, s.value FROM u ASOF LEFT JOIN s ON u.user_id = s.user_id AND u.name = s.name AND u.ts > s.ts),
b AS (SELECT event_id, min(name) FILTER (value IS NOT NULL) AS name FROM f GROUP BY 1)
SELECT b.event_id, b.name, f.value FROM b LEFT JOIN f ON f.event_id = b.event_id AND f.name = b.name""")
def stage_constants(spark, d):
    events = t(spark, d, "events")
    # Lines are ranks of time: a user's log is a file.
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    file = F.concat(F.lit("u"), "user_id")
    uses = events.where("event_type = 'purchase'").select(F.col("event_id").alias("call_id"), file.alias("file"), at.alias("line"), F.lit("external_candidate").alias("status"), F.lit("click + view").alias("argument"), *(F.lit(None).cast("string").alias(c) for c in ("literal", "literal_method", "host")))
    value = F.when(F.col("event_id") % 5 > 0, F.concat(F.lit("http://h"), "event_id", F.lit(".example.com/")))
    sets = events.where("event_type in ('click', 'view')").select(file.alias("file"), F.col("event_type").alias("name"), at.alias("line"), value.alias("value"), F.lit(None).cast("string").alias("host"), F.col("event_id").cast("int").alias("ord"))
    return trace.constants(uses, sets).select(F.col("call_id").alias("event_id"), F.col("constprop_name").alias("name"), F.col("literal").alias("value"))


_HOST = r"lower(regexp_replace(regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^.*@', ''), ':[^:]*$', ''))"


@query(f"""WITH p AS (SELECT page_id, {_HOST} AS host, url FROM pages WHERE {_HOST} <> ''), h AS (SELECT DISTINCT host, split_part(host, '.', 1) AS label FROM p),
v AS (SELECT host, 'c' || page_id % 5 AS path, 'host_value' AS kind, 1 AS tier, page_id AS line FROM p WHERE starts_with(url, 'https')),
l AS (SELECT host, 'c' || s_suppkey % 9 AS path, 'service_name' AS kind, 3 AS tier, 0 AS line FROM h JOIN (SELECT DISTINCT split_part(host, '.', 1) AS name, page_id AS s_suppkey FROM p WHERE contains(url, '/en/')) ON name = label AND length(label) > 2),
x AS (SELECT h.host, 't' || page_id % 3 AS path, 'text' AS kind, 4 AS tier, page_id AS line FROM h JOIN p ON contains(url, '#') AND p.host = h.host),
m AS (SELECT host, path, min_by(kind, tier) AS kind, min(CASE WHEN kind <> 'service_name' THEN line END) AS line FROM (SELECT * FROM v UNION ALL SELECT * FROM l UNION ALL SELECT * FROM x) GROUP BY ALL)
SELECT page_id AS call_id, path, kind FROM p JOIN m USING (host)""")
def stage_config_matches(spark, d):
    from graphlens.functions.hosts import normalize_host

    pages = t(spark, d, "pages").withColumn("h", normalize_host(F.col("url"))).where("h is not null")
    edges = pages.select(F.col("page_id").alias("call_id"), F.lit("external_candidate").alias("status"), F.col("url").alias("host"))
    path = lambda p, n: F.concat(F.lit(p), F.col("page_id") % n).alias("path")
    line = F.col("page_id").cast("int").alias("line")
    none = spark.createDataFrame([], "path string, alias string, name string, key_path string, value string")
    services = pages.where("contains(url, '/en/')").select(path("c", 9), F.substring_index("h", ".", 1).alias("name"), F.lit("declared").alias("reason")).distinct()
    index = {
        "hosts": pages.where("startswith(url, 'https')").select(path("c", 5), F.col("h").alias("host"), F.lit("k").alias("key_path"), F.col("url").alias("value"), line),
        "aliases": none, "services": services,
        "texts": pages.where("contains(url, '#')").select(path("t", 3), F.lit("").alias("key_path"), F.col("url").alias("value"), line),
    }
    return configmatch.match_config(edges, index).select("call_id", "path", "kind")


@query("""WITH a AS (SELECT n_name AS name, 'configured host' AS reason, 0 AS p FROM nation WHERE n_regionkey < 2 UNION ALL SELECT n_name, 'declared service', 1 FROM nation WHERE n_regionkey > 0 UNION ALL SELECT DISTINCT c_mktsegment, 'host of another call', 2 FROM customer UNION ALL SELECT n_name, 'host of another call', 2 FROM nation),
b AS (SELECT name, min_by(reason, p) AS reason, min(p) AS p FROM a GROUP BY name) SELECT name, reason, CAST(row_number() OVER (ORDER BY p, name) AS INT) AS rank FROM b QUALIFY rank <= 40""")
def stage_candidate_pool(spark, d):
    nation, customer = t(spark, d, "nation"), t(spark, d, "customer")
    edges = nation.select(F.col("n_name").alias("host")).unionByName(customer.select(F.col("c_mktsegment").alias("host")))
    return infer.candidate_pool(nation.where("n_regionkey < 2").select(F.col("n_name").alias("host")), nation.where("n_regionkey > 0").select(F.col("n_name").alias("name")), edges)


# ------------------------------------------------------------------ files

#: Modules that one task parses, about.
MODULES = 5_000

_KV = configs.KEY_VALUE.replace("'", "''")


@query(f"""WITH x AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS line, CASE WHEN p_size > 40 THEN '[ ' || p_type || ' ]' WHEN p_size < 5 THEN '; ' || p_name ELSE replace(p_name, ' ', '_') || ' = "' || p_type || '" # ' || p_size END AS raw FROM part),
y AS (SELECT *, last_value(CASE WHEN raw[1] = '[' THEN trim(raw, '[ ]') END IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY line ROWS UNBOUNDED PRECEDING) AS section, rtrim(regexp_replace(raw, '{configs.INLINE_COMMENT}', '')) AS code FROM x WHERE NOT regexp_matches(raw, '{configs.COMMENT}'))
SELECT p_brand AS path, CAST(line AS INT) AS line, concat_ws('.', section, regexp_extract(code, '{_KV}', 1)) AS key_path, trim(trim(regexp_extract(code, '{_KV}', 2)), '"') AS value FROM y WHERE raw[1] <> '['""")
def stage_ini_values(spark, d):
    line = F.when(F.col("p_size") > 40, F.concat(F.lit("[ "), "p_type", F.lit(" ]"))).when(F.col("p_size") < 5, F.concat(F.lit("; "), "p_name")).otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(' = "'), "p_type", F.lit('" # '), "p_size"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("x")))), lambda r: r["x"]), "\n")
    files = t(spark, d, "part").groupBy(F.col("p_brand").alias("path")).agg(text.alias("text")).select("path", F.lit("ini").alias("format"), "text")
    return configs.line_values(files).select("path", "line", "key_path", "value")


@query("""WITH f AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'a.py' WHEN 1 THEN 'b.MD' WHEN 2 THEN 'c.json' WHEN 3 THEN 'node_modules/x.js' WHEN 4 THEN 'e.tsx' ELSE 'k8s/f.txt' END AS tail, text, CASE WHEN doc_id % 60 = 0 THEN 3000000 ELSE 200 * length(text) END AS size FROM documents)
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'python' WHEN 4 THEN 'typescript' WHEN 1 THEN 'other' ELSE 'config' END AS language, doc_id % 6 IN (2, 5) AS is_config, CASE WHEN size > CASE WHEN doc_id % 6 IN (0, 4) THEN 2000000 ELSE 400000 END THEN 'too_large'
 WHEN doc_id % 6 IN (0, 4) AND length(text) >= 50000 AND length(text) / (length(text) - length(replace(text, chr(10), '')) + 1) > 300 THEN 'minified' END AS skip_reason FROM f WHERE doc_id % 6 <> 3""")
def stage_classified(spark, d):
    k = F.col("doc_id") % 6
    tail = F.get(F.array(*map(F.lit, ("a.py", "b.MD", "c.json", "node_modules/x.js", "e.tsx", "k8s/f.txt"))), k.cast("int"))
    size = F.when(F.col("doc_id") % 60 == 0, F.lit(3_000_000).cast("long")).otherwise(F.length("text").cast("long") * 200)
    raw = t(spark, d, "documents").select(F.concat(F.lit("p/"), "doc_id", F.lit("/"), tail).alias("path"), "text", size.alias("size_bytes"), F.lit(None).cast("string").alias("error"))
    return repository.classified(raw).select(F.split("path", "/")[1].cast("long").alias("doc_id"), "language", "is_config", "skip_reason")


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS node, p_partkey // 8 AS other FROM part), r(start, node) AS (SELECT s_suppkey, s_suppkey * 3 FROM supplier UNION SELECT start, other FROM r JOIN e USING (node))
SELECT start, CAST(count(*) AS BIGINT) AS nodes, CAST(sum(node) AS BIGINT) AS total FROM r GROUP BY start""")
def stage_flow_rounds(spark, d):
    steps = t(spark, d, "part").select(F.col("p_partkey").alias("node"), F.expr("p_partkey div 8").alias("other"))
    starts = t(spark, d, "supplier").select(F.col("s_suppkey").alias("start"), (F.col("s_suppkey") * 3).alias("node"))
    return dataflow.reached(starts, steps).groupBy("start").agg(F.count("*").alias("nodes"), F.sum("node").alias("total"))


@query("""WITH c AS (SELECT c_custkey AS k, c_mktsegment AS s FROM customer), f AS (
SELECT k, 'literal' AS kind, chr(39) || 'c' || k || '.example.com' || chr(39) AS code, 0 AS conditions FROM c WHERE s IN ('BUILDING', 'MACHINERY') UNION ALL SELECT k, 'literal', chr(39) || 'd' || k || '.example.com' || chr(39), 1 FROM c WHERE s = 'MACHINERY'
UNION ALL SELECT k, 'env', 'os.environ[' || chr(39) || 'K' || k || chr(39) || ']', 0 FROM c WHERE s = 'AUTOMOBILE' UNION ALL SELECT k, 'parameter', 'u', 0 FROM c WHERE s NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY'))
SELECT 'src/f' || k || '.py' AS file, kind, code, conditions FROM f""")
def stage_flow_results(spark, d):
    """A module for each customer: its open call takes a parameter, which a constant (through a function's result and an attribute), an environment variable, one of two constants or nothing reaches."""
    k, s = F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    boxed = F.when(s == "BUILDING", F.lit("go(self.v)")).otherwise(F.lit("self.v"))
    head = F.concat(F.lit("import os\nA = 'c"), k, F.lit(".example.com'\ndef pick(x):\n    return x\nclass Box:\n    def __init__(self, v):\n        self.v = v\n    def out(self):\n        return "), boxed, F.lit("\ndef go(u):\n    http.get(u)\n"))
    uses = (
        F.when(s == "BUILDING", F.lit("Box(pick(A))\n")).when(s == "AUTOMOBILE", F.concat(F.lit("go(os.environ['K"), k, F.lit("'])\n")))
        .when(s == "MACHINERY", F.concat(F.lit("B = A\nif A:\n    B = 'd"), k, F.lit(".example.com'\ngo(u=B)\n"))).otherwise(F.lit(""))
    )
    # Parsing is dealt by the number of files: one small file of keys stands for many modules.
    customer = t(spark, d, "customer")
    customer = customer.repartition(1 + customer.count() // MODULES, "c_custkey")
    files = customer.select(F.concat(F.lit("src/f"), k, F.lit(".py")).alias("path"), F.concat(head, uses).alias("text"), F.lit("python").alias("language"), F.lit(False).alias("skipped"), F.lit(False).alias("is_config"))
    found = extract.tables(dataflow.kept(extract.extracted(files), "extracted"))
    edges = resolve.resolve(resolve.with_call_id(found["calls"]), found["definitions"])
    edges = edges.withColumn("status", F.when(F.col("callee_expr") == "http.get", "external_candidate").otherwise(F.col("status"))).withColumn("host", F.lit(None).cast("string"))
    flows = dataflow.results(files, dataflow.kept(edges, "edges")).select("file", F.explode("flows").alias("f"))
    return flows.select("file", "f.kind", F.col("f.source.code").alias("code"), F.size("f.conditions").alias("conditions"))


@query("""WITH s AS (SELECT s_suppkey AS k, s_suppkey % 3 AS m FROM supplier), r AS (
SELECT k, 'src/D' || k || '.java' AS file, unnest(['definition', 'definition', 'call', 'call']) AS what, unnest(['D' || k, 'D' || k || '.f', 'this.g', 'h']) AS name, unnest([NULL, NULL, 'D' || k || '.f', 'D' || k || '.f']) AS owner, unnest([1, 2, 3, 3]) AS line FROM s WHERE m = 0
UNION ALL SELECT k, 'src/b' || k || '.go', unnest(['definition', 'definition', 'call']), unnest(['B' || k, 'B' || k || '.Run', 'b.out.Go']), unnest([NULL, NULL, 'B' || k || '.Run']), unnest([2, 3, 4]) FROM s WHERE m = 1
UNION ALL SELECT k, 'src/t' || k || '.ts', unnest(['definition', 'call', 'call']), unnest(['at' || k, 'get', 'base']), unnest([NULL, 'at' || k, 'at' || k]), unnest([1, 2, 2]) FROM s WHERE m = 2)
SELECT file, what, name, owner, CAST(line AS INT) AS line FROM r""")
def stage_extract(spark, d):
    """A source for each supplier: Java methods without a modifier, Go methods by receiver, calls inside template strings."""
    k, m = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 3
    java, go = F.concat(F.lit("class D"), k, F.lit(" {\n  int f(int a) {\n    return this.g(h(a));\n  }\n}\n")), F.concat(F.lit("package p\ntype B"), k, F.lit(" struct { out Out }\nfunc (b *B"), k, F.lit(") Run() {\n\tb.out.Go(`x(1)`)\n}\n"))
    ts = F.concat(F.lit("export function at"), k, F.lit("(id: string) {\n  return get(`${base()}/x/${id}?no(1)`);\n}\n"))
    pick = lambda *x: F.when(m == 0, x[0]).when(m == 1, x[1]).otherwise(x[2])
    path = F.concat(pick(F.lit("src/D"), F.lit("src/b"), F.lit("src/t")), k, pick(F.lit(".java"), F.lit(".go"), F.lit(".ts")))
    files = t(spark, d, "supplier").select(path.alias("path"), pick(java, go, ts).alias("text"), pick(F.lit("java"), F.lit("go"), F.lit("typescript")).alias("language"), F.lit(False).alias("skipped"), F.lit(False).alias("is_config"))
    own = lambda c: F.substring_index(c, "::", -1)
    rows = extract.extracted(files).where("what in ('definition', 'call', 'error')")
    call = F.col("what") == "call"
    return rows.select("file", "what", F.when(call, F.col("b")).otherwise(own("a")).alias("name"), F.when(call, own("a")).alias("owner"), "line")


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 4 AS m, o_custkey % 3 AS a, o_orderdate AS d FROM orders), r AS (
SELECT k, m, unnest(['python-requests', 'twice']) AS label, unnest([2, 3]) AS line, a FROM o WHERE m = 0
UNION ALL SELECT k, m, unnest(['js-fetch', 'js-axios']), 3, a FROM o WHERE m = 1
UNION ALL SELECT k, m, 'go-net-http', 4, a FROM o WHERE m = 2)
SELECT 'o' || k AS file, CAST(line AS INT) AS line, label FROM r WHERE label <> 'twice' OR a = k % 3""")
def stage_structure(spark, d):
    """A source for each order, with calls in code, in template holes, over several lines, in strings, in comments, of members and with equal arguments."""
    k, m = F.col("o_orderkey"), F.col("o_orderkey") % 4
    python = F.concat(F.lit("def requests(a):\n    return requests.get('u', timeout="), k, F.lit(")\nx = same([a, "), F.col("o_custkey") % 3, F.lit("], [a, "), k % 3, F.lit("])\n"))
    js, go = F.lit("const a = 'fetch(x)';\n// fetch(y)\nfetch(`/${axios.post(u)}`);\n"), F.lit("package p\nfunc g() {\n\tx.http.Get(u)\n\thttp.Get(\n\t\tu)\n}\n")
    text = F.when(m == 0, python).when(m == 1, js).when(m == 2, go).otherwise("self.requests.get(x)\n'requests.get(x)'\n")
    language = F.when(m == 1, "javascript").when(m == 2, "go").otherwise("python")
    files = t(spark, d, "orders").select(F.concat(F.lit("o"), k).alias("path"), language.alias("language"), text.alias("text"), F.lit(False).alias("skipped"))
    twice = spark.createDataFrame([("python", "twice", "same($A, $A)")], structure.PATTERNS)
    return structure.matches(files, structure.client_patterns(spark).unionByName(twice))


_INDEXED = """WITH d AS (SELECT DISTINCT 'f' || s_nationkey || '.py::s' || (s_suppkey % 97) AS q, 's' || (s_suppkey % 97) AS name, 'f' || s_nationkey || '.py' AS file FROM supplier),
c AS (SELECT c_custkey AS id, 'f' || c_nationkey || '.py' AS file, 's' || (c_custkey % 120) AS callee FROM customer),
refs AS (SELECT id, 'f' || ((id + j) % 25) || '.py' AS def_file, 's' || (id % 110) AS def_name FROM c, (VALUES (0), (7)) v(j) WHERE id % 5 > 0 AND (j = 0 OR id % 5 > 3)),
cov AS (SELECT DISTINCT file FROM c WHERE CAST(regexp_extract(file, '[0-9]+') AS INT) % 3 > 0),
h AS (SELECT c.id, refs.def_file, d.q FROM c JOIN cov USING (file) JOIN refs USING (id) LEFT JOIN d ON d.file = refs.def_file AND d.name = refs.def_name),
s AS (SELECT id, list(DISTINCT q ORDER BY q) FILTER (q IS NOT NULL) AS targets, list(DISTINCT def_file ORDER BY def_file) FILTER (q IS NULL) AS unmapped FROM h GROUP BY id),
r AS (SELECT c.id, c.file, cov.file IS NOT NULL AS covered, s.targets, coalesce(s.unmapped, []) AS unmapped, d.q AS own FROM c LEFT JOIN cov USING (file) LEFT JOIN s USING (id) LEFT JOIN d ON d.q = c.file || '::' || c.callee),
e AS (SELECT id, CASE WHEN targets IS NOT NULL THEN 'scip' WHEN NOT covered AND own IS NOT NULL THEN 'lexical_fallback' END AS via, CASE WHEN targets IS NOT NULL THEN targets WHEN NOT covered AND own IS NOT NULL THEN [own] ELSE [] END AS targets, unmapped FROM r)"""


def _indexed(spark, d) -> DataFrame:
    """Calls in files of which an index covers two thirds. A definition's line is the number in its name; an index refers to definitions by file, line and column, which the parser may lack."""
    name, of = F.col("s_suppkey") % 97, lambda c: F.concat(F.lit("f"), c, F.lit(".py"))
    defs = t(spark, d, "supplier").select(F.concat(of(F.col("s_nationkey")), F.lit("::s"), name).alias("qualified_name"), F.concat(F.lit("s"), name).alias("name"), of(F.col("s_nationkey")).alias("file"), F.lit(0).alias("ord"), name.cast("int").alias("name_line"), F.lit(4).alias("name_col"))
    k, file = F.col("c_custkey"), of(F.col("c_nationkey"))
    customer = t(spark, d, "customer")
    calls = customer.select(F.concat(file, F.lit("::<module>")).alias("caller"), F.concat(F.lit("s"), k % 120).alias("callee_expr"), k.cast("int").alias("line"), F.lit("").alias("arg_text"), file.alias("file"), k.cast("int").alias("callee_line"), F.lit(1).alias("callee_col"), k.cast("int").alias("ord"))
    more = F.when(k % 5 == 0, F.array().cast("array<int>")).when(k % 5 > 3, F.array(F.lit(0), F.lit(7))).otherwise(F.array(F.lit(0)))
    refs = customer.select(file.alias("file"), k.cast("int").alias("line"), F.lit(1).alias("col"), F.explode(more).alias("j"), (k % 110).cast("int").alias("def_line"), k.alias("k")).select("file", "line", "col", of((F.col("k") + F.col("j")) % 25).alias("def_file"), "def_line", F.lit(4).alias("def_col"))
    covered = customer.where("c_nationkey % 3 > 0").select(file.alias("file"))
    return resolve.resolve(resolve.with_call_id(calls), defs, refs, covered)


@query(_INDEXED + " SELECT id, CASE WHEN via IS NOT NULL THEN 'internal' WHEN len(unmapped) > 0 THEN 'internal_unmapped' ELSE 'unresolved' END AS status, via, array_to_string(targets, ',') AS targets, array_to_string(unmapped, ',') AS unmapped FROM e")
def stage_resolve_indexed(spark, d):
    return _indexed(spark, d).select(F.col("line").cast("long").alias("id"), "status", F.col("resolved_via").alias("via"), F.array_join("resolved_targets", ",").alias("targets"), F.array_join("unmapped_def_files", ",").alias("unmapped"))


@query(_INDEXED + ", u AS (SELECT unnest(unmapped) AS path FROM e WHERE via IS NULL) SELECT path, count(*) AS calls, CASE WHEN CAST(regexp_extract(path, '[0-9]+') AS INT) % 2 = 0 THEN 'too_large' ELSE 'its definitions are not known' END AS detail FROM u GROUP BY path")
def stage_unmapped_gaps(spark, d):
    files = t(spark, d, "nation").select(F.concat(F.lit("f"), "n_nationkey", F.lit(".py")).alias("path"), F.when(F.col("n_nationkey") % 2 == 0, "too_large").alias("skip_reason"))
    return resolve.unmapped_gaps(_indexed(spark, d), files).select("path", F.col("count").alias("calls"), "detail")
