"""Scalar functions against plain Python or given values."""

import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphlens.functions import args, hosts, text
from graphlens.operators import aggregates, chunks, dedupe, joins, symbols
from graphlens.sources import repository, tools

ARGUMENTS = {
    "": ([], None, [], "empty"),
    "a, c": (["a", "c"], None, ["a", "c"], "other_expression"),
    '"x, y", z': (['"x, y"', "z"], None, ["x", "y", "z"], "other_expression"),
    'f(a, [c]), {"k": 1}': (["f(a, [c])", '{"k": 1}'], None, ["a", "c", "k"], "call_expression"),
    '"https://h/x"': (['"https://h/x"'], "https://h/x", ["https", "h", "x"], "string_literal"),
    "'it\\'s'": (["'it\\'s'"], "it\\'s", ["it", "s"], "string_literal"),
    '"a" + b': (['"a" + b'], None, ["a"], "concatenation"),
    "BASE_URL + path": (["BASE_URL + path"], None, ["BASE_URL", "path"], "concatenation"),
    "self.base": (["self.base"], None, ["self.base"], "self_attribute"),
    "cfg.net.host": (["cfg.net.host"], None, ["cfg.net.host"], "dotted_name"),
    "`${a}`": (["`${a}`"], "${a}", ["$", "a"], "string_literal"),
    'f"{x}" "y"': (['f"{x}" "y"'], None, ["x", "y"], "fstring"),
    "get(x)": (["get(x)"], None, ["x"], "call_expression"),
    "<expr>": (["<expr>"], None, ["expr"], "opaque_placeholder"),
    "name": (["name"], None, ["name"], "bare_identifier"),
    "None": (["None"], None, [], "bare_identifier"),
    "a,": (["a", ""], None, ["a"], "other_expression"),
}


def test_argument_functions(spark):
    df = spark.createDataFrame([(k,) for k in ARGUMENTS], "x string")
    c = F.col("x")
    got = {r.x: r for r in df.select("x", args.split_top_level(c).alias("s"), args.first_argument(c).alias("f"), args.string_literal_value(c).alias("l"), args.identifier_roots(c).alias("i"), args.classify(c).alias("c"), args.is_bare_identifier(c).alias("b")).collect()}
    for x, (parts, literal, roots, shape) in ARGUMENTS.items():
        r = got[x]
        assert (r.s, r.f, r.l, r.c) == (parts, parts[0] if parts else "", literal, shape), x
        assert r.b == bool(re.fullmatch(r"[A-Za-z_$][\w$]*", x))
        assert r.i == sorted(dict.fromkeys(roots), key=lambda n: (not any(h in n.lower() for h in args.HINTS), -len(n))), x


@given(st.text(alphabet="a,()[]{}'\"`\\ ", max_size=30))
def test_split_keeps_every_character(x):
    parts = args.split_arguments(x)
    assert re.sub(r"[\s,]", "", "".join(parts)) == re.sub(r"[\s,]", "", x)


HOSTS = {
    "https://user:pw@API.Example.com:8443/v1": "api.example.com",
    "api.example.com.": "api.example.com",
    "[::1]:6379": "::1",
    "redis:6379": "redis",
    "'db.internal'": "db.internal",
    "${HOST}": None,
    "a b": None,
    "a/b": None,
    "": None,
    "http://": None,
    "postgres://svc:p@w@db:5432/x?y=1": "db",
}


def test_hosts(spark):
    df = spark.createDataFrame([(k,) for k in [*HOSTS, None]], "x string")
    got = {r.x: r.h for r in df.select("x", hosts.normalize_host(F.col("x")).alias("h")).collect()}
    assert got == HOSTS | {None: None}


def test_hosts_in_values_and_literals(spark):
    rows = [("url", "see https://a.b/c and http://d.e:1"), ("x.host", "redis"), ("x.name", "redis"), ("y", "10.0.0.1"), ("z", "localhost"), ("k", "word"), ("long", "h.com " * 500)]
    df = spark.createDataFrame(rows, "k string, v string")
    got = {r.k: r.h for r in df.select("k", hosts.hosts_in_value(F.col("v"), F.col("k")).alias("h")).collect()}
    assert got == {"url": ["a.b", "d.e"], "x.host": ["redis"], "x.name": [], "y": ["10.0.0.1"], "z": ["localhost"], "k": [], "long": []}
    one = spark.createDataFrame([("os.environ.get('A_B')", 'f"x"', "https://h/x"), ("process.env.KEY", "'y'", "h y"), ("x", "3", "svc:8080")], "e string, l string, p string")
    got = one.select(hosts.env_key(F.col("e")), hosts.literal_text(F.col("l")), hosts.is_plausible_host(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("A_B", "x", True), ("KEY", "y", False), (None, None, True)]
    df = spark.createDataFrame([('f"https://h.com/{x}"', "https://h.com/{x}"), ('f"https://{x}/"', "https://{x}/"), ("`${x}`", "${JSON.stringify({a: 1})}/p"), ('"a"', "https://u@q.com/z"), ("x", None)], "a string, b string")
    got = [tuple(r.s) for r in df.select(hosts.static_host("a", "b").alias("s")).collect()]
    assert got == [("h.com", None), (None, "host_is_interpolated"), (None, "no_static_host_in_interpolated_literal"), ("u@q.com", None), (None, None)]
    assert [r.n for r in spark.range(1).select(hosts.service_dns_names(F.lit("Pay"), F.lit("")).alias("n")).collect()] == [["pay", "pay.default", "pay.default.svc", "pay.default.svc.cluster.local"]]


def test_paths(spark):
    want = {"services/user.py": ("python", False, None), "k8s/deployment": ("other", True, None), ".env.local": ("other", True, "env"), "a/Dockerfile": ("other", True, "dockerfile"), "x.yaml": ("other", True, "yaml"), "service_utils.go": ("go", True, None), "node_modules/a.js": ("javascript", False, None), "t.conf": ("other", False, "ini")}
    df = spark.createDataFrame([(k,) for k in want], "p string")
    p = F.col("p")
    got = {r.p: tuple(r)[1:4] for r in df.select("p", text.language_of(p), text.is_config(p), text.config_format(p)).collect()}
    assert got == want
    assert [r.p for r in df.where(text.in_vendored_dir(p)).collect()] == ["node_modules/a.js"]


def test_texts(spark):
    df = spark.createDataFrame([("a\nb\nc", "x | y"), ("", None)], "t string, n string")
    got = df.select(text.line_count(F.col("t")), text.append_note(F.col("n"), F.lit("y")), text.append_note(F.col("n"), F.lit("z")), text.parent_of(F.lit("p::a::b")), text.shorten(F.lit("abcdef"), 5)).collect()
    assert [tuple(r) for r in got] == [(3, "x | y", "x | y | z", "p::a", "ab..."), (0, "y", "z", "p::a", "ab...")]
    window = spark.range(1).select(text.context_window(F.split(F.lit("a\nb\nc\nd"), "\n"), F.lit(3), 1, 9)).first()[0]
    assert window == "2: b\n3: c\n4: d"
    assert text.json_object('x {"a": "}", "b": {"c": 1}} y') == '{"a": "}", "b": {"c": 1}}' and text.json_object("{no} {") is None and text.json_object(None) is None


@pytest.mark.parametrize("url,want", [("owner/repo", "https://github.com/owner/repo.git"), (" https://github.com/a/b/ ", "https://github.com/a/b.git"), ("git@github.com:a/b.git", "https://github.com/a/b.git")])
def test_repository_urls(url, want):
    assert repository.normalize_repo_url(url) == want


@pytest.mark.parametrize("url", ["", "http://github.com/a/b", "https://gitlab.com/a/b", "https://u:p@github.com/a/b", "https://github.com:8443/a/b", "https://github.com/a/..", "https://github.com/a/b c", "ext::sh -c x", "https://github.com/a\\b/c"])
def test_rejected_urls(url):
    with pytest.raises(ValueError):
        repository.normalize_repo_url(url)


def test_discovery_caps_and_limits(spark):
    raw = spark.createDataFrame([(f"f{i}.py", 5, "x = 1", None) for i in range(6)] + [("big.py", 3_000_000, None, None), ("min.js", 60_000, "x" * 60_000, None), ("bad.py", 0, None, "read_error: no"), ("vendor/a.py", 1, "x", None)], repository.RAW)
    files, found = repository.discover(raw, max_files=7)
    assert files.count() == 7
    kinds = {r.kind: (r["count"], len(r.samples or [])) for r in found.collect()}
    assert kinds["file_cap"] == (2, 2) and kinds["vendored_dir"] == (1, 0) and kinds["too_large"][0] == 1 and kinds["read_error"][0] == 1
    assert {r.path: r.skip_reason for r in repository.classified(raw).where("skipped").collect()} == {"big.py": "too_large", "min.js": "minified", "bad.py": "read_error"}


def test_index_tables(spark, tmp_path):
    import json

    doc = {"relative_path": "a\\b.py", "occurrences": [{"range": [0, 4, 7], "symbol": "s", "symbol_roles": 1, "enclosing_range": [0, 0, 3, 0]}, {"range": [9, 2, 5], "symbol": "s"}, {"range": [1, 0, 1], "symbol": "local 1", "symbol_roles": 1}], "symbols": [{"symbol": "s", "kind": "Function", "display_name": "foo"}]}
    for name, value in (("a.json", json.dumps({"documents": [doc]})), ("b.json", json.dumps([doc])), ("c.json", json.dumps(doc) + "\n")):
        (tmp_path / name).write_text(value)
        occ, infos = tools.read_index(spark, str(tmp_path / name))
        assert occ.count() == 3 and infos.count() == 1
        assert [tuple(r) for r in symbols.references(occ).collect()] == [("a/b.py", 10, 2, "a/b.py", 1, 4)]
        spans = {r.symbol: r for r in symbols.spans_of(occ, infos).collect()}
        assert (spans["s"].kind, spans["s"].start_line, spans["s"].end_line, spans["s"].display_name) == ("function", 1, 3, "foo") and spans["local 1"].is_local
    (tmp_path / "m.json").write_text('{"file": "/r/x.py", "ruleId": "python--python-requests", "range": {"start": {"line": 4, "column": 0}}}\n')
    assert [tuple(r) for r in tools.read_pattern_matches(spark, str(tmp_path / "m.json"), "/r").collect()] == [("x.py", 5, "python-requests")]


def test_joins(spark):
    calls = spark.createDataFrame([(1, "f", "n"), (2, "g", "n"), (3, "f", "m")], "id int, file string, name string")
    defs = spark.createDataFrame([("n", "f", 10), ("n", "h", 11), ("n", "f", 12)], "name string, file string, d int")
    got = {r.id: r.targets for r in joins.preferred_targets(calls, defs, "id", "d", "d").collect()}
    assert got == {1: [10, 12], 2: [10, 12, 11]}
    assert sorted(tuple(r) for r in joins.preferred_matches_summary(calls, defs, "id", "d").collect()) == [(1, 2, 10, True), (2, 3, 10, False)]
    uses, sets = spark.createDataFrame([("k", 5, 1), ("k", 1, 2), ("j", 5, 3)], "key string, at int, id int"), spark.createDataFrame([("k", 1, "a"), ("k", 4, "b"), ("k", 4, "c"), ("k", 5, "d")], "key string, at int, v string")
    assert {r.id: r.v for r in joins.asof_before(uses, sets, ["key"], "at", "v", "id").collect()} == {1: "c", 2: None, 3: None}


def test_row_operators(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, n int")
    assert sorted(tuple(r) for r in dedupe.suffixed(df, "k", ["n"]).collect()) == [("a", 1), ("a~2", 2), ("b", 3)]
    assert sorted(tuple(r) for r in dedupe.capped(df, ["k"], ["n"], 1).select("k", "n", "within_cap", "overflow").collect()) == [("a", 1, True, 1), ("a", 2, False, 1), ("b", 3, True, 0)]
    assert [tuple(r) for r in aggregates.most_common(df, "k", 1).collect()] == [("a", 2)]
    assert sorted(tuple(r) for r in aggregates.zero_filled(df.toDF("k", "m"), {"k": df.select("k"), "m": df.select(F.col("n").alias("m"))}).collect())[:3] == [("a", 1, 1), ("a", 2, 1), ("a", 3, 0)]


def slow_parts(code, most):
    if len(code) <= most:
        return [(0, code)]
    out, buf = [], []
    for line in code.split("\n"):
        buf.append(line)
        if sum(len(x) + 1 for x in buf) >= most:
            out.append("\n".join(buf))
            buf = []
    return [(k, x) for k, x in enumerate(out + (["\n".join(buf)] if buf else []), 1)]


def test_oversized_parts(spark):
    codes = ["", "a", "x" * 50, "\n".join("ab" * k for k in range(12)), "\n" * 40, "abcdefgh\n" * 5 + "z" * 30]
    df = spark.createDataFrame([(k, x, 3) for k, x in enumerate(codes)], "id int, code string, start_line int")
    got = {}
    for r in chunks.split_oversized(df, 20).orderBy("id", "part").collect():
        got.setdefault(r.id, []).append(r)
    for k, x in enumerate(codes):
        assert [(r.part, r.code) for r in got[k]] == slow_parts(x, 20), k
        assert got[k][0].start_line == 3 and all(a.end_line + 1 == b.start_line for a, b in zip(got[k], got[k][1:])) and got[k][-1].end_line == 3 + x.count("\n")
