"""The whole cascade over a small repository of several languages and configuration formats."""

import json
import logging

import pytest

from graphlens.operators import checks, chunks, configmatch, extract, gaps, infer, report, resolve, retrieve, symbols, trace
from graphlens.plans import cascade, job
from graphlens.schema import FLOW_RESULTS
from graphlens.sources import clone, configs, sinks

REPO = {
    "app/__init__.py": "from app.client import fetch_user\n",
    "app/_private.py": "def helper():\n    return 1\n",
    "app/client.py": '''import requests
from app._private import helper

BASE_URL = "https://api.example.com/v1"


class Client:
    base = "x"

    def get(self, path):
        return self.send(path)

    def send(self, path):
        return requests.get(f"{BASE_URL}/{path}")


def fetch_user(user):
    helper()
    return requests.get("https://payments.prod.internal/users")


def dynamic(host):
    url = "http://legacy.example.org"
    requests.post(url + "/x")
    return requests.get(host)


fetch_user(1)
''',
    "web/main.js": 'const API = "https://web.example.net/api"\nfunction load() {\n  fetch(API)\n}\nclass Store {\n  async function save(x) {\n    axios.post(`https://${x}/y`)\n  }\n}\n',
    "broken.py": "def f(:\n",
    "deploy/service.yaml": "kind: Service\nmetadata:\n  name: payments\n  namespace: prod\n---\napi:\n  url: https://api.example.com/\n",
    ".env": "API_HOST=api.example.com\n# legacy.example.org\n",
    "conf/app.ini": "[net]\nhost = legacy.example.org ; old\n",
    "notes.properties": "web=https://web.example.net/api\n",
    "deploy/template.yaml": "{{ if x }}\nhost: api.example.com\nother: staging.api.example.com\n",
    "vendor/lib.py": "x = 1\n",
    "Dockerfile": "FROM scratch\nENV A=1 \\\n  URL=https://web.example.net\n",
}


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    root, out = tmp_path_factory.mktemp("repo"), tmp_path_factory.mktemp("out")
    for name, text in REPO.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    (root / "outside").symlink_to("/etc/hostname")
    return cascade.analyse(spark, str(root), str(out))


def test_files(run):
    got = {r.path: r for r in run.files.collect()}
    assert set(got) == set(REPO) - {"vendor/lib.py"}
    assert got["app/client.py"].language == "python" and got[".env"].is_config and got["Dockerfile"].is_config and not got["app/_private.py"].skipped


def test_definitions_and_imports(run):
    got = {(r.qualified_name, r.kind) for r in run.definitions.collect()}
    assert ("app/client.py::Client.send", "method") in got and ("app/client.py::fetch_user", "function") in got and ("web/main.js::Store.save", "method") in got and ("web/main.js::load", "function") in got
    assert {"requests", "app._private.helper"} <= {r.raw for r in run.imports.where("file = 'app/client.py'").collect()}


def test_edges(run):
    got = {}
    for r in run.edges.collect():
        got.setdefault((r.file, r.line), []).append(r)
    one = lambda f, n: got[f, n][0]
    assert one("app/client.py", 11).status == "internal" and one("app/client.py", 11).resolved_targets == ["app/client.py::Client.send"]
    inner = one("app/client.py", 14)
    assert (inner.status, inner.host, inner.literal_reason) == ("external_candidate", "api.example.com", "no_static_host_in_interpolated_literal")
    user = one("app/client.py", 19)
    assert (user.literal_method, user.host, user.external_pattern, user.external_via) == ("literal", "payments.prod.internal", "python-requests", "regex_fallback")
    legacy = one("app/client.py", 24)
    assert (legacy.literal_method, legacy.host, legacy.constprop_name) == ("const_prop", "legacy.example.org", "url")
    open_ = one("app/client.py", 25)
    assert open_.host is None and open_.needs_review and "inference is not available" in open_.review_reason
    js = one("web/main.js", 3)
    assert (js.external_pattern, js.host) == ("js-fetch", "web.example.net")
    assert one("web/main.js", 7).host is None


def test_config_matches(run):
    got = {(r.path, r.hit): (r.kind, r.confidence) for r in run.matches.collect()}
    assert got["deploy/service.yaml", "api.example.com"] == ("host_value", "high")
    assert got["deploy/service.yaml", "payments"] == ("service_name", "medium")
    assert got[".env", "api.example.com"][0] == "host_value" and got["conf/app.ini", "legacy.example.org"][0] == "host_value"
    assert got["deploy/template.yaml", "api.example.com"] == ("text", "low")
    assert got["Dockerfile", "web.example.net"][0] == "host_value" and (".env", "legacy.example.org") not in got


def test_done_pairs_are_left_out(spark, run):
    index = configs.config_index(run.config_rows)
    assert configmatch.match_config(run.edges, index, run.matches).count() == 0


def test_graph(run):
    nodes = {r.id: r.type for r in run.nodes.collect()}
    edges = {(r.src, r.dst, r.kind) for r in run.graph_edges.collect()}
    assert nodes["ext:api.example.com"] == "external" and nodes["def:app/client.py::<module>"] == "module" and nodes["cfg:.env"] == "config"
    assert ("def:app/client.py::<module>", "def:app/client.py::fetch_user", "calls") in edges
    assert ("def:app/client.py::fetch_user", "ext:payments.prod.internal", "calls_external") in edges and ("ext:api.example.com", "cfg:.env", "configured_in") in edges
    assert all(a in nodes and b in nodes for a, b, _ in edges)
    m = cascade.meta(run)
    assert m["edges"] == run.edges.count() and m["external"] >= 6
    assert sinks.graph_json(run.nodes, run.graph_edges, m)["meta"]["nodes"] == len(nodes)


def test_gaps(spark, run, tmp_path):
    kinds = {(r.kind, r.path) for r in run.gaps.collect()}
    assert ("syntax_errors", "broken.py") in kinds and ("vendored_dir", "") in kinds and ("occurrences_missing", "") in kinds
    path = str(tmp_path / "gaps.json")
    gaps.write_gaps(run.gaps, path)
    assert gaps.read_gaps(spark, path).count() == run.gaps.count() and {r.kind: r.n for r in gaps.summary(run.gaps).collect()}["vendored_dir"] == 1
    with pytest.raises(ValueError):
        gaps.from_dict({"stage": "x"})


def test_symbols(run, tmp_path):
    got = {r.id: r for r in run.symbols.collect()}
    assert got["app/client.py::Client.send"].parent_id == "app/client.py::Client"
    a, b = str(tmp_path / "a.json"), str(tmp_path / "b.json")
    symbols.write_symbol_map(run.coverage, run.symbols, a)
    symbols.write_symbol_map(run.coverage.orderBy("file_sha"), run.symbols.orderBy("name"), b)
    assert open(a).read() == open(b).read() and symbols.read_symbol_map(a)["files"]["broken.py"]["coverage"] == "unparsed"


def sym(q, start, end, scip=None, source="treesitter", line=None):
    s = scip or (None, None)
    return {"qualified_name": q, "ts_start": start, "ts_end": end, "scip_start": s[0], "scip_end": s[1], "name_line": line or start, "name_col": 0, "scip_symbol": None, "source": "both" if scip else source, "name": q, "kind": "function", "path": "p", "ord": 0}


def test_nesting_settles_overlaps():
    rows = {r["id"]: r for r in symbols.nest([sym("a", 1, 10), sym("b", 3, 5, (3, 12)), sym("c", 4, 5), sym("c", 4, 5, line=5)])}
    assert rows["b"]["end"] == 5 and rows["b"]["parent"]["id"] == "a" and rows["c"]["parent"]["id"] == "b" and rows["c~2"]["parent"]["id"] == "c" and not rows["b"]["conflict"]
    rows = {r["id"]: r for r in symbols.nest([sym("a", 1, 5), sym("b", 3, 8)])}
    assert rows["b"]["conflict"] and rows["b"]["parent"] is None


def test_inference_needs_grounding(run):
    answers = {"good": '{"service": "payments.prod.internal", "confidence": "high"}', "bad": '{"service": "made.up.host"}', "none": "I don't know"}
    for name, want in (("good", "candidate"), ("bad", None), ("none", None)):
        got = infer.infer(run.edges_flows, run.prompts, lambda ps, a=answers[name]: [a] * len(ps)).where("status = 'external_candidate' and literal_method is null or literal_method = 'llm_inferred'").collect()
        assert got and {r.inference_grounding for r in got} == {want} and all(r.needs_review for r in got)
    assert infer.parse_answer('text {"service": "a{b", "confidence": "sure"} tail')["confidence"] == "low"
    assert infer.grounding("db.internal", [], "host db.internal:5432") == "quoted_from_context" and infer.grounding("redis.prod", [], "uses redis") == "partial_context_match"


def test_chunks_and_retrieval(spark, run, tmp_path):
    made = chunks.chunk_files(run.files.where("not is_config"), run.definitions)
    got = {r.id: r for r in made.collect()}
    assert "app/client.py::<header>" in got and any(r.qualified_name == "app/client.py::Client" and "def send" in r.code for r in got.values())
    index = sinks.upsert_vectors(spark, str(tmp_path / "v"), "r1", retrieve.embed(made))
    index = sinks.upsert_vectors(spark, str(tmp_path / "v"), "r1", retrieve.embed(made.limit(2)))
    assert index.count() == len(got)
    out = retrieve.ask(spark, index, "def fetch_user(user): helper()", k=3, answer=lambda q, c: c[:3])
    assert len(out["sources"]) == 3 and out["answer"] == "###" and "app/client.py" in out["context"]


def test_reports(run, tmp_path):
    sinks.write_reports(run.edges, run.gaps, str(tmp_path))
    assert (tmp_path / "edges").is_dir() and (tmp_path / "report").is_dir()


@pytest.mark.parametrize("bad,want", [((), "ok"), (("a",), "partial"), (("a", "b"), "failed")])
def test_job_matrix(tmp_path, bad, want):
    j = job.Job("j", str(tmp_path / "status.json"))

    def branch(name):
        def go(base):
            if name in bad:
                raise RuntimeError(name)
            return base

        return go

    out = job.run_branches(j, lambda: 7, {n: branch(n) for n in "ab"})
    assert out["status"] == want and json.loads((tmp_path / "status.json").read_text())["stages"]["prepare"]["state"] == "ok" and len(j.slowest()) == 3
    assert job.run_branches(job.Job("k"), lambda: 1 / 0, {"a": branch("a")})["status"] == "failed"


def test_report_and_checks(spark, run):
    counts = {r.key: r.n for r in report.stage_counters(run.edges).collect()}
    assert counts["method.literal"] >= 1 and counts["method.const_prop"] >= 1 and counts["resolve.external_candidate"] == run.edges.where("status = 'external_candidate'").count()
    made = report.quality_report(run.edges, run.definitions, run.gaps)
    assert abs(sum(r.percent for r in made["statuses"].collect()) - 100) < 0.1 and made["unresolved_roots"].count() <= 10 and made["possible_misses"].count() >= 0
    total = report.match_counters(run.matches).where("kind is null and confidence is null").first()
    assert total.n == run.matches.count()
    assert report.workspaces({"a": run.edges, "b": run.edges}).count() == 2
    row = checks.identifiers_in_place(run.calls, run.files).first()
    assert row.checked > 5 and row.missed == 0 and row.ok


def test_an_index_decides_in_its_files(spark):
    calls = resolve.with_call_id(spark.createDataFrame([("a.py::f", "g", 3, "", "a.py", 3, 4, 0), ("a.py::f", "h", 4, "", "a.py", 4, 4, 1), ("b.py::<module>", "g", 1, "", "b.py", 1, 0, 0)], "caller string, callee_expr string, line int, arg_text string, file string, callee_line int, callee_col int, ord int"))
    defs = spark.createDataFrame([("c.py::g", "g", "function", "c.py", 1, 2, 1, 4, 0), ("a.py::h", "h", "function", "a.py", 9, 9, 9, 4, 0)], "qualified_name string, name string, kind string, file string, start_line int, end_line int, name_line int, name_col int, ord int")
    occ = spark.createDataFrame([("c.py", "s", 1, [0, 4, 5], [0, 0, 2, 0]), ("a.py", "s", 0, [2, 4, 5], None), ("d.py", "t", 1, [0, 0, 1], None), ("a.py", "t", 0, [3, 4, 5], None)], "file string, symbol string, roles int, range array<int>, enclosing_range array<int>")
    refs = symbols.references(occ)
    got = {r.call_id: r for r in resolve.resolve(calls, defs, refs, occ.select("file"), tail_names=True).collect()}
    assert (got["a.py#0"].resolved_via, got["a.py#0"].resolved_targets) == ("scip", ["c.py::g"])
    assert (got["a.py#1"].status, got["a.py#1"].unmapped_def_files) == ("internal_unmapped", ["d.py"])
    assert (got["b.py#0"].resolved_via, got["b.py#0"].resolved_targets) == ("tail_name", ["c.py::g"])
    assert [r.value for r in sinks.reference_lines(refs.where("file = 'a.py' and line = 3")).collect()] == ['{"at":"a.py:3:4","targets":["c.py:1:4"]}']
    spans = symbols.spans_of(occ, spark.createDataFrame([("c.py", "s", "Function", "g")], "file string, symbol string, kind string, display_name string"))
    assert [tuple(r) for r in checks.definitions_beside_spans(defs, spans).collect()] == [("c.py", 1, 0, 0)]
    assert [tuple(r) for r in checks.near_paths(spark.createDataFrame([("/tmp/x/a.py", 3, "v")], "file string, line int, v string"), calls).select("file", "v").collect()] == [("a.py", "v")]
    totals = report.index_totals(spark.createDataFrame([("a.py", "python", False), ("z.go", "go", False)], "path string, language string, is_config boolean"), occ, refs).first()
    assert (totals.files_indexed, totals.files_missing, totals.languages, totals.languages_missing, totals.references) == (1, 1, ["python"], ["go"], 2)


def test_flow_results(spark, run):
    node = lambda code: {"code": code, "file": "app/client.py", "line": 1, "method": "m"}
    flow = lambda kind, code, cond=(): {"kind": kind, "source": node(code), "steps": [], "conditions": [node(c) for c in cond]}
    cases = [([flow("literal", '"https://a.b.c/x"')], ("a.b.c", "literal")), ([flow("literal", '"a.b.c"'), flow("literal", '"d.e.f"')], (None, "literal")), ([flow("env", "os.getenv('KEY')")], (None, "env")), ([flow("parameter", "host")], (None, "parameter")), ([], (None, None))]
    for flows, want in cases:
        results = spark.createDataFrame([("app/client.py", 25, True, True, flows)], FLOW_RESULTS)
        r = trace.flows(run.edges_constants, results).where("file = 'app/client.py' and line = 25").first()
        assert (r.host, r.flow_source_kind) == want and r.needs_review == (want[0] is None)


def test_go_methods_belong_to_their_type():
    rows = extract.line_rows("a.go", 'type Store struct {\n}\nfunc (s *Store) Save(x int) {\n  http.Get("u")\n}\n')
    assert [(r[0], r[3]) for r in rows] == [("definition", "a.go::Store"), ("definition", "a.go::Store.Save"), ("call", "a.go::Store.Save")]


def test_clone(tmp_path):
    def git(args):
        if args[0] == "clone":
            (tmp_path / "w" / args[-1].rsplit("/", 1)[-1]).mkdir(parents=True)
            (tmp_path / "w" / args[-1].rsplit("/", 1)[-1] / "x").write_text("1234")
        return "abc"

    w = str(tmp_path / "w")
    handle = clone.clone("a/b", w, "job1", git)
    assert clone.Handle.load(f"{handle.root}.json") == handle and handle.url == "https://github.com/a/b.git"
    with pytest.raises(ValueError):
        clone.clone("a/b", w, "job2", git, most=3)
    assert not (tmp_path / "w" / "job2").exists()
    for bad in ("../x", "", "a/b"):
        with pytest.raises(ValueError):
            clone.clone("a/b", w, bad, git)
    with pytest.raises(ValueError):
        clone.remove(clone.Handle("/etc", "u", "c", "b", "j"), w)
    clone.remove(handle, w)
    assert not (tmp_path / "w" / "job1").exists()


def test_log_lines():
    j = job.Job("x")
    record = logging.LogRecord("n", logging.INFO, "f", 1, "did %d", (3,), None)
    record.fields = {"path": "p" * 500, "n": 2}
    with j.stage("s"):
        got = json.loads(job.JsonLines("r1").format(record))
    assert (got["stage"], got["message"], len(got["path"]), got["n"]) == ("s", "did 3", 120, 2) and job.STAGE.get() is None
