"""Data flow without a tool: what reaches an open call."""

import pytest
from pyspark.sql import functions as F

from graphlens.operators import dataflow, extract, resolve, trace

FILES = {
    "pkg/__init__.py": "",
    "pkg/names.py": "import os\nMAIN = 'https://main.example.com/v1'\nFALL = os.getenv('FALL_HOST', 'fall.example.com')\n",
    "pkg/client.py": (
        "import os\nfrom .names import MAIN as top, FALL\nfrom pkg import names\n\nclass Client:\n    port = ':81'\n    def __init__(self, base, *, path='/x'):\n        self.base = base.rstrip('/')\n        self.path = path\n"  # 1-9
        "    def get(self):\n        return http.get(self.base + self.path + self.port)\n"  # 11
        "    def loop(self, n):\n        n = self.again(n)\n        return http.get(n)\n"  # 14
        "    def again(self, m):\n        return self.again(m) if m else self.base\n"
        "def send(url, body=None):\n    if body:\n        url = 'https://body.example.com'\n    return http.post(url)\n"  # 20
        "def lone(where):\n    http.get(f'https://{where}/')\n"  # 22
        "def env():\n    key = os.environ['DIRECT']\n    a, b = key, 'unused.example.com'\n    http.get(url=a)\n"  # 26
        "def imported():\n    http.get(FALL)\n    http.get(names.MAIN)\n"  # 28, 29
        "Client(top)\nsend('https://sent.example.com', body=1)\n"
        "http.get()\n"  # 32
    ),
    "broken.py": "def (:\n",
    "web.js": "http.get(x)\n",
}
WANT = {
    11: {("literal", "'https://main.example.com/v1'"), ("literal", "'/x'"), ("literal", "':81'"), ("literal", "'/'")},
    14: {("literal", "'https://main.example.com/v1'"), ("literal", "'/'")},
    20: {("literal", "'https://body.example.com'"), ("literal", "'https://sent.example.com'")},
    22: {("literal", "'https://'"), ("literal", "'/'"), ("parameter", "where")},
    26: {("env", "os.environ['DIRECT']")},
    28: {("env", "os.getenv('FALL_HOST', 'fall.example.com')"), ("literal", "'fall.example.com'")},
    29: {("literal", "'https://main.example.com/v1'")},
    32: set(),
}


@pytest.fixture(scope="module")
def traced(spark):
    files = spark.createDataFrame([(p, "javascript" if p.endswith("js") else "python", False, False, t) for p, t in FILES.items()], "path string, language string, skipped boolean, is_config boolean, text string").cache()
    found = extract.tables(extract.extracted(files))
    edges = resolve.resolve(resolve.with_call_id(found["calls"]), found["definitions"], tail_names=True)
    edges = edges.withColumn("status", F.when(F.col("callee_expr").startswith("http."), "external_candidate").otherwise(F.col("status"))).withColumn("host", F.lit(None).cast("string")).cache()
    return edges, dataflow.results(files, edges).cache()


def test_sources(traced):
    got = {r.line: r for r in traced[1].collect()}
    assert {r.file for r in got.values()} == {"pkg/client.py"}
    flows = {n: {(f.kind, f.source.code) for f in r.flows or []} for n, r in got.items()}
    # rstrip's own argument passes, as any argument of a call that hands its text on.
    assert flows == WANT
    assert [r.found_argument for _, r in sorted(got.items())] == [True] * 7 + [False]
    body = next(f for f in got[20].flows if "body" in f.source.code)
    assert [c.code for c in body.conditions] == ["body"] and (body.source.file, body.source.line) == ("pkg/client.py", 19)


def test_edges_take_the_results(traced):
    edges, found = traced
    made = edges
    for c, kind in (("literal", "string"), ("literal_method", "string")):
        made = made.withColumn(c, F.lit(None).cast(kind))
    got = {r.line: r for r in trace.flows(made, found).where("callee_expr like 'http.%' and file = 'pkg/client.py'").collect()}
    assert (got[29].host, got[29].literal_method) == ("main.example.com", "joern") and (got[26].flow_source_kind, got[26].flow_source) == ("env", "DIRECT")
    assert got[20].host is None and got[20].needs_review and got[22].flow_source_kind == "parameter"


def test_rounds(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 3), (4, 5), (None, 6), (5, None), (2, 3)], "node int, other int")
    starts = spark.createDataFrame([("a", 1), ("b", 4), ("c", 9), (None, 1), ("d", None), ("a", 1)], "start string, node int")
    assert sorted(tuple(r) for r in dataflow.reached(starts, edges).collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 4), ("b", 5), ("c", 9)]
    assert dataflow.reached(starts.limit(0), edges).count() == 0 and dataflow.reached(starts, edges.limit(0)).count() == 3


def test_odd_sources():
    for text in ("", "x = y", "def f(*a, **k):\n    return a, k", "x = [y for y in z]", "(lambda: 1)()", "a.b.c[0] = d", "f()(g())(h)", "x: int", "with a as (b, c): pass", "async def f():\n    await g(x)", "x += y", "if (y := z): pass", "from . import x", "from ... import y", "del x", "class A(B): x, y = 1, 2"):
        dataflow.python_facts("a/b.py", text)
    assert dataflow.python_facts("a.py", "(") == []
