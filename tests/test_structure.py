"""Patterns on token trees."""

import time

import pytest

from graphlens.operators import resolve, structure

FILES = "path string, language string, text string, skipped boolean"


def lines(language, pattern, text):
    return [line for _, line, _ in structure.Search(language, [structure.compiled(language, "x", pattern)]).rows("f", text)]


@pytest.mark.parametrize(
    ("language", "pattern", "text", "want"),
    [
        ("python", "http.get($$$A)", "http.get()\nhttp.get(a, (b, c))\nself.http.get(a)\n# http.get(a)\n'http.get(a)'\nhttp . get(\n a)\nhttp.get\n", [1, 2, 6]),
        ("python", "fetch($$$)", "def fetch(a):\n    pass\nfetch(b)\nf'{fetch(c)}' f'{{fetch(d)}}'\nx.fetch(e)\n", [3, 4]),
        ("python", "fetch($$$)", 'f"""{a}\n{fetch(b)} "c" """\nrf"\\d{fetch(d)}"\n', [2, 3]),
        ("python", "same($A, $A)", "same(a.b(1), a.b(1))\nsame(a, b)\nsame(a, a, a)\nsame(a + 1, a + 1,)\n", [1, 4]),
        ("python", "any($_, $_)", "any(a, b)\nany(a)\n", [1]),
        ("python", "open($P, $$$REST)", "open(a)\nopen(a, b, c)\nopen()\nopen(a,)\n", [1, 2, 4]),
        ("python", "$O.send($$$)", "a.b[0].send(1)\nsend(2)\nc.send\n", [1]),
        ("python", "f($$$A, key=$V, $$$B)", "f(key=1)\nf(a, key=g(2))\nf(a, key=3, b=4)\nf(a, b=5)\n", [2, 3]),
        ("javascript", "fetch($$$)", "fetch(`/a/${fetch(b)}`);\nclass A { fetch(x) { return 1; } }\nnew fetch(y);\n`fetch(z)`; /fetch(q)/;\n", [1]),
        ("javascript", "$.ajax($$$)", "$.ajax({a: 1});\n$.get(b);\n", [1]),
        ("typescript", "new grpc.Client($$$)", "const c = new grpc.Client(a, b);\ngrpc.Client(c);\n", [1]),
        ("go", "http.Get($$$)", "package p\nfunc f() {\n\tx.http.Get(u)\n\tfor range http.Get(`http.Get(v)`) {\n\t}\n}\n", [4]),
        ("php", "new Client($$$)", "new Client(a)\n<?php $c = new Client(['a' => 1]); // new Client(b)\n", [2]),
        ("ruby", "Net::HTTP.get($$$)", 'x = "#{Net::HTTP.get(u)}"\n# Net::HTTP.get(v)\n', [1]),
        ("java", "new HttpClient($$$)", "class A {\n  B b = new HttpClient();\n}\n", [2]),
        ("python", "f($$$)", "f(a\n", []),
    ],
)
def test_lines(language, pattern, text, want):
    assert lines(language, pattern, text) == want


def test_work_follows_tokens():
    began = time.time()
    assert lines("python", "f($$$A, x, $$$B, y)", "f(" + "x, " * 30_000 + "z)\n") == []
    assert lines("python", "f($$$)", "f(" * 5_000 + "\n") == []
    assert time.time() - began < 5


def test_patterns_that_are_none():
    for language, pattern in (("cobol", "f($A)"), ("python", "  "), ("python", "f(")):
        with pytest.raises(ValueError):
            structure.compiled(language, "x", pattern)


def test_matches_name_external_calls(spark):
    files = spark.createDataFrame([("a.py", "python", "x = 1\nrequests.get(u); requests.post(v)\n", False), ("b.py", "python", None, False), ("c.py", "python", "requests.get(u)", True), ("d.xyz", "other", "requests.get(u)", False), ("e.cs", "csharp", "class A { void f() {\n var c = new RestClient(1); } }", False)], FILES)
    found = structure.matches(files, structure.client_patterns(spark))
    assert sorted(map(tuple, found.collect())) == [("a.py", 2, "python-requests"), ("e.cs", 2, "java-http-client")]
    assert structure.matches(files, spark.createDataFrame([], structure.PATTERNS)).count() == 0
    edges = spark.createDataFrame([("a.py", 2, "r.get", "unresolved"), ("a.py", 1, "r.get", "unresolved")], "file string, line int, callee_expr string, status string")
    got = {r.line: (r.external_pattern, r.external_via) for r in resolve.flag_external(edges, found).collect()}
    assert got == {2: ("python-requests", "ast_grep"), 1: (None, None)}


def test_too_many_patterns(spark, monkeypatch):
    monkeypatch.setattr(structure, "MAX_PATTERNS", 3)
    with pytest.raises(ValueError):
        structure.matches(spark.createDataFrame([], FILES), structure.client_patterns(spark))
