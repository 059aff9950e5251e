"""Symbol indexes in wire format beside the same index as JSON."""

import json
import random

import pytest

from graphlens.operators import structure, symbols
from graphlens.plans import cascade
from graphlens.sources import symbol_index, tools


def num(v):
    out = b""
    v &= (1 << 64) - 1
    while v > 127:
        out, v = out + bytes([v & 127 | 128]), v >> 7
    return out + bytes([v])


def put(field, value):
    if isinstance(value, int):
        return num(field << 3) + num(value)
    value = value.encode() if isinstance(value, str) else value
    return num(field << 3 | 2) + num(len(value)) + value


def wire(doc):
    """A document's bytes; fields that nobody asks for (texts, diagnostics, unknown ones) stand between the others."""
    out = put(4, doc["language"]) + put(1, doc["relative_path"]) + put(5, "a text\n" * 9)
    for o in doc["occurrences"]:
        own = put(1, b"".join(map(num, o["range"]))) + put(2, o["symbol"]) + put(3, o["symbol_roles"]) + put(4, "a note") + num(99 << 3 | 5) + b"\1\2\3\4"
        out += put(2, own + (put(7, b"".join(map(num, o["enclosing_range"]))) if "enclosing_range" in o else b""))
    for s in doc["symbols"]:
        out += put(3, put(1, s["symbol"]) + put(3, "words") + put(5, int(s["kind"])) + put(6, s["display_name"]))
    return out


def docs(n, seed=0):
    rng, out = random.Random(seed), []
    for i in range(n):
        occ = [{"range": [k, rng.randrange(9), 12], "symbol": f"pkg f{rng.randrange(n)}/s{k}", "symbol_roles": 0} for k in range(rng.randrange(6))]
        occ += [{"range": [20, 4, 9], "symbol": f"pkg f{i}/s0", "symbol_roles": 1, "enclosing_range": [20, 0, 29, 1]}, {"range": [22, 300, 304], "symbol": "local 1", "symbol_roles": 1}]
        out.append({"relative_path": f"src\\f{i}.py" if i % 2 else f"src/f{i}.py", "language": "python", "occurrences": occ, "symbols": [{"symbol": f"pkg f{i}/s0", "kind": "17", "display_name": f"söme{i}"}]})
    return out


def index(path, made, tail=b""):
    path.write_bytes(put(1, put(2, "tool")) + b"".join(put(2, wire(d)) for d in made) + put(3, put(1, "external")) + tail)


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("split", [1500, 1 << 20])
def test_wire_and_json_give_the_same_spans_and_references(spark, tmp_path, split):
    made = docs(40)
    index(tmp_path / "a.scip", made)
    (tmp_path / "a.json").write_text(json.dumps({"documents": made}))
    occ, infos, gaps = symbol_index.tables(symbol_index.read_documents(spark, str(tmp_path / "a.scip"), split_bytes=split))
    occ2, infos2 = tools.read_index(spark, str(tmp_path / "a.json"))
    assert rows(symbols.spans_of(occ, infos)) == rows(symbols.spans_of(occ2, infos2)) and symbols.spans_of(occ, infos).count() == 80
    assert rows(symbols.references(occ)) == rows(symbols.references(occ2)) != []
    assert gaps.count() == 0


def test_only_asked_columns_are_decoded(spark, tmp_path, monkeypatch):
    index(tmp_path / "a.scip", docs(5))
    df = symbol_index.read_documents(spark, str(tmp_path / "a.scip"), "relative_path string, language string")
    assert df.columns == ["relative_path", "language"] and sorted(r.relative_path for r in df.collect())[0] == "src/f0.py"
    data = wire(docs(1)[0])
    got = symbol_index.document(data, 0, len(data), frozenset(["language"]))
    assert got["occurrences"] == [] and got["symbols"] == [] and got["language"] == "python"


def test_a_damaged_index_fails_alone(spark, tmp_path):
    good, bad = docs(6), docs(6, 1)
    index(tmp_path / "a.scip", good)
    index(tmp_path / "b.scip", [{**d, "relative_path": f"other/{i}.go"} for i, d in enumerate(bad)], tail=num(2 << 3 | 2) + num(500) + b"cut")
    (tmp_path / "c.scip").write_bytes(b"")
    (tmp_path / "d.scip").write_bytes(put(2, b"\x12\xff"))
    read = symbol_index.read_documents(spark, str(tmp_path), split_bytes=700)
    assert read.where("error is not null").count() == 3 and read.where("error is null").count() == 12
    occ, infos, gaps = symbol_index.tables(read)
    assert {r.file for r in occ.collect()} == {f"src/f{i}.py" for i in range(6)} and infos.count() == 6
    assert sorted((r.path.rsplit("/", 1)[1], r.kind, r["count"]) for r in gaps.collect()) == [(f"{x}.scip", "index_failed", 1) for x in "bcd"]


def test_numbers_and_single_lists():
    data = b"".join(num(1 << 3) + num(v) for v in (7, -1, 300)) + put(2, "s") + put(3, 1) + put(3, 2)
    got = symbol_index._record(data, 0, len(data), symbol_index.OCCURRENCE, ("range",))
    assert got == {"range": [7, -1, 300], "symbol": "s", "symbol_roles": 2}
    with pytest.raises(symbol_index.Damaged):
        list(symbol_index.fields(b"\x80" * 12, 0, 12))
    with pytest.raises(symbol_index.Damaged):
        list(symbol_index.fields(b"\x0b", 0, 1))


def test_the_cascade_reads_an_index_and_searches_patterns(spark, tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    (root / "a.py").write_text("def go(x):\n    x.run()\n    requests.get('http://api.example.com/v1')\n")
    (root / "b.py").write_text("class B:\n    def run(self):\n        pass\n")
    (root / "c.py").write_text("def own():\n    own()\n")
    occ = {"a.py": [{"range": [1, 6, 9], "symbol": "pkg B#run", "symbol_roles": 0}], "b.py": [{"range": [1, 8, 11], "symbol": "pkg B#run", "symbol_roles": 1, "enclosing_range": [1, 4, 2, 12]}]}
    made = [{"relative_path": f, "language": "python", "occurrences": o, "symbols": [{"symbol": "pkg B#run", "kind": "26", "display_name": "run"}]} for f, o in occ.items()]
    (tmp_path / "ix").mkdir()
    index(tmp_path / "ix" / "good.scip", made)
    index(tmp_path / "ix" / "bad.scip", [{**made[0], "relative_path": "c.py"}], tail=b"\x12\x7f")
    given = cascade.Providers(index=str(tmp_path / "ix"), patterns=structure.client_patterns(spark))
    run = cascade.analyse(spark, str(root), str(tmp_path / "out"), given)
    got = {(r.file, r.callee_expr): (r.status, r.resolved_via, r.external_via, r.resolved_targets) for r in run.edges.collect()}
    assert got[("a.py", "x.run")] == ("internal", "scip", None, ["b.py::B.run"])
    assert got[("a.py", "requests.get")][:3] == ("external_candidate", None, "ast_grep")
    assert got[("c.py", "own")][:2] == ("internal", "lexical_fallback")
    kinds = {r.kind for r in run.gaps.collect()}
    assert "index_failed" in kinds and not {"occurrences_missing", "pattern_matches_missing"} & kinds
    assert {r.id: r.source for r in run.symbols.collect()}["b.py::B.run"] == "both"
