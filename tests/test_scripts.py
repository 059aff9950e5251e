"""JavaScript and TypeScript by tokens."""

import pytest

from graphlens.operators import extract, scripts

FILES = {
    "shop/cart.js": (
        "const money = require('./money');\nimport http, { retry as again } from 'tiny-http';\n\nclass Cart {\n  constructor(owner) { super(owner); this.lines = newList(owner); }\n  total() { return this.lines.reduce((sum, x) => sum + money.of(x), 0); }\n}\nfunction checkout(cart) {\n  return again(() => http.post(urlOf(cart), cart.total()));\n}\n",
        {"Cart", "Cart.constructor", "Cart.total", "checkout"}, {"require", "super", "newList", "this.lines.reduce", "money.of", "again", "http.post", "urlOf", "cart.total"}, ["./money", "tiny-http"],
    ),
    "ui/list.jsx": ("import { h } from 'view';\nexport default function List({ rows, pick }) {\n  return <ol>{rows.map((r) => <li key={keyOf(r)} onTap={() => pick(r)}>{show(r)}</li>)}</ol>;\n}\n", {"List"}, {"rows.map", "keyOf", "pick", "show"}, ["view"]),
    "tools/build.mjs": ("export { pack } from './pack.mjs';\nexport const later = async (name) => (await import(`./steps.mjs`)).run(name);\n", {"later"}, {"import", "<expr>.run"}, ["./pack.mjs", "./steps.mjs"]),
    "tools/old.cjs": ("var seen = {};\nexports.visit = function visit(node, next) { seen[node.id] = true; return next(node) || visit(node.up, next); };\n", {"visit"}, {"next", "visit"}, []),
    "api/store.ts": (
        "import type Row from '../row';\nenum Level { Low = 1, High }\ninterface Source<T> { read(key: string): Promise<T>; close(): void }\nabstract class Store implements Source<Row> {\n  abstract close(): void;\n  async read(key: string): Promise<Row> { return decode<Row>(await this.raw.get(key)); }\n}\nexport function open(path: string, level = Level.Low): Store { return make(path)!.as<Store>(); }\n",
        {"Level", "Source", "Store", "Store.read", "open"}, {"decode", "this.raw.get", "make", "<expr>.as"}, ["../row"],
    ),
    "ui/badge.tsx": ("import { tone } from '../tone';\nconst Badge = ({ text, level }: { text: string; level: number }) => <b style={tone(level)}>{text.trim()}</b>;\nexport { Badge };\n", {"Badge"}, {"tone", "text.trim"}, ["../tone"]),
    "g.ts": ("export * from './all';\nconst run: (x: number) => void = async (x): Promise<void> => { await go<string>(x); };\nconst o = { a: () => one(), b() { two(); }, 'c': function () { three(); } };\nif (ok(1)) { new Thing(2); list.map(x => x.y()); }\nfor (const k of keys()) { k?.z?.(3); /re(x)/.test('a(b)'); // no(1)\n}\nclass A { static make = () => mk(); get v(): number { return 1; } m(): void; private async n(x = dflt()) { function inner() { deep(); } return super.n(x) } }\n", {"run", "a", "b", "c", "A", "A.make", "A.v", "A.n", "inner"}, {"go", "one", "two", "three", "ok", "Thing", "list.map", "x.y", "keys", "k.z", "<expr>.test", "mk", "dflt", "deep", "super.n"}, ["./all"]),
}


def of(name, text, what):
    return [r for r in scripts.script_rows(name, text) if r[0] == what]


@pytest.mark.parametrize("name", FILES)
def test_definitions_calls_and_imports(name):
    text, defs, calls, imports = FILES[name]
    assert {r[3].split("::")[1] for r in of(name, text, "definition")} == defs
    assert {r[4] for r in of(name, text, "call")} == calls
    assert [r[3] for r in of(name, text, "import")] == imports and not of(name, text, "error")


def test_extents_places_and_callers():
    text = "class K {\n  save(a,\n       b) {\n    this.db.put(a, {\n      b,\n    });\n  }\n}\nconst f = x =>\n  g(x);\n"
    got = {r[4]: (r[5], r[6], r[7], r[8], r[9]) for r in of("k.js", text, "definition")}
    assert got == {"K": ("class", 1, 8, 1, 6), "save": ("method", 2, 7, 2, 2), "f": ("function", 9, 10, 9, 6)}
    assert [(r[3], r[4], r[5], r[6], r[8], r[9]) for r in of("k.js", text, "call")] == [("k.js::K.save", "this.db.put", "a, {\n      b,\n    }", 4, 4, 12), ("k.js::f", "g", "x", 10, 10, 2)]


def test_assignments():
    text = "const A = 'https://a.example.com/x'; let b: string = \"b.c\"\nvar c = 'x' + d, e = `t${1}`;\nconst { y } = z;\n"
    assert [(r[3], r[4], r[5]) for r in of("a.ts", text, "assignment")] == [("A", "https://a.example.com/x", "a.example.com"), ("b", "b.c", "b.c"), ("c", None, None)]


def test_damaged_files_give_what_can_be_read():
    text = "let half = (a: number) => a / 2;\nclass Torn { whole() { return half(4); }\n  cut(b {\n"
    assert "x.ts::half" in {r[3] for r in of("x.ts", text, "definition")} and [r[3] for r in of("x.ts", text, "error")] == ["syntax_errors"]
    assert "half" in {r[4] for r in of("x.ts", text, "call")}
    for odd in ("", "'", "`", "/*", "}}}", "=>", "class", "function", "import", "x =>", "const", "(a", "a(/", "import(", "require(", "`${", "`${`", "`${}`}", "`a${b}", "static {", "`${{}}`"):
        scripts.script_rows("x.js", odd)


def test_languages():
    assert extract.EXTRACTORS["javascript"] is extract.EXTRACTORS["typescript"] is scripts.script_rows


def test_code_in_templates():
    text = "function url(id) { return `${base()}/a/${ids.of({ x: `in ${deep(id)} z(1)` })}?q(2)`; }\nconst t = `plain text(3)`; const u = `${t}`;\nget(`/b/${`c(4)`}`);\n"
    assert [(r[3], r[4]) for r in of("t.js", text, "call")] == [("t.js::url", "base"), ("t.js::url", "ids.of"), ("t.js::url", "deep"), ("t.js::<module>", "get")]
    assert [r[5] for r in of("t.js", text, "call")][-1] == "`/b/${`c(4)`}`" and not of("t.js", text, "error")
    assert [(r[3], r[4]) for r in of("t.js", text, "assignment")] == [("t", "plain text(3)"), ("u", None)]
    assert [r[9] for r in of("t.js", text, "call")] == [29, 45, 59, 0]
    tagged = "const q = sql`a ${col(`b${c()}`)} / ${d() / 2} / e(5)`; after();"
    assert [r[4] for r in of("t.js", tagged, "call")] == ["col", "c", "d", "after"]


def test_static_blocks():
    text = "class A {\n  static { init(); if (x) { more(); } }\n  static make() { return new A(); }\n  run() { go(); }\n}\n"
    assert {r[3] for r in of("s.js", text, "definition")} == {"s.js::A", "s.js::A.make", "s.js::A.run"}
    assert [(r[3], r[4]) for r in of("s.js", text, "call")] == [("s.js::<module>", "init"), ("s.js::<module>", "more"), ("s.js::A.make", "A"), ("s.js::A.run", "go")]


def test_many_open_type_arguments():
    import time

    at = time.time()
    assert not of("t.ts", "f<" * 20_000, "call")
    scripts.script_rows("t.js", "`${" * 3_000)
    scripts.script_rows("t.js", "`${a}" * 3_000)
    assert time.time() - at < 5
