"""Java, C#, Go, Rust, PHP and Ruby by tables over one tokenizer."""

import time

import pytest

from graphlens.operators import extract, grammars

#: By file: (source, definitions, calls as (caller, callee), imports).
FILES = {
    "Depot.java": (
        'package depot;\nimport java.util.List;\nimport static depot.Units.*;\n\n@Table(name = "d")\npublic class Depot<T extends Item> extends Base {\n  private static final String HOST = "https://depot.example.org/v2";\n  private final Map<String, T> kept = makeMap(16);\n  Depot(int n) { super(n); fill(n); }\n  void add(T x) throws Full { kept.put(x.id(), x); }\n  String host() {\n    return new Link(HOST).open(retry(3)).text();\n  }\n  abstract int size();\n  enum Kind { BIG(1), SMALL(2); private int of(String s) { return Integer.parseInt(s); } }\n  static <A> A pick(List<A> xs) { Runnable r = () -> xs.forEach(x -> log(x)); return Depot.<A>first(xs); }\n}\ninterface Item { String id(); default int w() { return id().length(); } }\n',
        {"Depot", "Depot.Depot", "Depot.add", "Depot.host", "Depot.size", "Kind", "Kind.of", "Depot.pick", "Item", "Item.id", "Item.w"},
        [("<module>", "makeMap"), ("Depot.Depot", "fill"), ("Depot.add", "kept.put"), ("Depot.add", "x.id"), ("Depot.host", "new Link(HOST).open"), ("Depot.host", "retry"), ("Depot.host", "new Link(HOST).open(retry(3)).text"), ("Kind.of", "Integer.parseInt"), ("Depot.pick", "xs.forEach"), ("Depot.pick", "log"), ("Depot.pick", "Depot.<A>first"), ("Item.w", "id"), ("Item.w", "id().length")],
        ["java.util.List", "static depot.Units.*"],
    ),
    "Clock.cs": (
        'using System;\nusing static System.Math;\nnamespace Time {\n  [Serializable("x")]\n  public struct Tick { public int At; }\n  public class Clock : IClock {\n    const string Zone = "utc.example.net";\n    public Clock(int a) : base(a) { Start(a); }\n    public int Now => Read();\n    public async Task<int> Wait(TimeSpan t) { await Task.Delay(t); return Abs(-1); }\n    int Twice(int x) => Add(x, x);\n    string Say(string n) { int Local(int q) { return Deep(q); } using (var s = Open(n)) { return $"at {Zone} {s.Name($"in {Pad(n)}")} no(1)"; } }\n  }\n}\n',
        {"Tick", "Clock", "Clock.Clock", "Clock.Wait", "Clock.Twice", "Clock.Say", "Clock.Local"},
        [("Clock.Clock", "Start"), ("<module>", "Read"), ("Clock.Wait", "Task.Delay"), ("Clock.Wait", "Abs"), ("Clock.Twice", "Add"), ("Clock.Local", "Deep"), ("Clock.Say", "Open"), ("Clock.Say", "s.Name"), ("Clock.Say", "Pad")],
        ["System", "static System.Math"],
    ),
    "mail/send.go": (
        'package mail\n\nimport (\n\t"fmt"\n\tnet "net/smtp"\n)\nimport "os"\n\nconst relay = "smtp.example.com"\n\ntype (\n\tBox struct { n int }\n\tFlag int\n)\ntype Post struct {\n\tto []string\n}\n\nfunc (p *Post) Send(at string) (map[string]interface{}, error) {\n\tdefer p.close()\n\treturn wrap(net.Dial(at), func(x int) { fmt.Println(x) })\n}\nfunc (b Box) Len() int { return len(b.name(`raw (x)`)) }\nfunc Map[T any](xs []T, f func(T) T) []T { return Fold[T](xs, f) }\n',
        {"Box", "Post", "Post.Send", "Box.Len", "Map"},
        [("Post.Send", "p.close"), ("Post.Send", "wrap"), ("Post.Send", "net.Dial"), ("Post.Send", "fmt.Println"), ("Box.Len", "len"), ("Box.Len", "b.name"), ("Map", "Fold")],
        ["fmt", "net/smtp", "os"],
    ),
    "src/pool.rs": (
        "use std::collections::{HashMap, HashSet};\npub use crate::net::Link;\n\nconst HOME: &str = \"https://pool.example.io\";\n#[derive(Debug, Clone)]\npub struct Pool<'a> { links: Vec<&'a Link> }\nstruct Unit;\npub enum Mode { Fast(u8), Slow }\npub trait Grow { fn grow(&mut self, n: usize); fn twice(&mut self) { self.grow(2) } }\nimpl<'a> Grow for Pool<'a> {\n    fn grow(&mut self, n: usize) { for _ in 0..n { self.links.push(Link::open(HOME).unwrap()); } }\n}\nimpl Unit { pub(crate) async fn go<T: Into<u8>>(x: T) -> Result<T, Err> where T: Copy { println!(\"{}\", size(x)); parse::<u8>(r#\"a \"b(c)\"#)?; Ok('(') } }\nfn main() { Unit::go(1).await.map(|x| show(x)) }\n",
        {"Pool", "Unit", "Mode", "Grow", "Grow.twice", "Pool<'a>.grow", "Unit.go", "main"},
        [("Grow.twice", "self.grow"), ("Pool<'a>.grow", "self.links.push"), ("Pool<'a>.grow", "Link::open"), ("Pool<'a>.grow", "Link::open(HOME).unwrap"), ("Unit.go", "println"), ("Unit.go", "size"), ("Unit.go", "parse"), ("Unit.go", "Ok"), ("main", "Unit::go"), ("main", "Unit::go(1).await.map"), ("main", "show")],
        ["std::collections::{HashMap, HashSet}", "crate::net::Link"],
    ),
    "shop.php": (
        "<p>none(0)</p>\n<?php\nnamespace Shop;\nuse Shop\\Cart;\nrequire_once 'boot.php';\n$host = 'https://shop.example.de';\nfunction price($x) { return round($x->net() * rate()); }\nabstract class Till extends Base {\n  use Logs;\n  abstract public function close();\n  public static function make(array $a): Till { return new Till(load($a)); }\n  private function sum() { return self::total($this->rows->all()); } // no(1)\n}\n?>\n<b><?= price(3) ?></b> text(2)\n",
        {"price", "Till", "Till.close", "Till.make", "Till.sum"},
        [("<module>", "require_once"), ("price", "round"), ("price", "$x->net"), ("price", "rate"), ("Till.make", "load"), ("Till.sum", "self::total"), ("Till.sum", "$this->rows->all"), ("<module>", "price")],
        ["Shop\\Cart", "boot.php"],
    ),
    "lib/feed.rb": (
        "require 'net/http'\nrequire_relative('parse')\n\nmodule Feeds\n  HOST = 'feeds.example.fr'\n  class Feed < Base\n    attr_reader :url\n    def initialize(url)\n      @url = url if url.valid?\n    end\n\n    def self.open(path) = new(path)\n\n    def items\n      body = Net::HTTP.get(uri(\"/#{slug(@url)}/x(1)\"))\n      while more? do step(body) end\n      Parse.rows(body).map do |row|\n        puts row unless row.empty?\n        clean(row) { |x| x.strip }\n      end\n    end\n  end\nend\n\ndef main\n  Feeds::Feed.open('a').items.each { |i| show(i) } # no(2)\nend\n",
        {"Feeds", "Feed", "Feed.initialize", "Feed.open", "Feed.items", "main"},
        [("<module>", "require"), ("<module>", "require_relative"), ("<module>", "attr_reader"), ("Feed.initialize", "url.valid?"), ("Feed.open", "new"), ("Feed.items", "Net::HTTP.get"), ("Feed.items", "uri"), ("Feed.items", "slug"), ("Feed.items", "step"), ("Feed.items", "Parse.rows"), ("Feed.items", "Parse.rows(body).map"), ("Feed.items", "puts"), ("Feed.items", "row.empty?"), ("Feed.items", "clean"), ("Feed.items", "x.strip"), ("main", "Feeds::Feed.open"), ("main", "Feeds::Feed.open('a').items"), ("main", "Feeds::Feed.open('a').items.each"), ("main", "show")],
        ["net/http", "parse"],
    ),
}
LANGUAGE = {"java": "java", "cs": "csharp", "go": "go", "rs": "rust", "php": "php", "rb": "ruby"}


def of(name, text, what):
    return [r for r in grammars.grammar_rows(LANGUAGE[name.rsplit(".", 1)[1]], name, text) if r[0] == what]


@pytest.mark.parametrize("name", FILES)
def test_definitions_calls_and_imports(name):
    text, defs, calls, imports = FILES[name]
    assert {r[3].split("::", 1)[1] for r in of(name, text, "definition")} == defs
    assert [(r[3].split("::", 1)[1], r[4]) for r in of(name, text, "call")] == calls
    assert [r[3] for r in of(name, text, "import")] == imports and not of(name, text, "error")
    lines = text.split("\n")
    for r in of(name, text, "call"):  # a callee's place is that of its last name
        assert lines[r[8] - 1][r[9] :].startswith(r[4].replace("?->", "->").split(".")[-1].split("->")[-1].split("::")[-1].split(">")[-1])


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("Depot.java", [("HOST", "https://depot.example.org/v2", "depot.example.org")]), ("Clock.cs", [("Zone", "utc.example.net", "utc.example.net")]), ("mail/send.go", [("relay", "smtp.example.com", "smtp.example.com")]),
        ("src/pool.rs", [("HOME", "https://pool.example.io", "pool.example.io")]), ("shop.php", [("host", "https://shop.example.de", "shop.example.de")]), ("lib/feed.rb", [("HOST", "feeds.example.fr", "feeds.example.fr")]),
    ],
)
def test_assignments(name, want):
    assert [(r[3], r[4], r[5]) for r in of(name, FILES[name][0], "assignment")] == want


def test_kinds_extents_and_arguments():
    text = "class A {\n  @Get(\n    \"/x\")\n  public int f(\n      int a) {\n    return g(a,\n      h(\"}\"));\n  }\n}\n"
    assert [(r[4], r[5], r[6], r[7], r[8], r[9]) for r in of("A.java", text, "definition")] == [("A", "class", 1, 9, 1, 6), ("f", "method", 2, 8, 4, 13)]
    assert [(r[4], r[5], r[6]) for r in of("A.java", text, "call")] == [("g", "a,\n      h(\"}\")", 6), ("h", '"}"', 7)]
    ruby = "class K\n  def go\n    send_to host,\n      1\n  end\nend\n"
    assert [(r[4], r[5], r[6], r[7]) for r in of("k.rb", ruby, "definition")] == [("K", "class", 1, 6), ("go", "method", 2, 5)]
    assert [(r[4], r[5]) for r in of("k.rb", ruby, "call")] == [("send_to", "host,\n      1")]


@pytest.mark.parametrize("language", grammars.GRAMMARS)
def test_damaged_files_give_what_can_be_read(language):
    for odd in ("", "'", '"', "`", "/*", "}}}", "=>", "class", "def", "func", "fn", "import", "use", "impl", "impl<", "class A", "class A {", "(a", "a(/", "a.b(", "def x(", "func (", "type ( X struct {", "end end", '$"{', '"#{', "<<~EOS", "new", "using", 'r#"', "'", "a<b<", "@", "x ="):
        grammars.grammar_rows(language, "f", odd)
    assert [r[3] for r in grammars.grammar_rows(language, "f", "<?php f(1); g(" if language == "php" else "f(1); g(") if r[0] == "error"] == ["syntax_errors"]
    at = time.time()
    for many in ("f<" * 20_000, "f(" * 20_000, "a." * 20_000, "{" * 20_000, "class A { int f() " * 2_000, "x = " * 20_000, "if a " * 20_000):
        grammars.grammar_rows(language, "f", "<?php " * (language == "php") + many)
    assert time.time() - at < 10


def test_every_language_has_an_extractor(spark):
    assert set(extract.EXTRACTORS) == {"python", "javascript", "typescript", *grammars.GRAMMARS}
    files = spark.createDataFrame([(n, LANGUAGE[n.rsplit(".", 1)[1]], t[0], False, False) for n, t in FILES.items()], "path string, language string, text string, skipped boolean, is_config boolean")
    got = extract.tables(extract.extracted(files))
    assert got["definitions"].count() == sum(len(t[1]) for t in FILES.values()) and got["calls"].count() == sum(len(t[2]) for t in FILES.values())
