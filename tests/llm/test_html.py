"""Main text of pages: the driver's pages against their article element, and hand-made pages of other builds."""

import html as stdlib
import random
import re

import pytest

from graphlens.llm import html

LONG = ["The first paragraph of this story is long enough to count as text of its own, and it goes on.", "A second paragraph follows it, <b>with</b> some <a href='/x'>link</a> in it, and says a few things more.", "The third one ends the story with a remark &amp; a caf&eacute;, as stories do when they come to an end."]
P = "".join(f"<p>{x}</p>" for x in LONG)
WANT = " ".join(stdlib.unescape(re.sub("<[^>]*>", "", x)) for x in LONG)
LINKS = "<ul>" + "".join(f"<li><a href='/{k}'>Story {k}</a></li>" for k in range(9)) + "</ul>"
PAGES = {
    "plain": (f"<html><body>{P}</body></html>", WANT),
    "wrapped": (f"<body><div id=wrap><div class='main-nav'>{LINKS}</div><div class=content><h1>A title for it</h1>{P}</div><div class='sidebar'><p>{LONG[0]}</p></div></div></body>", "A title for it " + WANT),
    "unlabelled menu": (f"<body><div>{LINKS}</div><div>{P}</div><div>{LINKS}</div></body>", WANT),
    "two parts": (f"<body><div><div>{P}</div><div>{P}</div></div></body>", f"{WANT} {WANT}"),
    "comments": (f"<main>{P}</main><section id='comments'><h2>Comments</h2><p>{LONG[0]}</p><p>{LONG[2]}</p></section>", WANT),
    "cookie notice": (f"<div class='cookie-notice'><p>{LONG[0]}</p></div><article>{P}</article><div role=contentinfo>{LONG[1]}</div>", WANT),
    "camel case": (f"<div class=cookieBanner><p>{LONG[0]}</p></div><article>{P}</article>", WANT),
    "hidden": (f"<div style='display: none'>{P}</div><div hidden>{P}</div><div>{P}</div>", WANT),
    "forms and scripts": (f"<article><script>var x='<p>no</p></article>';</script><style>p > b {{}}</style>{P}<form><p>Your name <input><select><option>a<option>b</select></form><noscript>no</noscript></article>", WANT),
    "unclosed": (f"<body><article><p>{LONG[0]}<p>{LONG[2]}<footer>foot", f"{LONG[0]} " + stdlib.unescape(LONG[2])),
    "cut off": (f"<body><article>{P}<p cla", WANT),
    "blocks and spaces": ("<article><p>one\n two &nbsp;\t three</p>four<br>five<b>six</b><table><tr><td>7<td>8</table></article>", "one two three four fivesix 7 8"),
    "list of an article": (f"<article>{P}<ul><li>red<li>green<li>blue</ul></article>", WANT + " red green blue"),
    "words that only look like labels": (f"<article class='adventure threads shadow header-less'>{P}</article>", WANT),
    "a comment with tags": (f"<!-- <p>no</p> --><article>{P}<!-- unfinished", WANT),
    "formula": (f"<article>{P}<p>The sum <math><mi>a</mi>+<mi>b</mi></math> is <video src=x>shown <b>here</b></video> and <object data=y>there</object>.</p></article>", WANT + " The sum a+b is shown here and there."),
    "page in a form": (f"<body><form id=aspnetForm><input type=hidden name=v><div id=top>{LINKS}</div><div class=post><h1>Title</h1>{P}</div><div><label>Search</label> <input> <button>Go</button></div></form></body>", "Title " + WANT),
    "body hidden at first": (f"<html><body style='display:none'><nav>{LINKS}</nav><article>{P}</article></body></html>", WANT),
    "root hidden at first": (f"<html style='visibility: hidden'><body><div>{P}</div></body></html>", WANT),
    "hidden application": (f"<body><div hidden id=app><header>{LINKS}</header><article>{P}</article></div></body>", WANT),
    "hidden application without an article": (f"<body><div id=app aria-hidden=true><div>{LINKS}</div><div>{P}</div></div><noscript>Loading</noscript></body>", WANT),
    "fieldset around paragraphs": (f"<article>{P}<fieldset><legend>Note</legend><p>{LONG[0]}</p><p>{LONG[0]}</p></fieldset></article>", f"{WANT} Note {LONG[0]} {LONG[0]}"),
    "fieldset of a form": (f"<article>{P}<fieldset><legend>Your vote</legend><label>Yes <input type=radio></label><label>No <input type=radio></label></fieldset></article>", WANT),
    "two articles of a main": (f"<main><article>{P}</article><article><h2>Next</h2>{P}</article><aside>{LINKS}</aside></main>", f"{WANT} Next {WANT}"),
    "article and reader comments as articles": (f"<div><article>{P}</article><article class='comment'><p>{LONG[0]}</p></article></div>", WANT),
    "header of the article": (f"<body><header><h1>The site</h1>{LINKS}</header><article><header><h1>The title</h1></header>{P}</article></body>", "The title " + WANT),
    "header beside paragraphs": (f"<div id=c><header><h2>The title</h2></header>{P}</div><div>{LINKS}</div>", "The title " + WANT),
    "numbered references": (f"<article>{P}<ol><li><a href=a>First source</a><li><a href=b>Second source</a><li><a href=c>Third source</a></ol></article>", WANT + " First source Second source Third source"),
    "references under a heading": (f"<article>{P}<h2>Sources</h2><ul><li><a href=a>First</a><li><a href=b>Second</a><li><a href=c>Third</a></ul></article>", WANT + " Sources First Second Third"),
    "related pages under a heading": (f"<article>{P}<h2>Read more</h2><ul><li><a href=a>First</a><li><a href=b>Second</a><li><a href=c>Third</a></ul></article>", WANT + " Read more"),
    "nothing": ("<html><head><title>t</title></head><body><nav>a</nav></body></html>", ""),
    "text alone": ("Just a text.", "Just a text."),
    "empty": ("", ""),
    "no markup": ("a < b &lt; c > d", "a < b < c > d"),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, want = PAGES[name]
    assert html.main_text(page) == want


def article(page):
    m = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", page, re.DOTALL)
    body = re.sub(r"<(?=[^>]*\Z).*", "", m[1] if m else "", flags=re.DOTALL)
    return " ".join(stdlib.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)[^>]*>", " \n ", body))).split())


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        x = got[r.page_id]
        assert (x.url, x.text, x.n_chars) == (r.url, article(r.html), len(article(r.html)))


def test_edge_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", None, "a", 1), (1, "u", None, "a", 1), (None, None, PAGES["plain"][0], "b", 2), (2, "v", "<p>" * 3000 + "deep", "c", 3), (3, "w", "<div " * 2000, "d", 4), (4, "x", "x" * 200_000, "e", 5)]
    got = sorted(f"{r.page_id} {r.url} {r.n_chars}" for r in html.extract(spark.createDataFrame(rows, schema)).collect())
    assert got == sorted(["1 u 0", "1 u 0", f"None None {len(WANT)}", "2 v 4", "3 w 0", "4 x 200000"])
    assert html.extract(spark.createDataFrame([], schema)).count() == 0


AFTER = {"footer": "<footer>foot</footer>", "script": "<script>var x = '<p>no</p>';</script>", "style": "<style>p {}</style>", "nav": "<nav>menu</nav>", "form": "<form>ask</form>", "sidebar": "<div class=sidebar><p>aside</p></div>"}
KEPT = {"list": ("<ul><li>red<li>green</ul>", "red green"), "definitions": ("<dl><dt>red<dd>green</dl>", "red green"), "table": ("<table><thead><tr><th>red<tbody><tr><td>green<tfoot><tr><td>blue</table>", "red green blue")}


@pytest.mark.parametrize("after", AFTER)
@pytest.mark.parametrize("kept", KEPT)
def test_left_out_parts_after_lists_and_tables(kept, after):
    inside, words = KEPT[kept]
    assert html.main_text(f"<article>{P}{inside}{AFTER[after]}<p>end</p></article>{AFTER[after]}") == f"{WANT} {words} end"
    assert html.main_text(f"<article>{P}{inside}</article>{AFTER[after]}{AFTER[after]}") == f"{WANT} {words}"


SIDE = f"<div class=sidebar><p>{LONG[0]}</p></div>"
TALK = "<div id=comments>" + f"<div class=comment><p>{LONG[0]}</p></div>" * 9 + "</div>"
WRAPPERS = ["class='content has-sidebar'", "id=wrap class='no-sidebar'", "class='page fixed-header'", "class='search-results'", "class='overflow-hidden'", "class='site header-wide'", "id=legal", "class='comments-page'"]
LABELS = {
    "section by id": (f"<article><section id='intro'>{P}</section><section id='related-work'><h2>Related work</h2>{P}</section></article>", f"{WANT} Related work {WANT}"),
    "section without an article": (f"<body><div><section id='intro'>{P}</section><section id='social-history'>{P}</section></div>", f"{WANT} {WANT}"),
    "section as a div": (f"<main><div class=section id=search>{P}</div><div class=section id=intro>{P}</div></main>", f"{WANT} {WANT}"),
    "heading by id": (f"<article><h2 id='legal-status'>Legal status</h2>{P}</article>", "Legal status " + WANT),
    "anchor by id": (f"<article><h2><span id='Related'>Related</span></h2>{P}</article>", "Related " + WANT),
    "code": (f"<article>{P}<pre>x = 1 <span class='hljs-comment'># one</span></pre></article>", f"{WANT} x = 1 # one"),
    "parts in an article": (f"<article><div class=share>Tell it</div>{P}<div class='related'><p>{LONG[0]}</p></div></article>", WANT),
    "more comments than article": (f"<body><div class=post>{P}</div>{TALK}", WANT),
    "comments that are articles": (f"<body><article>{P}</article><div id=comments>" + f"<article class=comment>{P}</article>" * 5 + "</div>", WANT),
    "two wrappers": (f"<div class='page fixed-header'><div class='search-results'><div>{P}</div>{SIDE}{TALK}</div></div><div class=footer>{LONG[1]}</div>", WANT),
    "menus alone": (f"<body><div class=menu>{LINKS}</div>", ""),
}


@pytest.mark.parametrize("inside", ["<article>{}</article>", "<main>{}</main>", "<div>{}</div>"])
@pytest.mark.parametrize("label", WRAPPERS)
def test_labelled_wrapper_of_the_page(label, inside):
    assert html.main_text(f"<body><div class=site-header>Site</div><div {label}><div class=main-nav>{LINKS}</div>{inside.format(P)}{SIDE}</div><div class=footer>Foot</div></body>") == WANT


@pytest.mark.parametrize("name", LABELS)
def test_labels_are_evidence_alone(name):
    page, want = LABELS[name]
    assert html.main_text(page) == want


def test_many_labelled_parts():
    assert html.main_text("<body>" + "<div class=ad>x</div>" * 50_000 + f"<div>{P}</div>" + "<div class=ad>" * 3000) == WANT


@pytest.mark.parametrize("seed", range(4))
def test_any_order_of_tags_has_a_text(seed):
    rng = random.Random(seed)
    names = sorted(html.BLOCK | html.VOID | html.RAW | html.FRAME | {"a", "b", "span", "math"})
    attrs = ["", "", "", " class=sidebar", " id='comments'", " hidden", " role=main", ' class="has-sidebar x"', " style='display:none'", " class"]
    for _ in range(700):
        parts = [rng.choice(["<{0}{1}>", "</{0}>", "text &amp; more ", "<{0}{1}/>", "<!-- {0} -->", "<{0}", " "]).format(rng.choice(names), rng.choice(attrs)) for _ in range(rng.randrange(60))]
        assert isinstance(html.main_text("".join(parts)), str)


@pytest.mark.parametrize("page", ["<b>" * 16_000 + "</i>" * 16_000, "<div class=menu-x>" * 16_000, "<b><table><tr><td>" + "<i>" * 16_000 + "</b>" * 16_000, "<nav>" * 16_000 + "</nav>", "<li>" * 16_000, "<p>" * 16_000 + "</p>" * 16_000, "<td>" * 16_000 + "</span>" * 16_000, "<script>" * 16_000, "<svg>" * 16_000 + "x", "<ul><li>" * 16_000, "<pre>" + "<div id=ad>" * 16_000, "<form><fieldset>" * 8_000 + "</form>" * 8_000], ids=lambda p: p[:24])
def test_time_follows_the_tags(page):
    import time

    at = time.time()
    html.main_text(page)
    assert time.time() - at < 4


def test_densities_by_definition():
    """Counts and densities of each node worked out from its own subtree."""
    import math

    rng = random.Random(4)

    def below(x):
        return [y for c in x.items if isinstance(c, html.Node) for y in (c, *below(c))]

    def chars(x, linked=False):
        return sum(chars(c, linked or x.name == "a") if isinstance(c, html.Node) else len(c.strip()) * (not of_links or linked or x.name == "a") for c in x.items)

    for _ in range(60):
        page = "".join(rng.choice(["<div>", "</div>", "<p>", "</p>", "<a href=x>", "</a>", "<b>", "</b>", "some text", "more", "<br>", "<li>"]) for _ in range(rng.randrange(40)))
        order = html.measure(html.parse(page))
        root = order[0]
        for x in order:
            of_links = False
            c, tags, links = chars(x), len(below(x)), sum(y.name == "a" for y in below(x))
            all_c = max(chars(root), 1)
            of_links = True
            lc, all_lc = chars(x), chars(root)
            assert (x.chars, x.tags, x.links, x.link_chars) == (c, tags, links, lc)
            if c:
                base = math.log(c * lc / max(c - lc, 1) + all_lc * c / all_c + math.e)
                arg = c * max(tags, 1) / (max(lc, 1) * max(links, 1))
                assert x.density == pytest.approx(c / max(tags, 1) * (math.log(arg) / math.log(base) if base > 1 + 1e-9 else math.log(arg) if arg > 0 else 0))
            assert x.score == pytest.approx(sum(y.density for y in x.items if isinstance(y, html.Node) and y.name in html.BLOCK))
