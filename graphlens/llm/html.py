"""Main text of web pages by composite text density."""

from __future__ import annotations

import heapq
import html
import itertools
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import bounded, slices

#: Elements without content, without text of the page, of the frame around an article, and those that begin a new block. Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg select datalist".split())
FRAME = frozenset("nav footer aside button menu dialog label option".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: What the begin of an element ends, up to the elements in the second set. Fixed values of HTML.
_P_ENDS = BLOCK - frozenset("body br caption dd dt frameset head html legend li optgroup option summary tbody td tfoot th thead tr".split())
CLOSES = {"li": ("li", frozenset(("ul", "ol", "menu", "dir"))), "dt": ("dt dd", frozenset(("dl",))), "dd": ("dt dd", frozenset(("dl",))), "tr": ("tr td th", frozenset(("table",))), "td": ("td th", frozenset(("tr", "table"))), "th": ("td th", frozenset(("tr", "table"))), "tbody": ("thead tbody tfoot tr td th", frozenset(("table",))), "tfoot": ("thead tbody tfoot tr td th", frozenset(("table",))), "option": ("option", frozenset(("select",)))}
CLOSES = {k: (frozenset(a.split()), stop) for k, (a, stop) in CLOSES.items()}
_P_SCOPE = _P_ENDS | frozenset("p td th li dd dt caption body html".split())
_TEXT_ONLY = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Words in class, id or role that name parts around an article. A class counts by its words, split at case and at what is no letter.
AROUND = frozenset(
    "ad ads advert advertisement advertising adbox adsense sponsor sponsored promo promotion banner breadcrumb breadcrumbs comment comments commentlist respond reply replies disqus discussion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations sidebar sidenav widget widgets menu menubar nav navbar navigation navigationlandmark pagination pager toolbar topbar masthead footer foot header skip hidden outbrain taboola tags taglist contentinfo complementary search searchbox copyright legal disclaimer".split()
)
#: Those of them that wrappers of a whole page bear too (fixed-header, search-results), and those of single comments.
LAYOUT = frozenset("banner foot footer header hidden login masthead menu menubar nav navbar navigation search share sharing sidebar sidenav social tags toolbar topbar widget widgets".split())
COMMENT = frozenset("comment comments reply replies".split())
#: First words of classes that tell how a page is laid out, not what an element is: has-sidebar, overflow-hidden.
_STATE = frozenset("has no non not overflow with without".split())
#: Words of headings above lists of other pages, besides those of labels.
_MORE = frozenset("also archive categories keep latest more next popular previous read see top topics trending".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: What a label is: none; of layout words alone, or not shown; with another word; the id of a section, which a heading's text gives it as a rule; a form's or a header's element.
NONE, WRAPS, PART, SECTION, FORM, HEAD = range(6)
#: Elements that hold a page or its article, whatever is said about them; what a form's controls are; the nearest of those ends an open paragraph or keeps it.
_WHOLE = frozenset("html body main article".split())
_CONTROLS = frozenset("input button select textarea label option".split())
_CELLS = frozenset("td th table".split())
#: Characters for each control from which a form's text is no form's.
WORDY = 100
#: A part with a word that is no layout word is the article only if it holds this many times the text outside of all parts.
SURELY = 10
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"(?<![^\s\"'/])(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=[\s/\"'>]|\Z)", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class Node:
    """An element: its texts and children in page order, and the counts of its subtree."""

    __slots__ = ("chars", "code", "controls", "density", "ended", "items", "label", "link_chars", "links", "main", "name", "parent", "score", "tags")

    def __init__(self, name: str, parent: Node | None):
        self.name, self.parent, self.items, self.controls = name, parent, [], 0
        self.code = name in ("pre", "code") or parent is not None and parent.code
        self.chars = self.tags = self.link_chars = self.links = 0
        self.density = self.score = 0.0
        self.label, self.ended, self.main = NONE, False, name in ("article", "main")


def _hidden(attrs: str) -> bool:
    """The element is not shown, as long as no script changes that."""
    if "idden" in attrs.lower() or "style" in attrs.lower():
        for key, value in _ATTR.findall(attrs):
            key, value = key.lower(), value.strip("\"'")
            if key == "style":
                if _HIDDEN.search(value):
                    return True
            elif key in ("hidden", "aria-hidden") and value.lower() != "false":
                return True
    return False


def _words(value: str) -> set[str]:
    """The words of a class, id or role, but for classes that tell the layout."""
    found = [[w.lower() for w in _WORD.findall(x)] for x in html.unescape(value).split()]
    return {w for x in found if x and x[0] not in _STATE for w in x}


def _label(node: Node, attrs: str) -> None:
    """Set what the element's class, id and role tell. That is evidence alone: prune() weighs it. Inside code it tells nothing; the id of a heading, of an anchor or of another inline element is its text's or its target's name."""
    if "=" not in attrs or node.name in ("html", "body"):
        return
    words, by_id, section = set(), set(), node.name == "section"
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "role" and value.lower() in ("main", "article"):
            node.main = True
        elif key == "id":
            by_id |= _words(value)
        elif key in ("class", "role"):
            words |= (found := _words(value))
            section = section or (key == "class" and "section" in found)
    if node.main:
        node.main = not words & COMMENT
        return
    words &= AROUND
    by_id = by_id & AROUND if node.name in BLOCK and node.name not in _HEADINGS and node.name != "dt" else set()
    weak = section and not words
    if words | by_id and not (node.parent is not None and node.parent.code):
        node.label = SECTION if weak else WRAPS if words | by_id <= LAYOUT else PART


class _Path:
    """The open elements from the page down, with their depths by name, so that no tag climbs."""

    def __init__(self, root: Node):
        self.nodes, self.depths = [root], {"html": [0]}
        self.ends_p, self.cells = [0], []

    def push(self, node: Node) -> None:
        at = len(self.nodes)
        self.nodes.append(node)
        self.depths.setdefault(node.name, []).append(at)
        if node.name in _P_SCOPE:
            self.ends_p.append(at)
        if node.name in _CELLS:
            self.cells.append(at)

    def cut(self, depth: int) -> None:
        """Close all from this depth on."""
        while len(self.nodes) > depth:
            node = self.nodes.pop()
            self.depths[node.name].pop()
            if node.name in _P_SCOPE:
                self.ends_p.pop()
            if node.name in _CELLS:
                self.cells.pop()

    def close(self, name: str) -> Node | None:
        """The innermost open element of that name, closed with all in it; none if there is none, or an inline element outside the table cell."""
        found = self.depths.get(name)
        if not found or found[-1] == 0 or name not in BLOCK and name not in _CELLS and self.cells and self.cells[-1] > found[-1]:
            return None
        node = self.nodes[found[-1]]
        self.cut(found[-1])
        return node

    def begin(self, name: str) -> None:
        """Close what the begin of such an element ends."""
        if name in CLOSES:
            ends, stop = CLOSES[name]
            above = max((self.depths[x][-1] for x in stop if self.depths.get(x)), default=-1)
            first = [d[i] for x in ends if (d := self.depths.get(x)) and (i := bisect_right(d, above)) < len(d)]
            if first:
                self.cut(min(first))
        elif (name in _P_ENDS or name == "p") and self.nodes[self.ends_p[-1]].name == "p":
            self.cut(self.ends_p[-1])


def parse(page: str) -> Node:
    """The tree of a page, ready for any markup: unclosed and stray tags are handled as browsers do for the common cases, an unfinished tag at the end is dropped. Elements without text of the page, of the frame by their name, and what prune() takes for parts around the article are left out with all they hold."""
    root = Node("html", None)
    path, at, n = _Path(root), 0, len(page)
    partners: dict[str, dict[int, int]] = {}
    while at < n:
        node = path.nodes[-1]
        m = _TOKEN.search(page, at)
        if m is None:
            node.items.append(page[at:])
            break
        if m.start() > at:
            node.items.append(page[at : m.start()])
        at = m.end()
        close, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if close:
            ended = path.close(name)
            if ended is not None:
                ended.ended = True
            elif name == "p":
                node.items.append(Node("br", node))
            continue
        node.controls += name in _CONTROLS
        if name in RAW or name in FRAME:
            if name in _TEXT_ONLY:
                end = _ends(name, False).search(page, at)
                while end is not None and not end[1]:
                    end = _ends(name, False).search(page, end.end())
                at = end.end() if end is not None else n
            elif name not in VOID:
                if name not in partners:
                    partners[name] = _partners(page, name)
                at = partners[name].get(at, n if name == "footer" else at)
            node.items.append(Node("br", node) if name in BLOCK else "")
            continue
        path.begin(name)
        node = path.nodes[-1]
        child = Node(name, node)
        node.items.append(child)
        if name not in VOID:
            _label(child, attrs)
            if name not in _WHOLE and not child.main:
                if name in ("form", "fieldset"):
                    child.label = FORM
                elif name == "header":
                    child.label = HEAD
                if _hidden(attrs):
                    child.label = WRAPS
            path.push(child)
    return prune(root)


def _in_order(root: Node) -> list[Node]:
    """The nodes in page order."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in reversed(node.items) if isinstance(x, Node)]
    return order


def prune(root: Node) -> Node:
    """Leave out the labelled parts, but for those whose label is a wrapper's or a section's.

    Text is counted without links. Of the labelled elements that have an end tag, a link list stays a part unless it holds an article or main
    element. One of layout words is no part if it holds more text, or more of the articles' text, than is outside of all parts. Another is none
    if it holds SURELY times as much text, or so much of the articles' and more text than is outside: comments and notices may well be
    longer than an article. A section's id makes a part only beside an article element. What turns out to be no part counts as outside, but for
    the parts in it, which are weighed next. A form with much text for each of its controls is none, nor is a header with a heading inside an
    article or beside paragraphs. What is not shown counts as a wrapper: scripts hide whole pages until they are ready.
    """
    order = _in_order(root)
    if not any(x.label and x.ended for x in order):
        return root
    text, free, article, inner = {}, {}, {}, {}  # by node: characters, those outside links, those of articles, the outermost labelled nodes below
    controls, titled = {}, {}  # controls of forms, and whether there is a heading
    for x in reversed(order):
        below = [y for y in x.items if isinstance(y, Node)]
        controls[x] = x.controls + sum(controls[y] for y in below)
        titled[x] = x.name in _HEADINGS or any(titled[y] for y in below)
        own = sum(len(y.strip()) for y in x.items if isinstance(y, str))
        text[x] = own + sum(text[y] for y in below)
        free[x] = 0 if x.name == "a" else own + sum(free[y] for y in below)
        article[x] = free[x] if x.main else sum(article[y] for y in below)
        inner[x] = [z for y in below for z in ([y] if y.label and y.ended else inner.pop(y))]
    rest, held = (of[root] - sum(of[x] for x in inner[root]) for of in (free, article))
    in_main = {root: root.main}
    for x in order[1:]:
        in_main[x] = x.main or in_main[x.parent]
    count = itertools.count()
    todo: list[tuple] = []
    gone: set[Node] = set()

    def weigh(found: list[Node]) -> None:
        for x in found:
            heapq.heappush(todo, (-(free[x] + article[x]) / (SURELY if x.label in (PART, SECTION) else 1), next(count), x))

    weigh(inner[root])
    while todo:
        x = heapq.heappop(todo)[2]
        if x.label == HEAD and titled[x] and 2 * free[x] >= text[x] and (in_main[x] or sum(isinstance(y, Node) and y.name == "p" for y in x.parent.items) > 1):
            part = False
        elif x.label == FORM and free[x] > WORDY * (controls[x] + 1):
            part = False
        elif x.label == SECTION:
            part = held > 0 and not in_main[x] and not article[x]
        elif 2 * free[x] < text[x] and not article[x]:
            part = True
        elif x.label in (WRAPS, FORM, HEAD):
            part = free[x] <= rest and article[x] <= held
        else:
            part = free[x] <= SURELY * rest and (article[x] <= SURELY * held or free[x] <= rest)
        if part:
            gone.add(x)
        else:
            rest += free[x] - sum(free[y] for y in inner[x])
            held += article[x] - sum(article[y] for y in inner[x])
            weigh(inner[x])
    for up in {x.parent for x in gone}:
        up.items = [y if y not in gone else Node("br", up) if y.name in BLOCK else "" for y in up.items]
    return root


@lru_cache(maxsize=256)
def _ends(name: str, nested: bool) -> re.Pattern:
    """Tags of one name, and comments where tags in comments don't count."""
    return re.compile(rf"<(/?){re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)" + ("|<!--.*?(?:-->|\\Z)" if nested else ""), re.IGNORECASE | re.DOTALL)


def _partners(page: str, name: str) -> dict[int, int]:
    """By the place behind each begin of an element of this name, the place behind its end; elements of its name inside count, those without an end have none."""
    out, open_ = {}, []
    for m in _ends(name, True).finditer(page):
        if m[1] is None:
            continue
        if not m[1]:
            open_.append(m.end())
        elif open_:
            out[open_.pop()] = m.end()
    return out


def measure(root: Node) -> list[Node]:
    """Count characters, tags, link characters and link tags of each subtree and set its composite density and density sum; nodes in page order.

    With C characters, T tags, LC and LT those in links, and c and lc of the body: density = C / T * log base (log(C * LC / (C - LC) + lc * C / c + e)) of
    (C * T / (LC * LT)), where a count of 0 in a denominator is 1. The density sum of a node is that of its children that are blocks; text in inline elements is their block's.
    """
    order = _in_order(root)
    for node in reversed(order):
        link = node.name == "a"
        for x in node.items:
            if isinstance(x, Node):
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.links += x.links + (x.name == "a")
            else:
                node.chars += len(x) if x.isascii() and not x[:1].isspace() else len(x.strip())
        if link:
            node.link_chars = node.chars
    c, lc = max(root.chars, 1), root.link_chars
    for node in order:
        if node.chars:
            free = max(node.chars - node.link_chars, 1)
            base = math.log(node.chars * node.link_chars / free + lc * node.chars / c + math.e)
            arg = node.chars * max(node.tags, 1) / (max(node.link_chars, 1) * max(node.links, 1))
            node.density = node.chars / max(node.tags, 1) * (math.log(arg) / math.log(base) if base > 1 + 1e-9 else math.log(arg) if arg > 0 else 0.0)
    for node in order:
        node.score = sum(x.density for x in node.items if isinstance(x, Node) and x.name in BLOCK)
    return order


def choose(order: list[Node]) -> list[Node]:
    """The subtree with the greatest density sum (the whole article element if it is in one), and beside its path to the body those blocks that are as dense as the path's least dense node and mostly not links; in page order.

    Without any block below another the densest node is the subtree. An article element is taken without what is around it, but for the articles beside it.
    """
    if not order or not order[0].chars:
        return []
    best = max(order, key=lambda x: x.score)
    if not best.score:
        best = max(order, key=lambda x: x.density)
    node = best
    while node is not None:
        if node.name == "article":
            if node.parent is None:
                return [node]
            beside = [x for x in node.parent.items if isinstance(x, Node) and x.name == "article" and x.main and 2 * x.link_chars < x.chars]
            return beside if node in beside else [node]
        node = node.parent
    chosen, node, least = {id(best)}, best, best.density
    while node.parent is not None:
        node = node.parent
        least = min(least, node.density)
    node = best
    while node.parent is not None:
        chosen.update(id(x) for x in node.parent.items if isinstance(x, Node) and x is not node and x.name in BLOCK and x.chars and x.density >= least and 2 * x.link_chars < x.chars)
        node = node.parent
    return [x for x in order if id(x) in chosen]


def _menu(x: Node) -> bool:
    """A list or box inside an article that is little but links; numbered lists and lists under a heading that doesn't call them related are references."""
    if x.links <= 2 or 4 * x.link_chars <= 3 * x.chars or x.name not in ("ul", "div", "section", "table"):
        return False
    before = None
    for y in x.parent.items if x.parent is not None and x.name == "ul" else ():
        if y is x:
            break
        before = y if isinstance(y, Node) else before if not y.strip() else None
    return before is None or before.name not in _HEADINGS or bool({w.lower() for w in _WORD.findall(text_of([before]))} & (AROUND | _MORE))


def text_of(nodes: list[Node]) -> str:
    """The blocks of nodes in page order: character references decoded, white space inside a block one space, blocks joined by one space."""
    out: list[str] = []
    for top in nodes:
        todo: list = [top]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
                continue
            if x.name in BLOCK:
                out.append("\n")
                todo.append("\n")
                if x is not top and _menu(x):
                    continue
            todo += reversed(x.items)
        out.append("\n")
    return " ".join(html.unescape("".join(out)).split())


def main_text(page: str) -> str:
    """The article of one whole page; empty if there is none."""
    return text_of(choose(measure(parse(page))))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text string, n_chars long: code points), a row for each row of pages. Null and empty html give an empty text; repeated rows repeat; other columns are not looked at. No row gives no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in slices(batches, "html"):
            made = [main_text(x.decode(errors="replace")) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string()), pa.array([len(x) for x in made], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    plain = bounded(pages).select(F.col("`page_id`").alias("page_id"), F.col("`url`").alias("url"), F.coalesce(F.col("`html`"), F.lit("")).alias("html"))
    return plain.mapInArrow(run, f"page_id {plain.schema['page_id'].dataType.simpleString()}, url {plain.schema['url'].dataType.simpleString()}, text string, n_chars long")
