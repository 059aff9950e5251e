"""Structural search: patterns with metavariables matched on the tokens and matched brackets of sources, so that strings and comments never match."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from graphlens.operators import grammars, scripts
from graphlens.operators.lexer import BEGIN, CLOSE, OPEN, Lexicon, Tokens
from graphlens.schema import PATTERN_MATCHES

PATTERNS = "language string, label string, pattern string"
#: Most patterns of a search; they go to every task.
MAX_PATTERNS = 10_000
_PREFIXES = ("f", "F", "rf", "rF", "Rf", "RF", "fr", "fR", "Fr", "FR")
PYTHON = Lexicon(
    r"\s+|\\\n|\#[^\n]*", r'[rRbBuU]{0,2}(?:"""(?:\\.|[^\\])*?"""|' + r"'''(?:\\.|[^\\])*?'''|" + r'"(?:\\.|[^"\\\n])*"|' + r"'(?:\\.|[^'\\\n])*')", r"[^\W\d]\w*", r"->|:=|\*\*|\.\.\.|[=!<>]=",
    holes=tuple((p + q, (r"(?:\\.|\{\{|%s[^\\{%s])*" % (f"{q[0]}(?!{q[1:]})|" if len(q) == 3 else "", q[0] if len(q) == 3 else q + r"\n")), q, "{") for q in ('"""', "'''", '"', "'") for p in _PREFIXES),
)
LEXICONS = {"python": PYTHON, "javascript": scripts.LEXICON, "typescript": scripts.LEXICON} | {name: g.lexicon for name, g in grammars.GRAMMARS.items()}
_READY = {name: x.compiled() for name, x in LEXICONS.items()}
#: Marks behind which a name is a member of something, words behind which it is a definition, and languages in which a body right behind brackets makes a definition.
MEMBER = frozenset((".", "?.", "::", "->", "?->", "&."))
DEFINING = frozenset("def function func fn class new".split())
BODIED = frozenset(("javascript", "typescript", "java", "csharp"))

#: Calls of client libraries: languages, label, what is called with any arguments. Fixed values.
CLIENT_CALLS = (
    (("python",), "python-requests", ("requests.get", "requests.post", "requests.put", "requests.delete", "requests.patch", "requests.head", "requests.request", "requests.Session")),
    (("python",), "python-httpx", ("httpx.get", "httpx.post", "httpx.put", "httpx.delete", "httpx.patch", "httpx.request", "httpx.Client", "httpx.AsyncClient")),
    (("python",), "python-urllib", ("urllib.request.urlopen",)),
    (("python",), "python-http.client", ("http.client.HTTPConnection", "http.client.HTTPSConnection")),
    (("python",), "python-aiohttp", ("aiohttp.ClientSession",)),
    (("python",), "aws-sdk", ("boto3.client",)),
    (("javascript", "typescript"), "js-fetch", ("fetch",)),
    (("javascript", "typescript"), "js-axios", ("axios.get", "axios.post", "axios.put", "axios.delete", "axios.patch", "axios.request", "axios")),
    (("javascript",), "js-jquery", ("$.ajax",)),
    (("javascript", "typescript"), "node-http", ("http.request", "https.request", "http.get", "https.get")),
    (("javascript", "typescript"), "js-superagent", ("superagent.get", "superagent.post", "superagent.put", "superagent.delete")),
    (("javascript", "typescript", "java"), "grpc-client", ("new grpc.Client",)),
    (("go",), "go-net-http", ("http.Get", "http.Post", "http.NewRequest")),
    (("go",), "go-resty", ("resty.New",)),
    (("java",), "java-http-client", ("new HttpClient", "new RestTemplate", "new OkHttpClient")),
    (("csharp",), "java-http-client", ("new HttpClient", "new RestClient")),
    (("ruby",), "ruby-net-http", ("Net::HTTP.get", "Net::HTTP.post", "Net::HTTP.start", "Net::HTTP.new")),
    (("php",), "php-curl", ("curl_init",)),
    (("php",), "php-guzzle", ("new Client",)),
)


def client_patterns(spark: SparkSession) -> DataFrame:
    """PATTERNS of the client libraries."""
    return spark.createDataFrame([(language, label, f"{call}($$$ARGS)") for languages, label, calls in CLIENT_CALLS for language in languages for call in calls], PATTERNS)


@dataclass(frozen=True)
class Pattern:
    """parts: (what, text): `is` a token, `one` expression, `many` of anything inside the same brackets. twice: some name occurs twice, so what it stood for matters."""

    label: str
    parts: tuple[tuple[str, str], ...]
    twice: bool


_META = re.compile(r"\$\$\$([A-Z_][A-Z0-9_]*)?|\$([A-Z_][A-Z0-9_]*)")
_HELD = re.compile(r"meta_(one|many)_(\w*)_meta")


def compiled(language: str, label: str, pattern: str) -> Pattern:
    """A pattern in tokens of its language; $NAME is one expression (equal names are equal tokens, but for $_), $$$NAME any number of anything. A language without tokens and a pattern without any are errors."""
    if language not in LEXICONS:
        raise ValueError(f"no tokens are known for {language}")
    held = _META.sub(lambda m: f"meta_one_{m[2]}_meta" if m[2] else f"meta_many_{m[1] or ''}_meta", pattern)
    read = Tokens("", ("<?php " if LEXICONS[language].before else "") + held, LEXICONS[language], _READY[language])
    parts = tuple((m[1], m[2]) if (m := _HELD.fullmatch(x)) else ("is", x) for x in read.tok)
    if not parts or read.broken:
        raise ValueError(f"no pattern: {pattern!r}")
    names = [name for what, name in parts if what != "is" and name not in ("", "_")]
    return Pattern(label, parts, len(set(names)) < len(names))


class Search:
    """Patterns of one language by the token that they begin with."""

    def __init__(self, language: str, patterns: list[Pattern]):
        self.language = language
        self.first: dict[str, list[Pattern]] = {}
        self.open: list[Pattern] = [p for p in patterns if p.parts[0][0] != "is"]
        for p in patterns:
            if p.parts[0][0] == "is":
                self.first.setdefault(p.parts[0][1], []).append(p)

    def rows(self, file: str, text: str) -> list[tuple[str, int, str]]:
        """(file, line, label), each once, of one source."""
        t = Tokens(file, text, LEXICONS[self.language], _READY[self.language])
        found = {(t.place(i)[0], p.label): None for i, x in enumerate(t.tok) for p in (*self.first.get(x, ()), *self.open) if self._begins(t, i) and self._holds(t, p, i)}
        return [(file, line, label) for line, label in found]

    def _begins(self, t: Tokens, i: int) -> bool:
        """An expression can begin at token i."""
        return not (i and (t.is_mark(i - 1, *MEMBER) or t.word(i - 1, *DEFINING))) and not (t.kind[i] == "mark" and t.tok[i] in CLOSE)

    def _ends(self, t: Tokens, p: Pattern, i: int) -> bool:
        """What ends before token i is no head of a definition."""
        return not (self.language in BODIED and p.parts[-1] == ("is", ")") and p.parts[0][1] != "new" and t.is_mark(i, "{"))

    def _holds(self, t: Tokens, p: Pattern, begin: int) -> bool:
        """Does p match from token `begin` on? A search over (part, token); each state is entered once, so work follows parts times tokens. States carry what names stand for only where a name occurs twice."""
        parts, n = p.parts, len(t.tok)
        stack: list[tuple[int, int, int, tuple]] = [(0, begin, -1, ())]  # (part, token, where the part began or -1, names)
        seen = set()
        while stack:
            state = k, i, since, names = stack.pop()
            if state in seen:
                continue
            seen.add(state)
            if k == len(parts):
                if self._ends(t, p, i):
                    return True
                continue
            what, text = parts[k]
            if what == "is":
                if i < n and t.tok[i] == text:
                    stack.append((k + 1, i + 1, -1, names))
                elif text in CLOSE and t.is_mark(i, ",") and i + 1 < n and t.tok[i + 1] == text:
                    stack.append((k, i + 1, -1, names))  # a comma behind the last argument
                if text == "," and k + 2 < len(parts) and parts[k + 1][0] == "many" and parts[k + 2][1] in CLOSE:
                    stack.append((k + 2, i, -1, names))  # no further arguments, no comma
                continue
            start = i if since < 0 else since
            if what == "many" or i > start:
                bound = self._bound(t, p, names, text, start, i)
                if bound is not None:
                    stack.append((k + 1, i, -1, bound))
            to = self._next(t, i, what, lead=k == 0)
            if to is not None:
                stack.append((k, to, start if p.twice or what == "one" else -1, names))
        return False

    @staticmethod
    def _next(t: Tokens, i: int, what: str, lead: bool) -> int | None:
        """The token behind the one at i, or behind the brackets that open there; None where a part can't go on. One expression ends at commas, statements' ends and assignments; one that begins a pattern is a chain of names and brackets."""
        if i >= len(t.tok):
            return None
        mark = t.kind[i] == "mark"
        if mark and (t.tok[i] in OPEN or t.tok[i] == BEGIN):
            return t.partner[i] + 1 if i in t.partner else None
        if mark and t.tok[i] in CLOSE:
            return None
        if what == "one" and mark and (t.tok[i] in (",", ";", "=") or lead and t.tok[i] not in MEMBER):
            return None
        if what == "one" and lead and not mark and i and not t.is_mark(i - 1, *MEMBER) and t.kind[i - 1] != "mark" and t.place(i)[0] != t.place(i - 1)[0]:
            return None
        return i + 1

    @staticmethod
    def _bound(t: Tokens, p: Pattern, names: tuple, name: str, start: int, end: int) -> tuple | None:
        """names with this one bound to tokens start..end; None if it stands for other tokens already."""
        if not p.twice or name in ("", "_"):
            return names
        for known, a, b in names:
            if known == name:
                return names if t.tok[a:b] == t.tok[start:end] else None
        return (*names, (name, start, end))


def matches(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """graphlens.schema.PATTERN_MATCHES, each row once: the lines on which files(path, language, text, skipped) have code of a pattern of PATTERNS in their language.

    A name that begins a pattern is no member of something else (`requests.get(...)` isn't in `self.requests.get(...)`) and no definition. Null
    texts are empty; skipped files and languages without patterns give no row. Patterns go to every task: more than MAX_PATTERNS are an error.
    """
    rules = [tuple(r) for r in patterns.select("language", "label", "pattern").distinct().limit(MAX_PATTERNS + 1).collect()]
    if len(rules) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns")
    by: dict[str, list[Pattern]] = {}
    for language, label, pattern in sorted(rules):
        by.setdefault(language, []).append(compiled(language, label, pattern))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        searches = {language: Search(language, own) for language, own in by.items()}
        for pdf in batches:
            rows = [row for path, language, text in zip(pdf["path"], pdf["language"], pdf["text"], strict=True) for row in searches[language].rows(path, text or "")]
            out = pd.DataFrame(rows, columns=["file", "line", "label"])
            out["line"] = out["line"].astype("int32")
            yield out

    asked = files.where("not skipped").where(files["language"].isin(*by)).select("path", "language", "text") if by else files.limit(0).select("path", "language", "text")
    return asked.mapInPandas(run, PATTERN_MATCHES)
