"""Definitions, calls, imports and assignments out of source text: a syntax tree for Python, tokens for the languages of operators.scripts and operators.grammars, line patterns for others."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.functions.hosts import HOLE, authority
from graphlens.operators.grammars import GRAMMARS, grammar_rows
from graphlens.operators.lexer import MAX_ARG
from graphlens.operators.scripts import script_rows

OPAQUE = "<expr>"

ROWS = "what string, file string, ord int, a string, b string, c string, line int, end_line int, l2 int, col int"

Row = tuple[str, str, int, str | None, str | None, str | None, int | None, int | None, int | None, int | None]


def dotted(node: ast.expr) -> str:
    """a.b.c of names and attributes; <expr> at any other base; an awaited base counts as itself."""
    if isinstance(node, ast.Await):
        return dotted(node.value)
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return f"{dotted(node.value)}.{node.attr}"
    return OPAQUE


def argument_text(node: ast.Call) -> str:
    """Positional arguments as source: constants as Python writes them, names, else unparsed; cut to MAX_ARG each."""
    out = []
    for a in node.args:
        try:
            text = repr(a.value) if isinstance(a, ast.Constant) else a.id if isinstance(a, ast.Name) else ast.unparse(a)
        except (ValueError, RecursionError):
            text = OPAQUE
        out.append(text[:MAX_ARG])
    return ", ".join(out)


def string_value(node: ast.expr) -> tuple[str | None, str | None]:
    """(value as written, host) of a string; an f-string needs a host without interpolation. (None, None) for others."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return node.value, authority(node.value) or node.value
    if isinstance(node, ast.JoinedStr):
        shown = "".join(str(v.value) if isinstance(v, ast.Constant) else "{" + ast.unparse(v.value) + "}" for v in node.values)
        masked = "".join(str(v.value) if isinstance(v, ast.Constant) else HOLE for v in node.values)
        host = authority(masked)
        if HOLE not in masked:
            return shown, host or shown
        if host and HOLE not in host:
            return shown, host
    return None, None


class _Python(ast.NodeVisitor):
    """One walk: rows in source order. Calls belong to the innermost function, or to the module."""

    def __init__(self, file: str):
        self.file, self.rows, self.owner, self.cls, self.n = file, [], f"{file}::<module>", None, 0

    def add(self, what: str, a=None, b=None, c=None, line=None, end=None, l2=None, col=None) -> None:
        self.rows.append((what, self.file, self.n, a, b, c, line, end, l2, col))
        self.n += 1

    def _define(self, node, kind: str, name: str) -> None:
        line = node.lineno
        where = node.col_offset + {"class": 6, "def": 4, "async": 10}["class" if isinstance(node, ast.ClassDef) else "async" if isinstance(node, ast.AsyncFunctionDef) else "def"]
        self.add("definition", f"{self.file}::{name}", node.name, kind, line, node.end_lineno, line, where)

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self._define(node, "class", node.name)
        for x in [*node.decorator_list, *node.bases, *(k.value for k in node.keywords)]:
            self.visit(x)
        before, self.cls = self.cls, node.name
        for x in node.body:
            self.visit(x)
        self.cls = before

    def visit_FunctionDef(self, node) -> None:
        name = f"{self.cls}.{node.name}" if self.cls else node.name
        self._define(node, "method" if self.cls else "function", name)
        for x in [*node.decorator_list, *node.args.defaults, *(d for d in node.args.kw_defaults if d)]:
            self.visit(x)
        before, self.owner = self.owner, f"{self.file}::{name}"
        for x in node.body:
            self.visit(x)
        self.owner = before

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Call(self, node: ast.Call) -> None:
        f = node.func.value if isinstance(node.func, ast.Await) else node.func
        name = dotted(f)
        tail = name.rsplit(".", 1)[-1]
        self.add("call", self.owner, name, argument_text(node), node.lineno, None, f.end_lineno, max(0, f.end_col_offset - len(tail.encode())) if name != OPAQUE else -1)
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        for x in node.names:
            self.add("import", x.name, line=node.lineno)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for x in node.names:
            self.add("import", f"{node.module}.{x.name}" if node.module else x.name, line=node.lineno)

    def _assign(self, targets: list[ast.expr], value: ast.expr | None, line: int) -> None:
        if value is not None:
            shown, host = string_value(value)
            for t in targets:
                if isinstance(t, ast.Name):
                    self.add("assignment", t.id, shown, host, line)

    def visit_Assign(self, node: ast.Assign) -> None:
        self._assign(node.targets, node.value, node.lineno)
        self.generic_visit(node)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self._assign([node.target], node.value, node.lineno)
        self.generic_visit(node)


def python_rows(file: str, text: str) -> list[Row]:
    """Rows of a Python file; one error row if it is no Python."""
    try:
        tree = ast.parse(text)
        walk = _Python(file)
        walk.visit(tree)
        return walk.rows
    except (SyntaxError, ValueError, MemoryError, RecursionError) as e:
        return [("error", file, 0, "syntax_errors", str(e)[:200], None, getattr(e, "lineno", None), None, None, None)]


#: Line patterns of languages without an extractor, tried in order.
IMPORT_LINES = (r"^\s*import\s+(?:[\w*{},\s]+\s+from\s+)?['\"]([^'\"]+)['\"]", r"\brequire(?:_relative)?\s*\(?\s*['\"]([^'\"]+)['\"]", r"^\s*(?:import|using|use)\s+([\w.:\\]+)", r"^\s*#include\s+[<\"]([^>\"]+)[>\"]", r"^\s*from\s+([\w.]+)\s+import\b")
FUNCTION_LINES = (r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)", r"^\s*func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+([A-Za-z_]\w*)", r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>", r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!]?)", r"^\s*(?:(?:public|private|protected|static|final|async|override|virtual|internal)\s+)+[\w<>\[\],.?\s]*?\b([A-Za-z_]\w*)\s*\([^;]*$")
CLASS_LINES = (r"^\s*(?:export\s+)?(?:default\s+)?(?:(?:public|private|protected|abstract|final|static|sealed)\s+)*(?:class|interface|struct|trait|enum|module)\s+([A-Za-z_]\w*)", r"^\s*type\s+([A-Za-z_]\w*)\s+struct\b", r"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?([A-Za-z_]\w*)")
_CALL = re.compile(r"([A-Za-z_$][\w$]*(?:(?:\.|::)[A-Za-z_$][\w$]*)*)\s*\(([^()]*)\)")
KEYWORDS = frozenset("if for while switch catch return function func fn def class new await typeof sizeof else elif match".split())
_COMMENT = re.compile(r"^\s*(?:#(?!include)|//|\*|/\*)")


def line_rows(file: str, text: str) -> list[Row]:
    """Rows of a file by line patterns: classes and functions by indentation-free brace depth, imports, calls with simple arguments. A definition's end is unknown."""
    rows: list[Row] = []
    depth, scopes = 0, []  # (depth at which it began, kind, name)

    def add(what: str, a=None, b=None, c=None, line=None) -> None:
        rows.append((what, file, len(rows), a, b, c, line, None, None, -1))

    for n, line in enumerate(text.splitlines(), 1):
        if _COMMENT.match(line):
            continue
        if found := next((m for p in IMPORT_LINES if (m := re.search(p, line))), None):
            add("import", found[1], line=n)
        name = kind = None
        if m := next((m for p in CLASS_LINES if (m := re.match(p, line))), None):
            name, kind = m[1], "class"
            add("definition", f"{file}::{name}", name, "class", n)
        elif (m := next((m for p in FUNCTION_LINES if (m := re.match(p, line))), None)) and m[1] not in KEYWORDS:
            # A Go method names its type before its own name.
            receiver = re.match(r"^\s*func\s+\(\s*\w*\s*\*?\s*([A-Za-z_]\w*)", line)
            owner = receiver[1] if receiver else next((x for _, k, x in reversed(scopes) if k == "class"), None)
            name, kind = f"{owner}.{m[1]}" if receiver else m[1], "method" if owner else "function"
            add("definition", f"{file}::{owner}.{m[1]}" if owner else f"{file}::{m[1]}", m[1], kind, n)
        else:
            own = [(k, x) for _, k, x in scopes]
            cls = next((x for k, x in reversed(own) if k == "class"), None)
            fun = next((x for k, x in reversed(own) if k != "class"), None)
            caller = f"{file}::{cls}.{fun}" if cls and fun and "." not in fun else f"{file}::{fun or '<module>'}"
            for c in _CALL.finditer(line):
                if c[1] not in KEYWORDS:
                    add("call", caller, c[1], c[2].strip()[:MAX_ARG], n)
            if m := re.match(r"""^\s*(?:const\s+|let\s+|var\s+)?([A-Za-z_$][\w$]*)\s*(?::\s*\w+\s*)?:?=\s*['"]([^'"]{3,200})['"]""", line):
                add("assignment", m[1], m[2], authority(m[2]) or m[2], n)
        if name and "{" in line:
            scopes.append((depth, kind, name))
        depth += line.count("{") - line.count("}")
        while scopes and depth <= scopes[-1][0] and "}" in line:
            scopes.pop()
    return rows


#: Extractors by language; others go by line patterns. A parser package can be plugged in here.
EXTRACTORS: dict[str, Callable[[str, str], list[Row]]] = {"python": python_rows, "javascript": script_rows, "typescript": script_rows} | {x: partial(grammar_rows, x) for x in GRAMMARS}


def extracted(files: DataFrame) -> DataFrame:
    """ROWS of every file that isn't skipped; a file whose extractor fails gives an error row instead of failing the task."""
    extractors = dict(EXTRACTORS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in ROWS.split(", ")]
        for pdf in batches:
            rows: list[Row] = []
            for path, language, text in zip(pdf["path"], pdf["language"], pdf["text"], strict=True):
                try:
                    rows += extractors.get(language, line_rows)(path, text or "")
                except Exception as e:  # noqa: BLE001  an extractor's failure is a row
                    rows.append(("error", path, 0, "parse_exception", f"{type(e).__name__}: {e}"[:200], None, None, None, None, None))
            out = pd.DataFrame(rows, columns=names)
            for c in ("ord", "line", "end_line", "l2", "col"):
                out[c] = out[c].astype("Int32")
            yield out

    code = files.where("not skipped and not is_config and language <> 'other'").select("path", "language", "text")
    return code.mapInPandas(run, ROWS)


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    """definitions, calls, imports, assignments and errors out of extracted rows (write those first: each table reads them)."""
    of = lambda what: rows.where(F.col("what") == what)
    return {
        "definitions": of("definition").select(F.col("a").alias("qualified_name"), F.col("b").alias("name"), F.col("c").alias("kind"), "file", F.col("line").alias("start_line"), "end_line", F.coalesce("l2", "line").alias("name_line"), F.col("col").alias("name_col"), "ord"),
        "calls": of("call").select(F.col("a").alias("caller"), F.col("b").alias("callee_expr"), "line", F.col("c").alias("arg_text"), "file", F.coalesce("l2", "line").alias("callee_line"), F.col("col").alias("callee_col"), "ord"),
        "imports": of("import").select("file", F.col("a").alias("raw"), "line", "ord"),
        "assignments": of("assignment").select("file", F.col("a").alias("name"), "line", F.col("b").alias("value"), F.col("c").alias("host"), "ord"),
        "errors": of("error").select("file", F.col("a").alias("kind"), F.col("b").alias("detail"), "line"),
    }
