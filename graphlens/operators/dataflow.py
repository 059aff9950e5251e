"""Where values come from, without an outside tool: facts of definitions and uses out of Python sources, linked over resolved calls, and followed back from each open call to its sources in rounds of joins."""

from __future__ import annotations

import ast
import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.schema import FLOW_RESULTS

#: fact: edge (node comes from other), literal and env (node comes from a source text), arg (node is an argument of the call at line, col), param (node is a
#: parameter of the function other), result (node comes from what the call at line, col returns). pos: a parameter's or argument's place or name.
FACTS = "fact string, file string, node string, other string, pos string, code string, line int, col int, conditions array<string>"
#: Calls whose arguments go into their result, and readers of the environment. Fixed values.
PASSES = frozenset("format join str urljoin bytes strip rstrip lstrip lower replace".split())
ENV_CALLS = ("os.getenv", "os.environ.get", "getenv", "environ.get")
#: Rows of a round that are broadcast at most; a round of more is merged with the edges.
FEW = 10_000


class _Facts(ast.NodeVisitor):
    """One walk over a file. A variable is a node of its function, or of the module where the function doesn't set it; self.x is a node of the class."""

    def __init__(self, file: str):
        self.file, self.rows, self.cls, self.owner = file, [], None, f"{file}::<module>"
        self.locals: list[tuple[str, set[str]]] = []  # functions around, with the names that each sets
        self.tests: list[str] = []
        self.modules: dict[str, str] = {}  # names that may be modules, and their dotted paths
        self.dotted = re.sub(r"(/__init__)?\.py$", "", file).replace("/", ".")

    def add(self, fact: str, node: str, other: str | None = None, pos: str | None = None, code: str | None = None, at: ast.AST | None = None, col: int | None = None, line: int | None = None) -> None:
        self.rows.append((fact, self.file, node, other, pos, code, line if line is not None else getattr(at, "lineno", None), col, list(self.tests)))

    def variable(self, name: str) -> str:
        return f"{next((f for f, names in reversed(self.locals) if name in names), f'{self.file}::<module>')}#{name}"

    def flow(self, node: str, e: ast.expr | None) -> None:
        """node gets its value from expression e."""
        if isinstance(e, ast.Constant):
            if isinstance(e.value, str) and e.value:
                self.add("literal", node, code=repr(e.value), at=e)
        elif isinstance(e, ast.Name):
            self.add("edge", node, self.variable(e.id), at=e)
        elif isinstance(e, ast.Subscript):
            if ast.unparse(e.value) in ("os.environ", "environ"):
                self.add("env", node, code=ast.unparse(e), at=e)
            else:
                self.flow(node, e.value)
        elif isinstance(e, ast.Attribute):
            if isinstance(e.value, ast.Name) and e.value.id in ("self", "cls") and self.cls:
                self.add("edge", node, f"{self.file}::{self.cls}.#{e.attr}", at=e)
            elif (name := ast.unparse(e.value)) in self.modules:
                self.add("edge", node, f"@{self.modules[name]}.{e.attr}", at=e)
                self.flow(node, e.value)
            else:
                self.flow(node, e.value)
        elif isinstance(e, ast.Call):
            name = ast.unparse(e.func)
            if name in ENV_CALLS:
                self.add("env", node, code=ast.unparse(e), at=e)
                for a in e.args[1:]:
                    self.flow(node, a)
                return
            line, col, tail = callee_place(e)
            self.add("result", node, at=e, line=line, col=col)
            if isinstance(e.func, ast.Attribute) and not (isinstance(e.func.value, ast.Name) and e.func.value.id in ("self", "cls", *self.modules)):
                self.flow(node, e.func.value)
            if tail in PASSES:
                for a in [*e.args, *(k.value for k in e.keywords)]:
                    self.flow(node, a)
        elif e is not None and not isinstance(e, (ast.Lambda, ast.Compare)):
            for x in ast.iter_child_nodes(e):
                if isinstance(x, ast.expr) and not (isinstance(e, ast.IfExp) and x is e.test):
                    self.flow(node, x)
                elif isinstance(x, ast.comprehension):
                    self.flow(node, x.iter)

    def visit_Call(self, e: ast.Call) -> None:
        line, col, _ = callee_place(e)
        for pos, a in [*((str(k), a) for k, a in enumerate(e.args)), *((k.arg, k.value) for k in e.keywords if k.arg)]:
            node = f"{self.file}@{line}:{col}/{pos}"
            self.add("arg", node, pos=pos, at=e, line=line, col=col)
            self.flow(node, a)
        self.generic_visit(e)

    def target(self, t: ast.expr, e: ast.expr | None) -> None:
        if isinstance(t, ast.Name):
            self.flow(self.variable(t.id) if self.locals or not self.cls else f"{self.file}::{self.cls}.#{t.id}", e)
        elif isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id in ("self", "cls") and self.cls:
            self.flow(f"{self.file}::{self.cls}.#{t.attr}", e)
        elif isinstance(t, (ast.Tuple, ast.List)):
            parts = e.elts if isinstance(e, (ast.Tuple, ast.List)) and len(e.elts) == len(t.elts) else [e] * len(t.elts)
            for x, y in zip(t.elts, parts, strict=True):
                self.target(x, y)
        elif isinstance(t, (ast.Subscript, ast.Starred)):
            self.target(t.value, e)

    def visit_Assign(self, s: ast.Assign) -> None:
        for t in s.targets:
            self.target(t, s.value)
        self.generic_visit(s)

    def visit_AnnAssign(self, s: ast.AnnAssign) -> None:
        self.target(s.target, s.value)
        self.generic_visit(s)

    visit_AugAssign = visit_AnnAssign
    visit_NamedExpr = visit_AnnAssign

    def visit_For(self, s: ast.For) -> None:
        self.target(s.target, s.iter)
        self.generic_visit(s)

    def visit_With(self, s: ast.With) -> None:
        for x in s.items:
            if x.optional_vars is not None:
                self.target(x.optional_vars, x.context_expr)
        self.generic_visit(s)

    def visit_Return(self, s: ast.Return) -> None:
        self.flow(f"{self.owner}#return", s.value)
        self.generic_visit(s)

    def visit_If(self, s: ast.If) -> None:
        self.visit(s.test)
        for test, body in ((ast.unparse(s.test), s.body), (f"not ({ast.unparse(s.test)})", s.orelse)):
            self.tests.append(test)
            for x in body:
                self.visit(x)
            self.tests.pop()

    def visit_Import(self, s: ast.Import) -> None:
        for x in s.names:
            self.modules[x.asname or x.name] = x.name
            if x.asname:
                self.add("edge", self.variable(x.asname), f"@{x.name}", at=s)

    def visit_ImportFrom(self, s: ast.ImportFrom) -> None:
        up = self.dotted.split(".")
        up = up[: len(up) - s.level + self.file.endswith("/__init__.py")] if s.level else []
        for x in s.names:
            path = ".".join([*up, *filter(None, [s.module]), x.name])
            self.modules[x.asname or x.name] = path
            self.add("edge", self.variable(x.asname or x.name), f"@{path}", at=s)

    def visit_ClassDef(self, s: ast.ClassDef) -> None:
        before, self.cls = (self.cls, self.locals), s.name
        self.locals = []
        for x in s.body:
            self.visit(x)
        self.cls, self.locals = before

    def visit_FunctionDef(self, s) -> None:
        name = f"{self.file}::{self.cls}.{s.name}" if self.cls else f"{self.file}::{s.name}"
        args = [*s.args.posonlyargs, *s.args.args]
        bound = bool(self.cls and args and args[0].arg in ("self", "cls"))
        for d, a in [*zip(reversed(s.args.defaults), reversed(args), strict=False), *zip(s.args.kw_defaults, s.args.kwonlyargs, strict=True)]:
            self.flow(f"{name}#{a.arg}", d)
        for owner in [name, *([f"{self.file}::{self.cls}"] if s.name == "__init__" and self.cls else [])]:
            for k, a in enumerate(args[bound:]):
                for pos in (str(k), a.arg):
                    self.add("param", f"{name}#{a.arg}", owner, pos, a.arg, s)
            for a in s.args.kwonlyargs:
                self.add("param", f"{name}#{a.arg}", owner, a.arg, a.arg, s)
        sets, shared = {a.arg for a in [*args, *s.args.kwonlyargs, s.args.vararg, s.args.kwarg] if a}, set()
        todo = list(s.body)
        while todo:
            x = todo.pop()
            if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store):
                sets.add(x.id)
            elif isinstance(x, (ast.Global, ast.Nonlocal)):
                shared.update(x.names)
            if not isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
                todo += ast.iter_child_nodes(x)
        before = self.owner, self.tests
        self.owner, self.tests = name, []
        self.locals.append((name, sets - shared))
        for x in s.body:
            self.visit(x)
        self.locals.pop()
        self.owner, self.tests = before

    visit_AsyncFunctionDef = visit_FunctionDef

    def exported(self, tree: ast.Module) -> None:
        """What other modules call this one's variables: by every tail of its dotted path."""
        names = {x.id for s in tree.body for x in ast.walk(s) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store)}
        names |= {a.asname or a.name for s in tree.body if isinstance(s, ast.ImportFrom) for a in s.names}
        parts = self.dotted.split(".")
        for k in range(len(parts)):
            for name in sorted(names):
                self.add("edge", f"@{'.'.join(parts[k:])}.{name}", f"{self.file}::<module>#{name}")


def callee_place(e: ast.Call) -> tuple[int, int, str]:
    """(line, column, name) of a call's last name, as the extractor has them; column -1 where there is none."""
    f = e.func.value if isinstance(e.func, ast.Await) else e.func
    if not isinstance(f, (ast.Name, ast.Attribute)):
        return f.end_lineno, -1, ""
    tail = f.id if isinstance(f, ast.Name) else f.attr
    return f.end_lineno, max(0, f.end_col_offset - len(tail.encode())), tail


def python_facts(file: str, text: str) -> list[tuple]:
    """FACTS of a Python file; none if it is no Python."""
    try:
        tree = ast.parse(text)
        walk = _Facts(file)
        walk.exported(tree)
        walk.visit(tree)
        return walk.rows
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return []


def facts(files: DataFrame) -> DataFrame:
    """FACTS of every Python file that isn't skipped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FACTS.split(", ")]
        for pdf in batches:
            out = pd.DataFrame([r for path, text in zip(pdf["path"], pdf["text"], strict=True) for r in python_facts(path, text or "")], columns=names)
            yield out.astype({"line": "Int32", "col": "Int32"})

    return files.where("not skipped and language = 'python'").select("path", "text").mapInPandas(run, FACTS)


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir for tables on the way; where that is unset and Spark runs in this process alone, one of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="graphlens-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        root = f"file://{root}"
    return f"{root.rstrip('/')}/graphlens/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to a new folder and read from there: made once, however many steps read it."""
    path = _folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reached(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, node) for each node that a start reaches over edges(node, other), itself included.

    Semi-naive rounds: only pairs that are new go on, so a cycle ends and no path is walked twice; each round is one join and one anti-join, and
    is written, so that no plan grows and a lost executor costs one round. As many rounds as the longest shortest path has edges. Null ends lead
    nowhere. Only rounds of at most FEW pairs are broadcast: a written table's size says little of its rows' in memory.
    """
    spark, folder = starts.sparkSession, _folder(starts.sparkSession, "reached")

    def written(df: DataFrame, name: str) -> str:
        df.write.parquet(f"{folder}/{name}")
        return f"{folder}/{name}"

    first = starts.where("start is not null and node is not null").select("start", "node").distinct()
    # A written table loses nothing of a schema but what may not be null.
    steps = edges.where("node is not null and other is not null and node <> other").select(F.col("node").alias("_from"), F.col("other").alias("_to")).distinct()
    steps = spark.read.schema(steps.schema).parquet(written(steps, "steps"))
    read = lambda *paths: spark.read.schema(first.schema).parquet(*paths)
    rounds = [written(first, "round-0")]
    while n := (new := read(rounds[-1])).count():
        asked = F.broadcast(new) if n <= FEW else new.hint("merge")
        found = asked.join(steps, F.col("node") == F.col("_from")).select("start", F.col("_to").alias("node")).distinct()
        rounds.append(written(found.join(read(*rounds).hint("merge"), ["start", "node"], "left_anti"), f"round-{len(rounds)}"))
    return read(*rounds)


def linked(known: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, other): the edges of facts, and over resolved calls those from parameters to arguments and from results to returned values. edges: calls with callee_line, callee_col and resolved_targets.

    All its tables grow with the sources and are merged: facts come from Python, so Spark takes them for as small as the list of files.
    """
    calls = edges.where("size(resolved_targets) > 0 and callee_col >= 0").select("file", F.col("callee_line").alias("line"), F.col("callee_col").alias("col"), F.explode("resolved_targets").alias("target")).distinct().hint("merge")
    args = known.where("fact = 'arg'").select("file", "line", "col", "pos", F.col("node").alias("other"))
    params = known.where("fact = 'param'").select(F.col("other").alias("target"), "pos", "node")
    results = known.where("fact = 'result'").select("file", "line", "col", "node")
    given = args.join(calls, ["file", "line", "col"]).join(params.hint("merge"), ["target", "pos"]).select("node", "other")
    returned = results.join(calls, ["file", "line", "col"]).select("node", F.concat("target", F.lit("#return")).alias("other"))
    return known.where("fact = 'edge'").select("node", "other").unionByName(given).unionByName(returned)


def results(files: DataFrame, edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """FLOW_RESULTS for each external candidate without a host: the literals, environment reads and uncalled parameters that its first argument (or the one named url) may come from.

    The same table that an outside tool would give. A flow's conditions are the tests around its source. Calls in files that are no Python have
    no row, as with a tool that doesn't know them. Facts that aren't given are written first; give edges that are written, as they are read three times.
    """
    known = kept(facts(files), "facts") if known is None else known
    open_ = edges.where("status = 'external_candidate' and host is null").select("call_id", "file", "line", F.col("callee_line").alias("_line"), F.col("callee_col").alias("_col"))
    args = known.where("fact = 'arg' and pos in ('0', 'url')").select("file", F.col("line").alias("_line"), F.col("col").alias("_col"), "node").distinct()
    starts = kept(open_.join(args.hint("merge"), ["file", "_line", "_col"]), "starts")
    links = kept(linked(known, edges), "links")
    pairs = reached(starts.select(F.col("call_id").alias("start"), "node"), links)
    sources = known.where("fact in ('literal', 'env')").select("node", F.col("fact").alias("kind"), "code", F.col("file").alias("of"), F.col("line").alias("at"), "conditions")
    free = known.where("fact = 'param'").select("node", "code", F.col("file").alias("of"), F.col("line").alias("at")).dropDuplicates(["node"]).join(links.select("node").hint("merge"), "node", "left_anti").join(known.where("fact in ('literal', 'env')").select("node").hint("merge"), "node", "left_anti")
    sources = sources.unionByName(free.select("node", F.lit("parameter").alias("kind"), "code", "of", "at", F.array().cast("array<string>").alias("conditions")))
    place = lambda code, of, at: F.struct(code.alias("code"), of.alias("file"), at.alias("line"), F.lit(None).cast("string").alias("method"))
    flow = F.struct("kind", place(F.col("code"), F.col("of"), F.col("at")).alias("source"), F.array().cast("array<struct<code:string,file:string,line:int,method:string>>").alias("steps"), F.transform("conditions", lambda c: place(c, F.col("of"), F.col("at"))).alias("conditions"))
    by_call = pairs.join(sources.hint("merge"), "node").select(F.col("start").alias("call_id"), flow.alias("flow")).distinct().groupBy("call_id").agg(F.array_sort(F.collect_list("flow")).alias("flows"))
    python = files.where("not skipped and language = 'python'").select(F.col("path").alias("file"))
    made = open_.join(python.hint("merge"), "file", "left_semi").join(starts.select("call_id").distinct().withColumn("found_argument", F.lit(True)).hint("merge"), "call_id", "left").join(by_call.hint("merge"), "call_id", "left")
    one = made.groupBy("file", "line").agg(F.lit(True).alias("found_call"), F.coalesce(F.max("found_argument"), F.lit(False)).alias("found_argument"), F.flatten(F.collect_list("flows")).alias("flows"))
    return one.select(*[x.split()[0] for x in re.sub(r"<.*>", "", FLOW_RESULTS).split(", ")])
