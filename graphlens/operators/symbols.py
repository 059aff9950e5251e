"""The symbol map: parser definitions joined with an index's spans, nested, named once, per file."""

from __future__ import annotations

import json
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions.text import PARSED, line_count
from graphlens.operators.gaps import gap, write_atomic
from graphlens.operators.spans import Sweep

#: Kinds of symbols by an index's names and numbers; fixed values of the index format, others count as 'other'.
KINDS = {"function": "function", "method": "method", "class": "class", "interface": "class", "struct": "class", "constructor": "method", "variable": "variable", "parameter": "parameter", "17": "function", "26": "method", "7": "class", "21": "class", "49": "class", "9": "method", "61": "variable", "37": "parameter"}
SYMBOLS = "path string, id string, name string, qualified_name string, kind string, start_line int, end_line int, parent_id string, source string, scip_symbol string, conflict boolean"


def normalise_kind(c: Column) -> Column:
    low = F.lower(c.cast("string"))
    out = F.lit("other")
    for k, v in KINDS.items():
        out = F.when(low == k, v).otherwise(out)
    return out


def parse_range(c: Column) -> Column:
    """[line, column, ...] counted from 0 -> struct(line from 1, col)."""
    return F.struct((F.get(c, F.lit(0)) + 1).alias("line"), F.get(c, F.lit(1)).alias("col"))


def parse_span(c: Column) -> Column:
    """[line, column, (end line,) end column] from 0 -> struct(start, end) from 1, inclusive; an end at column 0 is the line before; null for a span of no width."""
    end = F.when(F.size(c) == 3, F.get(c, F.lit(0))).otherwise(F.get(c, F.lit(2)))
    end_col = F.element_at(c, -1)
    start, start_col = F.get(c, F.lit(0)), F.get(c, F.lit(1))
    last = F.when((end_col == 0) & (end > start), end - 1).otherwise(end)
    return F.when(F.size(c).isin(3, 4) & ~((end == start) & (end_col == start_col)), F.struct((start + 1).alias("start"), (last + 1).alias("end")))


def spans_of(occurrences: DataFrame, infos: DataFrame) -> DataFrame:
    """graphlens.schema.SPANS from an index: occurrences(file, symbol, roles, range, enclosing_range) that define something, with kind and name of the same document's infos(file, symbol, kind, display_name)."""
    d = occurrences.where(F.coalesce("roles", F.lit(0)).bitwiseAND(1) == 1)
    one = infos.groupBy("file", "symbol").agg(F.first("kind").alias("kind"), F.first("display_name").alias("display_name"))
    made = d.join(one, ["file", "symbol"], "left").withColumn("at", parse_range(F.col("range"))).withColumn("span", parse_span(F.coalesce("enclosing_range", "range")))
    return made.where("span is not null").select("symbol", F.coalesce("display_name", F.lit("")).alias("display_name"), normalise_kind(F.coalesce("kind", F.lit("other"))).alias("kind"), "file", F.col("at.line").alias("name_line"), F.col("at.col").alias("name_col"), F.col("span.start").alias("start_line"), F.col("span.end").alias("end_line"), F.col("enclosing_range").isNotNull().alias("has_enclosing_range"), F.col("symbol").startswith("local ").alias("is_local"))


def references(occurrences: DataFrame) -> DataFrame:
    """(file, line, col, def_file, def_line, def_col) of every reference whose symbol is defined; local symbols within their file. All definitions of a symbol count."""
    scope = F.when(F.col("symbol").startswith("local "), F.col("file")).otherwise(F.lit(""))
    rows = occurrences.withColumn("scope", scope).withColumn("at", parse_range(F.col("range")))
    is_def = F.coalesce("roles", F.lit(0)).bitwiseAND(1) == 1
    defs = rows.where(is_def).select("scope", "symbol", F.col("file").alias("def_file"), F.col("at.line").alias("def_line"), F.col("at.col").alias("def_col"))
    return rows.where(~is_def).join(defs, ["scope", "symbol"]).select("file", F.col("at.line").alias("line"), F.col("at.col").alias("col"), "def_file", "def_line", "def_col").distinct()


def joined_symbols(definitions: DataFrame, spans: DataFrame | None) -> DataFrame:
    """Definitions with the index's best span at the same name, and the index's own functions, methods and classes: one row a symbol, both extents. An index's extent counts if it is enclosing."""
    d = definitions.select(F.col("file").alias("path"), "name", "qualified_name", "kind", "name_line", "name_col", F.col("start_line").alias("ts_start"), F.coalesce("end_line", "start_line").alias("ts_end"), "ord")
    if spans is None:
        none = F.lit(None)
        return d.withColumn("scip_symbol", none.cast("string")).withColumn("scip_start", none.cast("int")).withColumn("scip_end", none.cast("int")).withColumn("source", F.lit("treesitter"))
    order = [F.desc("has_enclosing_range"), F.when(F.col("kind").isin("function", "method", "class"), 0).otherwise(1), "is_local", "symbol"]
    best = spans.withColumn("_n", F.row_number().over(Window.partitionBy("file", "name_line", "name_col").orderBy(*order))).where("_n = 1")
    s = best.select(F.col("file").alias("path"), "name_line", "name_col", F.col("symbol").alias("scip_symbol"), F.when(F.col("has_enclosing_range"), F.col("start_line")).alias("scip_start"), F.when(F.col("has_enclosing_range"), F.col("end_line")).alias("scip_end"))
    both = d.join(s, ["path", "name_line", "name_col"], "left").withColumn("source", F.when(F.col("scip_symbol").isNotNull(), "both").otherwise("treesitter"))
    only = best.where("not is_local and has_enclosing_range and display_name <> '' and kind in ('function', 'method', 'class')").withColumnRenamed("file", "path").join(d.select("path", "name_line", "name_col"), ["path", "name_line", "name_col"], "left_anti")
    only = only.select("path", F.col("display_name").alias("name"), F.concat("path", F.lit("::"), "display_name").alias("qualified_name"), "kind", "name_line", "name_col", F.col("start_line").alias("ts_start"), F.col("end_line").alias("ts_end"), F.lit(1 << 30).alias("ord"), F.col("symbol").alias("scip_symbol"), F.col("start_line").alias("scip_start"), F.col("end_line").alias("scip_end"), F.lit("scip").alias("source"))
    return both.unionByName(only.select(*both.columns))


def nest(rows: list[dict]) -> list[dict]:
    """Symbols of one file in order of extent, each with its smallest container. A symbol that begins inside another and ends behind it takes the parser's extent if it has the index's; what still overlaps is marked.

    One sweep: where a symbol gives way, it is put at its new place and the sweep goes back to there, or goes on where it was.
    """
    key = lambda r: (r["start"], -r["end"], r["name_line"] or 0, r["name_col"] or 0, r["scip_symbol"] or "", r["qualified_name"])
    for r in rows:
        r["use"] = r["scip_start"] is not None
        r["start"], r["end"] = (r["scip_start"], r["scip_end"]) if r["use"] else (r["ts_start"], max(r["ts_end"], r["ts_start"]))
    rows.sort(key=key)
    keys, sweep = [key(r) for r in rows], Sweep(logged=True)
    while sweep.n < len(rows):
        i = sweep.n
        r = rows[i]
        best = sweep.container(r["end"])
        r["parent"], r["conflict"] = rows[best[1]] if best else None, sweep.overlaps(r["start"], r["end"])
        if r["conflict"] and r["use"] and r["source"] == "both":
            del rows[i], keys[i]
            r["use"], r["start"], r["end"] = False, r["ts_start"], max(r["ts_end"], r["ts_start"])
            to = bisect_right(keys, key(r))
            rows.insert(to, r)
            keys.insert(to, key(r))
            while sweep.n > to:
                sweep.back()
        else:
            sweep.step(r["start"], r["end"])
    taken = {r["qualified_name"] for r in rows}
    seen: set[str] = set()
    for r in rows:
        id_, n = r["qualified_name"], 1
        while id_ in seen or n > 1 and id_ in taken:
            n += 1
            id_ = f"{r['qualified_name']}~{n}"
        seen.add(id_)
        r["id"] = id_
    return rows


def symbol_map(definitions: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """SYMBOLS of all files. One file is one group, bounded by the limits of discovery: overlaps are settled one after the other."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [{k: (None if pd.isna(v) else int(v) if k.endswith(("start", "end", "line", "col", "ord")) else v) for k, v in r.items()} for r in pdf.sort_values("ord").to_dict("records")]
        out = [(r["path"], r["id"], r["name"], r["qualified_name"], r["kind"], r["start"], r["end"], r["parent"]["id"] if r["parent"] else None, r["source"], r["scip_symbol"], r["conflict"]) for r in nest(rows)]
        return pd.DataFrame(out, columns=[x.split()[0] for x in SYMBOLS.split(", ")])

    return joined_symbols(definitions, spans).groupBy("path").applyInPandas(run, SYMBOLS)


def file_coverage(files: DataFrame, symbols: DataFrame, errors: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """(path, language, coverage, skip_reason, line_count, file_sha, n_symbols) of every file."""
    n = symbols.groupBy("path").agg(F.count("*").alias("n_symbols"))
    bad = errors.groupBy(F.col("file").alias("path")).agg(F.lit(True).alias("bad"))
    made = files.join(n, "path", "left").join(bad, "path", "left")
    made = made.join(covered.select(F.col("file").alias("path")).distinct().withColumn("covered", F.lit(True)), "path", "left") if covered is not None else made.withColumn("covered", F.lit(None).cast("boolean"))
    parsed = F.col("language").isin(*PARSED)
    coverage = F.when(F.col("skipped"), "skipped").when(F.col("bad"), "unparsed").when(F.col("covered"), "scip").when(parsed, "treesitter_only").when(~F.col("is_config") & (F.col("language") != "other"), "fallback_lines").otherwise("unparsed")
    text = F.coalesce("text", F.lit(""))
    return made.select("path", "language", coverage.alias("coverage"), "skip_reason", line_count(text).alias("line_count"), F.sha2(text, 256).alias("file_sha"), F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"))


def conflict_gaps(symbols: DataFrame) -> DataFrame:
    return gap(symbols.where("conflict").groupBy("path").agg(F.count("*").alias("n")), "symbols", "file", "span_conflict", path=F.col("path"), impact="these symbols' parents are uncertain", count=F.col("n"))


def write_symbol_map(coverage: DataFrame, symbols: DataFrame, path: str) -> None:
    """symbol_map.json, the same bytes for the same input. It is one document by definition, so it is made on the driver, file by file; at scale write the two tables instead."""
    files = {r.path: {k: r[k] for k in ("language", "coverage", "skip_reason", "line_count", "file_sha")} | {"symbols": []} for r in coverage.toLocalIterator()}
    for r in symbols.orderBy("path", "start_line", F.desc("end_line"), "id").toLocalIterator():
        files[r.path]["symbols"].append({k: r[k] for k in ("id", "name", "qualified_name", "kind", "start_line", "end_line", "parent_id", "source", "scip_symbol", "conflict")})
    write_atomic(path, json.dumps({"schema_version": 1, "files": files}, indent=2, sort_keys=True) + "\n")


def read_symbol_map(path: str) -> dict:
    """A symbol map with its parts checked; anything else is an error."""
    with open(path, encoding="utf-8") as f:
        value = json.load(f)
    if not isinstance(value, dict) or value.get("schema_version") != 1 or not isinstance(value.get("files"), dict):
        raise ValueError("not a symbol map of version 1")
    for name, x in value["files"].items():
        if not isinstance(x, dict) or not isinstance(x.get("symbols"), list) or any(not isinstance(s, dict) or "id" not in s for s in x["symbols"]):
            raise ValueError(f"the symbols of {name} are damaged")
    return value
