"""The cascade from a folder to a graph: each stage is a function of tables, in a fixed order."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.operators import configmatch, dataflow, extract, gaps, graph, infer, resolve, structure, symbols, trace
from graphlens.sources import configs, listing, repository, symbol_index


@dataclass
class Providers:
    """What comes from outside, each optional: index occurrences and infos, or the path of indexes in wire format (a file, a folder of *.scip); structural matches, or patterns to search for (structure.PATTERNS); data-flow results; a model for inference."""

    occurrences: DataFrame | None = None
    infos: DataFrame | None = None
    pattern_matches: DataFrame | None = None
    flow_results: DataFrame | None = None
    model: infer.Model | None = None
    index: str | None = None
    patterns: DataFrame | None = None


@dataclass
class Analysis:
    """All tables of a run."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None


def analyse(spark: SparkSession, root: str, out: str, providers: Providers | None = None, tail_names: bool = False) -> Analysis:
    """Read the repository below root and write every stage's table as Parquet below out, which all machines must reach; each stage reads what the one before wrote."""
    p, run = providers or Providers(), Analysis()

    def keep(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(os.path.join(out, name))
        run.tables[name] = spark.read.schema(df.schema).parquet(os.path.join(out, name))
        return run.tables[name]

    raw = keep("raw", listing.read_files(listing.list_folder(spark, root, os.path.join(out, "listing")), root))
    files, found = repository.discover(raw)
    files = keep("files", files)
    rows = keep("extracted", extract.extracted(files))
    t = extract.tables(rows)
    definitions, assignments, imports = (keep(n, t[n]) for n in ("definitions", "assignments", "imports"))
    errors = keep("errors", t["errors"])
    calls = keep("calls", resolve.with_call_id(t["calls"]))
    spans = covered = refs = None
    damaged = []
    if p.occurrences is None and p.index is not None:
        occurrences, infos, failed = symbol_index.tables(keep("index_documents", symbol_index.read_documents(spark, p.index)))
        p, damaged = replace(p, occurrences=occurrences, infos=infos), [failed]
    if p.pattern_matches is None and p.patterns is not None:
        p = replace(p, pattern_matches=keep("pattern_matches", structure.matches(files, p.patterns)))
    if p.occurrences is not None:
        refs, covered = symbols.references(p.occurrences), p.occurrences.select("file").distinct()
        if p.infos is not None:
            spans = symbols.spans_of(p.occurrences, p.infos)
    edges = resolve.flag_external(resolve.resolve(calls, definitions, refs, covered, tail_names), p.pattern_matches)
    edges = keep("edges_flagged", edges)
    edges = keep("edges_constants", trace.constants(trace.literals(edges), assignments))
    traced = p.flow_results if p.flow_results is not None else keep("flow_results", dataflow.results(files, edges, keep("flow_facts", dataflow.facts(files))))
    edges = keep("edges_flows", trace.flows(edges, traced))
    config = configs.config_index(keep("config_rows", configs.config_rows(files)))
    asked = keep("prompts", infer.prompts(edges, files, infer.candidate_pool(config["hosts"], config["services"], edges)))
    edges = keep("edges_inferred", infer.infer(edges, asked, p.model))
    matches = keep("matches", configmatch.match_config(edges, config))
    edges = keep("edges", configmatch.with_matches(edges, matches))
    nodes, links = graph.assemble(files, definitions, imports, edges, matches)
    keep("nodes", nodes)
    keep("graph_edges", links)
    syms = keep("symbols", symbols.symbol_map(definitions, spans))
    keep("coverage", symbols.file_coverage(files, syms, errors, covered))
    parse = gaps.gap(errors, "parse", "file", F.col("kind"), path=F.col("file"), detail=F.col("detail"), impact="the file has no definitions and calls")
    missing = [gaps.gap(spark.range(1), "providers", "repo", f"{n}_missing", impact="only Python is traced" if n == "flow_results" else "this tier adds nothing") for n in ("occurrences", "pattern_matches", "flow_results", "model") if getattr(p, n) is None]
    keep("gaps", gaps.merged(found, parse, resolve.unmapped_gaps(edges, files), symbols.conflict_gaps(syms), *damaged, *missing))
    return run


def meta(run: Analysis) -> dict:
    """The totals that go with a graph."""
    totals = resolve.resolution_totals(run.edges).first().asDict()
    more = run.edges.agg(F.count_if("needs_review").alias("needs_review"), F.count_if(F.col("host").isNotNull()).alias("with_host"), F.count_if(F.size("config_matches") > 0).alias("configured")).first().asDict()
    return totals | more | {"files": run.files.count(), "definitions": run.definitions.count(), "nodes": run.nodes.count(), "edges_in_graph": run.graph_edges.count()}
