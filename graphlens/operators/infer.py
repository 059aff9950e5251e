"""Inference for what is left: prompts with evidence, an injected model, and answers that count only if they are grounded."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlens.functions.text import append_note, context_window, json_object

#: Calls of a run that are asked, names offered with each, calls in a batch. Fixed values.
MAX_CALLS, MAX_CANDIDATES, BATCH = 25, 40, 4
#: Answers that say nothing. Fixed values.
NON_ANSWERS = frozenset(("unknown", "none", "null", "n/a", "na", "undefined", "unclear", "host", "hostname", "service", "example.com", "localhost"))

Model = Callable[[list[str]], list[str]]


def candidate_pool(config_hosts: DataFrame, services: DataFrame, edges: DataFrame, most: int = MAX_CANDIDATES) -> DataFrame:
    """(name, reason, rank): hosts of configuration, declared services, hosts of other calls; the first reason of a name wins, `most` names at most by rank."""
    parts = [config_hosts.select(F.col("host").alias("name"), F.lit("configured host").alias("reason"), F.lit(0).alias("p")), services.select("name", F.lit("declared service").alias("reason"), F.lit(1).alias("p")), edges.where("host is not null").select(F.col("host").alias("name"), F.lit("host of another call").alias("reason"), F.lit(2).alias("p"))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("name").agg(F.min_by("reason", "p").alias("reason"), F.min("p").alias("p"))
    return rows.orderBy("p", "name").limit(most).withColumn("rank", F.row_number().over(Window.partitionBy().orderBy("p", "name"))).drop("p")


def prompts(edges: DataFrame, files: DataFrame, candidates: DataFrame, most: int = MAX_CALLS) -> DataFrame:
    """(call_id, asked, prompt, names, prompt_sha) for external candidates without a host; asked is true for the first `most` by place, so no call vanishes. Prompts are built, and texts joined, for those alone."""
    todo = edges.where("status = 'external_candidate' and host is null")
    first = todo.orderBy("file", "line", "ord").limit(most)
    lines = files.select(F.col("path").alias("file"), F.split("text", "\n").alias("lines"))
    names = candidates.agg(F.array_sort(F.collect_list(F.struct("rank", "name", "reason"))).alias("c"))
    made = first.withColumn("asked", F.lit(True)).join(lines, "file", "left").join(names, F.lit(True), "left")
    rest = todo.join(first.select("call_id"), "call_id", "left_anti").select("call_id", F.lit(False).alias("asked"), F.lit(None).cast("string").alias("prompt"), F.lit(None).cast("array<string>").alias("names"))
    window = context_window(F.col("lines"), F.col("line"))
    evidence = F.array_compact(F.array(F.concat(F.lit("callee: "), "callee_expr"), F.when(F.coalesce("argument", F.lit("")) != "", F.concat(F.lit("argument: "), "argument")), F.when(F.col("flow_source").isNotNull(), F.concat(F.lit("source: "), "flow_source")), F.when(F.col("literal_reason").isNotNull(), F.concat(F.lit("note: "), "literal_reason"))))
    offered = F.array_join(F.transform(F.col("c"), lambda x: F.concat(F.lit("- "), x["name"], F.lit(" ("), x["reason"], F.lit(")"))), "\n")
    prompt = F.concat_ws("\n\n", F.lit("Which host does this call reach? Answer with a JSON object: service, confidence, evidence."), F.array_join(evidence, "\n"), F.coalesce(window, F.lit("")), F.concat(F.lit("Known names:\n"), F.coalesce(offered, F.lit(""))))
    asked = made.select("call_id", "asked", prompt.alias("prompt"), F.transform("c", lambda x: x["name"]).alias("names"))
    return asked.unionByName(rest).withColumn("prompt_sha", F.sha1("prompt"))


def parse_answer(text: str | None) -> dict:
    """service, confidence (low if it isn't high, medium or low) and evidence (300 characters) of an answer's JSON object; {} without one."""
    found = json_object(text) or (json_object("{" + text) if text else None)
    if not found:
        return {}
    value = json.loads(found)
    sure = str(value.get("confidence", "low")).lower()
    return {"service": str(value.get("service") or "").strip(), "confidence": sure if sure in ("high", "medium", "low") else "low", "evidence": str(value.get("evidence") or "")[:300]}


def is_name(text: str) -> bool:
    """A host or service name that says something."""
    return bool(re.fullmatch(r"[A-Za-z0-9](?:[A-Za-z0-9._:-]{1,251}[A-Za-z0-9])?", text)) and text.lower() not in NON_ANSWERS


def grounding(answer: str, names: list[str], prompt: str) -> str | None:
    """candidate: one of the names offered; quoted_from_context: a token of the prompt; partial_context_match: its first label is; else None."""
    low = answer.lower()
    if low in (n.lower() for n in names):
        return "candidate"
    token = lambda x: re.search(rf"(?<![\w.-]){re.escape(x)}(?![\w-])", prompt, re.IGNORECASE)
    if token(answer):
        return "quoted_from_context"
    label = low.split(".")[0]
    return "partial_context_match" if len(label) > 3 and token(label) else None


_ANSWER = T.StructType([T.StructField(n, T.StringType()) for n in ("call_id", "inferred_host", "inference_grounding", "inference_confidence", "note")])


def infer(edges: DataFrame, asked: DataFrame, model: Model | None = None) -> DataFrame:
    """edges plus inferred_host, inference_grounding, inference_confidence; grounded answers set host and literal_method and always need review. Equal prompts are asked once. Without a model nothing is inferred and the calls need review."""
    if model is None:
        none = F.lit(None).cast("string")
        answers = asked.select("call_id", none.alias("inferred_host"), none.alias("inference_grounding"), none.alias("inference_confidence"), F.lit("inference is not available").alias("note"))
    else:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for i in range(0, len(pdf), BATCH):
                    part = pdf.iloc[i : i + BATCH]
                    for (_, r), text in zip(part.iterrows(), model(list(part["prompt"])), strict=True):
                        got = parse_answer(text)
                        name = got.get("service", "")
                        kind = grounding(name, list(r["names"] if r["names"] is not None else []), r["prompt"]) if is_name(name) else None
                        note = f"inferred ({kind})" if kind else "the answer names no host" if not is_name(name) else "the answer is not grounded"
                        rows += [(c, name if kind else None, kind, got.get("confidence") if kind else None, note) for c in r["calls"]]
                yield pd.DataFrame(rows, columns=_ANSWER.names, dtype=object)

        once = asked.where("asked").groupBy("prompt_sha").agg(F.first("prompt").alias("prompt"), F.first("names").alias("names"), F.array_sort(F.collect_list("call_id")).alias("calls"))
        answers = once.select("prompt", "names", "calls").mapInPandas(run, _ANSWER)
        answers = answers.unionByName(asked.where("not asked").select("call_id", *(F.lit(None).cast("string").alias(n) for n in _ANSWER.names[1:4]), F.lit("beyond the limit of inferred calls").alias("note")))
    made = edges.join(answers, "call_id", "left")
    hit = F.col("inferred_host").isNotNull()
    made = made.withColumn("host", F.coalesce("host", "inferred_host")).withColumn("literal_method", F.when(hit, "llm_inferred").otherwise(F.col("literal_method")))
    return made.withColumn("needs_review", F.col("needs_review") | F.col("note").isNotNull()).withColumn("review_reason", append_note(F.col("review_reason"), F.col("note"))).drop("note")
