"""Joins with a preference: same-file matches, first patterns, last assignments, smallest containers, strongest tiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def preferred_targets(calls: DataFrame, defs: DataFrame, call_id: str, target: str, order: str) -> DataFrame:
    """calls(call_id, file, name), defs(file, name, target, order) -> (call_id, targets): the distinct targets of the call's name, those of its own file if there are any, else all; by file and order.

    Targets are gathered by name and by file before the join, so a common name joins one row to each call, never each of its definitions.
    """
    one = defs.groupBy("name", "file", target).agg(F.min(order).alias("_o"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["_t"])
    by_file = one.groupBy("name", "file").agg(ordered(F.struct("_o", F.col(target).alias("_t"))).alias("_own"))
    first = one.groupBy("name", target).agg(F.min(F.struct("file", "_o")).alias("_at"))
    by_name = first.groupBy("name").agg(ordered(F.struct("_at", F.col(target).alias("_t"))).alias("_all"))
    both = calls.join(by_name, "name").join(by_file, ["name", "file"], "left")
    return both.select(call_id, F.coalesce("_own", "_all").alias("targets"))


def preferred_matches_summary(calls: DataFrame, defs: DataFrame, call_id: str, def_id: str) -> DataFrame:
    """Of preferred_targets: (call_id, n_targets, first_target, preferred: of its own file), from counts per name and file alone."""
    by_file = defs.groupBy("name", "file").agg(F.count("*").alias("own_n"), F.min(def_id).alias("own_first"))
    by_name = by_file.groupBy("name").agg(F.sum("own_n").alias("all_n"), F.min("own_first").alias("all_first"))
    both = calls.join(by_name, "name").join(by_file, ["name", "file"], "left")
    own = F.col("own_n").isNotNull()
    return both.select(call_id, F.when(own, F.col("own_n")).otherwise(F.col("all_n")).alias("n_targets"), F.when(own, F.col("own_first")).otherwise(F.col("all_first")).alias("first_target"), own.alias("preferred"))


def first_pattern(c: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    """The label of the first pattern that matches, null if none does; an ordered catalogue as one expression, so no join."""
    return reduce(lambda out, p: out.when(c.rlike(p[0]), p[1]), patterns, F.when(F.lit(False), ""))


def asof_before(uses: DataFrame, sets: DataFrame, keys: list[str], at: str, value: str, use_id: str) -> DataFrame:
    """Each use with the value that was last set strictly before it, null if none was; of values set at the same time the greatest.

    Both sides go through one sort by key and time and a running last value: no pair of a use and a set is ever made, so a key with very many of
    either costs a sort, which spills.
    """
    u = uses.select(*keys, F.col(at).alias("at"), use_id, F.lit(0).alias("side"), F.lit(None).cast(sets.schema[value].dataType).alias("value"), F.lit(False).alias("set"))
    s = sets.select(*keys, F.col(at).alias("at"), F.lit(None).cast(uses.schema[use_id].dataType).alias(use_id), F.lit(1).alias("side"), F.col(value).alias("value"), F.lit(True).alias("set"))
    # At one time uses come first, so they see only what was set before; of sets the greatest comes last.
    w = Window.partitionBy(*keys).orderBy("at", "side", F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("set"), F.struct("value")), ignorenulls=True).over(w)
    return u.unionByName(s).withColumn("found", last).where(~F.col("set")).select(use_id, *keys, F.col("at").alias(at), F.col("found.value").alias(value))


def contained_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(item_id, doc_id): passages that a text contains. A text that does has each inner word of the passage as a word; candidates share the longest of them, then the text is looked at. Passages without an inner word are compared with every text, so they are to be few."""
    words = F.split("text", " ", -1)
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    own = passages.select("item_id", F.col("text").alias("passage"), F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))).alias("best"))
    keyed = own.select("item_id", "passage", F.nullif(F.col("best.w"), F.lit("")).alias("word"))
    there = docs.select("doc_id", F.explode(F.array_distinct(words)).alias("word"))
    found = keyed.join(there, "word").select("item_id", "passage", "doc_id").join(docs.select("doc_id", "text"), "doc_id").where(F.col("text").contains(F.col("passage")))
    short = keyed.where("word is null").join(docs.select("doc_id", "text"), F.col("text").contains(F.col("passage")))
    return found.select("item_id", "doc_id").unionByName(short.select("item_id", "doc_id")).distinct()


#: Labels of a dotted name at most; a fixed value of the domain name system.
MOST_LABELS = 127


def token_hits(names: DataFrame, name: str, texts: DataFrame, text: str, pattern: Column) -> DataFrame:
    """names joined with the rows of texts whose text has the name (in lower case) as a token: pattern, over the name's column, decides.

    An equi-join: a name's first run of letters, digits, underscores, dots and hyphens begins where one of the text does, and ends where it does or
    before one of its dots. So a text's keys are its distinct runs and their beginnings before dots, and only rows of equal keys meet. Names without such a run are no tokens; null texts have none.
    """
    keyed = names.withColumn("_key", F.regexp_extract(name, r"[\w.\-]+", 0)).where("_key <> ''").withColumn("_pattern", pattern)
    labels = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\w.\-]+"), F.lit(0))), lambda run: F.split(F.lower(run), r"\.", -1))
    begins = lambda run: F.transform(F.sequence(F.lit(1), F.least(F.size(run), F.lit(MOST_LABELS))), lambda k: F.array_join(F.slice(run, 1, k), "."))
    there = texts.withColumn("_key", F.explode(F.array_distinct(F.flatten(F.transform(labels, begins)))))
    return keyed.join(there, "_key").where(F.lower(text).contains(F.col(name))).where(F.rlike(F.col(text), F.col("_pattern"))).drop("_key", "_pattern")


def strongest_tier(tiers: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Rows of all tiers, for each key those of the first tier that has any, one row by order; tier counts from 1."""
    rows = reduce(DataFrame.unionByName, (df.withColumn("tier", F.lit(k)) for k, df in enumerate(tiers, 1)))
    w = Window.partitionBy(*keys).orderBy("tier", *order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
