"""A corpus pipeline: quality filter, near-duplicate removal, removal of long repeats, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of docs. What a
stage returns is written as Parquet and read again as the next one's docs, so each works on all that its predecessor kept and a lost executor
costs one stage at most.

Edge rows: null texts count as empty and stay as they are; repeated rows are near-duplicates of each other, so one stays, while rows
of one doc_id with other texts are documents of their own; a row without doc_id has
no label, takes no part in the search for copies or repeats and is kept; an empty table passes through every stage. Extra columns are carried
along under their own names: every stage reads doc_id and text alone and joins its decision by internal names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.llm import common, packing, quality, repeats, similar
from graphlens.llm.catalog import tokenizer_file

#: Names for what a stage adds to rows on the way; extra columns of a table aren't called so.
_ID, _DIGEST, _TEXT, _NTH = "__doc_id", "__digest", "__text", "__nth"


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted quality is 1. The model is fitted on the labelled documents among docs that are not held out; statistics are those of the whole text and are computed once a row, beside the row."""
    model = quality.fit_quality(docs, common.table(spark, sf_dir, "labels"))
    return quality.with_statistics(docs, lambda stats: stats.where(model.column() >= 0.3))


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (a Jaccard similarity of 0.8 or more over 5-word shingles, transitively) the row with the smallest doc_id, of its texts the one with the smallest digest; of repeated rows one. Rows of one doc_id with texts that are no near copies all stay."""
    found = similar.similar_documents(docs, width=5, similarity=0.8)
    stay = found.select(F.col("component_id").alias(_ID), F.col("component_digest").alias(_DIGEST)).distinct()
    own = docs.withColumn(_TEXT, F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    kept = own.join(stay, (F.col("doc_id") == F.col(_ID)) & (F.col(_TEXT) == F.col(_DIGEST))).drop(_ID, _DIGEST)
    once = kept.withColumn(_NTH, F.row_number().over(Window.partitionBy("doc_id", _TEXT).orderBy(F.lit(0)))).where(f"{_NTH} = 1").drop(_NTH, _TEXT)
    return once.unionByName(docs.where("doc_id is null"))


def repeat_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that a 50-word window repeated from a smaller doc_id covers; texts that lose nothing stay as they are. n_chars follows the text where the table has it."""
    spans = repeats.repeated_spans(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    return repeats.cut_spans(docs, spans)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens; see packing.pack for the columns."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), end_id=0, room=2048)


STAGES = [("quality_filter", quality_filter), ("near_duplicates", near_duplicate_filter), ("repeats", repeat_filter), ("packing", packed)]

#: The stages' rules (a fitted forest, graph components, long windows, a tokenizer) are beyond SQL: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = common.table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs, at = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            common.discard(spark, before)
        before = at
    return docs
