"""Chunks of code and text for retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_CHARS = 8000


def split_oversized(df: DataFrame, most: int = MAX_CHARS) -> DataFrame:
    """df(code, start_line, ...) -> a row for each part: part int (0: whole), start_line, end_line, code. Longer codes than `most` are cut behind the line with which a part reaches it; a part is at least one line.

    The parts are a fold over the lines that starts anew at each cut, in one expression and without a shuffle.
    """
    lines = F.split("code", "\n", -1)
    state = "struct<begin:int,size:bigint,i:int,cuts:array<int>>"
    zero = F.struct(F.lit(1).alias("begin"), F.lit(0).cast("bigint").alias("size"), F.lit(1).alias("i"), F.array().cast("array<int>").alias("cuts")).cast(state)

    def add(s: Column, line: Column) -> Column:
        size = s["size"] + F.length(line) + 1
        full = size >= most
        return F.struct(s["begin"].alias("begin"), F.when(full, F.lit(0).cast("bigint")).otherwise(size).alias("size"), (s["i"] + 1).alias("i"), F.when(full, F.concat(s["cuts"], F.array(s["i"]))).otherwise(s["cuts"]).alias("cuts")).cast(state)

    n = F.size("_lines")
    cuts = F.when(F.length("code") > most, F.aggregate("_lines", zero, add, lambda s: s["cuts"])).otherwise(F.array().cast("array<int>"))
    ends = F.when(F.element_at("_cuts", -1) == n, F.col("_cuts")).otherwise(F.concat("_cuts", F.array(n)))
    made = df.withColumn("_lines", lines).withColumn("_cuts", cuts).withColumn("_ends", F.when(F.size("_cuts") == 0, F.array(n)).otherwise(ends))
    made = made.select("*", F.posexplode("_ends").alias("_k", "_end"))
    first = F.when(F.col("_k") == 0, 1).otherwise(F.get("_ends", F.col("_k") - 1) + 1)
    code = F.when(F.length("code") > most, F.array_join(F.slice("_lines", F.col("_first"), F.col("_end") - F.col("_first") + 1), "\n")).otherwise(F.col("code"))
    made = made.withColumn("_first", first).withColumn("part", F.when(F.length("code") > most, F.col("_k") + 1).otherwise(0)).withColumn("code", code)
    made = made.withColumn("end_line", (F.col("start_line") + F.col("_end") - 1).cast("int")).withColumn("start_line", (F.col("start_line") + F.col("_first") - 1).cast("int"))
    return made.drop("_lines", "_cuts", "_ends", "_k", "_end", "_first")


def context_blocks(df: DataFrame, keys: list[str], order: list[str], block: Column) -> DataFrame:
    """(keys, context): a key's blocks in order with an empty line between them."""
    rows = df.select(*keys, F.struct(*order, block.alias("_block")).alias("_row"))
    made = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    return made.select(*keys, F.array_join(F.transform("_rows", lambda r: r["_block"]), "\n\n").alias("context"))


def chunk_files(files: DataFrame, definitions: DataFrame, most: int = MAX_CHARS) -> DataFrame:
    """Chunks of code files: what is before the first definition, each definition, or the whole file where there is none; long ones in parts.

    A definition without an end (end_line null or 0) ends before the next one. Columns: id, path, language, kind, name, qualified_name, start_line,
    end_line, code, parent_qualified_name, oversized, part.
    """
    f = files.where("not skipped").select("path", "language", F.regexp_replace("text", "\r\n?", "\n").alias("text"), F.element_at(F.split("path", "/"), -1).alias("base"))
    f = f.withColumn("lines", F.split("text", "\n", -1)).withColumn("n_lines", F.size("lines") - F.when(F.col("text").endswith("\n"), 1).otherwise(0))
    w = Window.partitionBy("file").orderBy("start_line", "ord")
    d = definitions.withColumn("next_start", F.lead("start_line").over(w)).select(F.col("file").alias("path"), "kind", "name", "qualified_name", "start_line", F.when(F.col("end_line") > 0, F.col("end_line")).alias("end_line"), "next_start", "ord")
    both = f.join(d, "path", "left")
    end = F.least(F.coalesce("end_line", F.greatest(F.col("start_line"), F.col("next_start") - 1), F.col("n_lines")), F.col("n_lines"))
    code = lambda a, b: F.array_join(F.slice("lines", a, F.greatest(b - a + 1, F.lit(0))), "\n")
    own = both.where("qualified_name is not null").withColumn("s", F.greatest("start_line", F.lit(1))).withColumn("e", end)
    own = own.select("path", "language", "kind", "name", "qualified_name", F.col("s").alias("start_line"), code(F.col("s"), F.col("e")).alias("code"))
    first = definitions.groupBy(F.col("file").alias("path")).agg(F.min("start_line").alias("first"))
    heads = f.join(first, "path").withColumn("e", F.least(F.greatest(F.col("first") - 1, F.lit(0)), F.col("n_lines"))).where("e > 0")
    heads = heads.select("path", "language", F.lit("file_header").alias("kind"), F.col("base").alias("name"), F.concat("path", F.lit("::<header>")).alias("qualified_name"), F.lit(1).alias("start_line"), code(F.lit(1), F.col("e")).alias("code"))
    whole = both.where("qualified_name is null").select("path", "language", F.lit("file").alias("kind"), F.col("base").alias("name"), F.concat("path", F.lit("::<file>")).alias("qualified_name"), F.lit(1).alias("start_line"), code(F.lit(1), F.col("n_lines")).alias("code"))
    made = split_oversized(own.unionByName(heads).unionByName(whole).where("trim(code) <> ''"), most)
    where = F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string"))
    id_ = F.when(F.col("kind") == "file_header", F.concat("path", F.lit("::<header>"))).when(F.col("part") > 0, F.concat_ws("::", "path", "qualified_name", F.concat(F.lit("part"), F.col("part").cast("string")), where)).otherwise(F.concat_ws("::", "path", "qualified_name", where))
    from graphlens.functions.text import parent_of

    return made.withColumn("id", id_).withColumn("parent_qualified_name", parent_of(F.col("qualified_name"))).withColumn("oversized", F.col("part") > 0)


def retrieval_context(found: DataFrame) -> DataFrame:
    """(query_id, context) from the chunks found for a query, in rank order: ### label (place) and the code."""
    block = F.concat(F.lit("### "), F.coalesce("qualified_name", "name", F.lit("?")), F.lit(" ("), "path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(")\n"), "code")
    return context_blocks(found, ["query_id"], ["rank"], block)
