"""Every operator over one table of odd rows: null and empty texts, repeated rows, texts that are no UTF-8, one very long text, extra columns with the operators' own names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from graphlens.llm import html, lattice, media, mixing, packing, pieces, quality, repeats, simhash, tokens

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
OPERATORS = {
    "media": lambda d: media.media_features(d),
    "sentencepiece": lambda d: lattice.round_trip(d, PIECES),
    "token files": lambda d: tokens.token_files(d, BYTES, 2),
    "repeats": lambda d: repeats.digest(repeats.without_repeats(d)),
    "token counts": lambda d: pieces.token_counts(d, PIECES),
    "html": lambda d: html.extract(d.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("url"), F.col("text").alias("html"), "fp", "k")),
    "simhash": lambda d: simhash.near_duplicates(d),
    "statistics": lambda d: quality.described(d),
    "mixing": lambda d: mixing.mixed_rows(d.withColumn("source", F.col("lang"))),
    "packing": lambda d: packing.pack(d, BYTES, 0, 2048).where("piece = 0"),
}


@pytest.fixture(scope="module")
def odd(spark):
    texts = [b"plain text", b"plain text", None, b"", b" \n\t ", b"no utf \xff\xfe\xc3 at all", b"\xc3", "é ü 日本 🙂".encode(), b"x" * 70_000, b"word " * 60_000, b"\0\x1c a"]
    rows = [(None if k == 4 else max(k, 1), None if x is None else bytearray(x), None, 1, "z", 2.0) for k, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, b binary, lang string, fp int, k string, log_words double")
    return df.select("doc_id", F.expr("cast(b as string)").alias("text"), "lang", "fp", "k", F.lit(1).alias("crc"), F.lit(2).alias("spans"), F.lit("p").alias("part"), F.lit(3).alias("media"), "log_words")


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each(name, odd):
    assert OPERATORS[name](odd).count() == odd.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(name, odd):
    assert OPERATORS[name](odd.limit(0)).count() == 0
