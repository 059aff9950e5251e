"""The queries of this subpackage, each applying one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphlens.llm.common import table


def tokenizer_file(name: str) -> str:
    """The path of a public tokenizer; the files stay where they are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphlens.llm.media import media_features

    return media_features(table(spark, sf_dir, "documents"), unit=192)


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphlens.llm.vectors import nearest

    return nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphlens.llm.lattice import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphlens.llm.tokens import token_files

    return token_files(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphlens.llm.repeats import digest, without_repeats

    return digest(without_repeats(table(spark, sf_dir, "documents"), window=50))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphlens.llm.pieces import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), limit=4096)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphlens.llm.html import extract

    return extract(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphlens.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0, room=2048)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphlens.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphlens.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphlens.llm.mixing import mixed_rows

    return mixed_rows(table(spark, sf_dir, "documents"), weights=(3, 1, 2))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphlens.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"), least=10, best=2000, inside=50)


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphlens.llm.audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_media, op2_nearest, op3_sentencepiece, op4_token_files, op5_repeats, op6_token_counts, op7_html_text, op8_packing, op9_simhash, op10_quality, op11_mix, op12_phrases, op13_audit, pipeline)}


#: Every window of every text: feasible for DuckDB at the sizes where oracles run. Words hold no space, so joined words are windows.
_REPEATS = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(0, 50)) AS j FROM win JOIN least USING (k) WHERE m < doc_id)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


#: Pieces, their words, and every run of one to three words of a piece.
_PHRASES = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
word AS (SELECT lang, p, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM w),
run AS (SELECT lang, w AS x, lead(w, 1) OVER q AS y, lead(w, 2) OVER q AS z FROM word WINDOW q AS (PARTITION BY p ORDER BY i)),
g AS (SELECT lang, x AS g, '' AS g1, '' AS h1, '' AS g2, '' AS h2, 1 AS k, count(*) AS f FROM run GROUP BY ALL HAVING count(*) >= 10
  UNION ALL SELECT lang, x || ' ' || y, x, y, NULL, NULL, 2, count(*) FROM run WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
  UNION ALL SELECT lang, x || ' ' || y || ' ' || z, x, y || ' ' || z, x || ' ' || y, z, 3, count(*) FROM run WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
part AS (SELECT lang, g, f AS a, k, 1 AS cut, g1 AS gl, h1 AS gr FROM g WHERE k > 1 UNION ALL SELECT lang, g, f, k, 2, g2, h2 FROM g WHERE k = 3),
cut AS (SELECT part.*, l.f AS l, r.f AS r, CAST((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score FROM part JOIN g AS l ON l.lang = part.lang AND l.g = gl JOIN g AS r ON r.lang = part.lang AND r.g = gr),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
around AS (SELECT lang, g, max(f) AS m FROM (SELECT lang, g2 AS g, f FROM g WHERE k = 3 UNION ALL SELECT lang, h1, f FROM g WHERE k = 3) GROUP BY lang, g),
kept AS (SELECT low.*, low.g AS phrase FROM low LEFT JOIN around USING (lang, g) WHERE m IS NULL OR 100 * m < 50 * a)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank, phrase, a, l, r, n, score FROM kept JOIN total USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""

#: Failure masks by part, then every order of the five bits.
_AUDIT = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT d.doc_id, part, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM d),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM f LEFT JOIN labels USING (doc_id) GROUP BY part, mask),
b(x, c) AS (VALUES (1, 'A'), (2, 'B'), (4, 'C'), (8, 'D'), (16, 'E')),
o AS (SELECT [p.x, q.x, r.x, s.x, t.x] AS o, p.c || q.c || r.c || s.c || t.c AS filter_order FROM b p, b q, b r, b s, b t WHERE p.x + q.x + r.x + s.x + t.x = 31 AND p.x <> q.x AND p.x <> r.x AND p.x <> s.x AND p.x <> t.x AND q.x <> r.x AND q.x <> s.x AND q.x <> t.x AND r.x <> s.x AND r.x <> t.x AND s.x <> t.x),
e AS (SELECT filter_order, step, o[step] AS bit, coalesce(list_sum(o[1:step - 1]), 0)::BIGINT AS before FROM o, range(1, 6) AS s(step)),
r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost FROM m, e GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""


def oracle_sql() -> dict[str, str]:
    """SQL for what it can express; tokenizers, images, page trees, fitted models, XXH64 and approximate search are tested against the libraries, round trips or brute force."""
    return {"op5_repeats": _REPEATS, "op12_phrases": _PHRASES, "op13_audit": _AUDIT}
