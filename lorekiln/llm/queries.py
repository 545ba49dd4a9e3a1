"""The registered queries of this package, opN_<name>, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, fingerprints, line_dedup, mixing, ngram_join, quality, substring_dedup, token_counts, toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(documents(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(documents(spark, sf_dir), _labels(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(documents(spark, sf_dir))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.report(documents(spark, sf_dir))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(documents(spark, sf_dir))


#: Setting of the session that names a folder for op8's cache; unset, each call has one of its own.
TOKEN_CACHE = "spark.lorekiln.tokenCache"


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), spark.conf.get(TOKEN_CACHE, None))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(documents(spark, sf_dir), _labels(spark, sf_dir))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(documents(spark, sf_dir))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


OP1_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""

OP3_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS pos, w FROM words WHERE len(w) >= 20),
windows AS (SELECT doc_id, pos, md5(array_to_string(w[pos:pos + 19], ' ')) AS h FROM starts),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS nth FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM ranked WHERE nth > 1),
units AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM words),
kept AS (
  SELECT u.doc_id, count(g.pos) AS n_removed, string_agg(word, ' ' ORDER BY u.pos) FILTER (g.pos IS NULL) AS kept
  FROM units u LEFT JOIN gone g ON u.doc_id = g.doc_id AND u.pos = g.pos GROUP BY u.doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""

OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
starts AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS pos, w FROM words WHERE len(w) > 0),
sets AS (SELECT DISTINCT doc_id, md5(array_to_string(w[pos:pos + 2], ' ')) AS h FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM sets a JOIN sets b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y
  WHERE 100 * shared >= 90 * (s.n + t.n - shared)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reached AS (
  SELECT x, y FROM both_ways
  UNION
  SELECT r.x, b.y FROM reached r JOIN both_ways b ON r.y = b.x),
least AS (SELECT x, min(y) AS y FROM reached GROUP BY x)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(y, w.doc_id)) AS component_id
FROM words w LEFT JOIN sizes s ON w.doc_id = s.doc_id LEFT JOIN least l ON l.x = w.doc_id
"""

OP7_SQL = r"""
WITH lines AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(l) - 1)) AS pos, l FROM lines WHERE len(l) >= 3),
windows AS (SELECT doc_id, pos, array_to_string(l[pos:pos + 2], chr(10)) AS h FROM starts WHERE regexp_matches(array_to_string(l[pos:pos + 2], ''), '[^\x20\x09-\x0D]')),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS nth FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 3)) AS pos FROM ranked WHERE nth > 1),
units AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line FROM lines),
kept AS (
  SELECT u.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, string_agg(line, chr(10) ORDER BY u.pos) FILTER (g.pos IS NULL) AS kept
  FROM units u LEFT JOIN gone g ON u.doc_id = g.doc_id AND u.pos = g.pos GROUP BY u.doc_id)
SELECT doc_id, n_lines, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM kept
"""

OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce('s' || source, 't') AS queue,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix' || chr(1) || CAST(doc_id AS VARCHAR)) AS place
  FROM documents),
sources AS (SELECT queue, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY queue),
weighed AS (
  SELECT queue, source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY queue) - 1) % 3 + 1]::DOUBLE AS weight, (3 * source_size)::DOUBLE AS top
  FROM sources),
filling AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(top) OVER (ORDER BY top / weight, queue ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY top / weight, queue ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
final AS (SELECT max(level) AS level FROM filling WHERE NOT top < weight * level),
goals AS (SELECT queue, source_size, CASE WHEN top < weight * filling.level THEN top ELSE weight * final.level END AS target FROM filling, final),
queued AS (
  SELECT s.*, source_size, target,
         sum(size) OVER (PARTITION BY s.queue ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized s JOIN goals g ON s.queue = g.queue),
entries AS (
  SELECT doc_id, queue, place, size, turn, (turn * source_size + upto)::DOUBLE / target AS finish
  FROM queued, (VALUES (0), (1), (2)) AS turns(turn) WHERE size > 0 AND target > 0),
merged AS (
  SELECT *, sum(size) OVER (ORDER BY finish, queue, turn, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM entries),
took AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM merged WHERE total <= (SELECT sum(size) FROM sized) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0) AS taken
FROM queued q LEFT JOIN took t ON q.doc_id = t.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op3_substring_dedup": OP3_SQL, "op7_line_dedup": OP7_SQL, "op4_ngram_join": OP4_SQL, "op6_mixing": OP6_SQL}
