"""The operators as queries on the shared tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_model, license_scan, mixing, near_dup, quality, token_count, topk, toxicity, url_filter
from .common import table
from .labelled import crc_of


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=5, percent=80)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"), keep=crc_of(F.col("doc_id")) % 5 != 0))


def base_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1 that SQL can say."""
    return op1_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def base_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3 that SQL can say; the verdict where a rule gives it."""
    return op3_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def base_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_token_count(spark, sf_dir).select("doc_id", "n_words")


def base_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5 that SQL can say; the base score to four places."""
    return op5_lm_score(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def base_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that SQL can say; the target to six places."""
    return op6_mix_sources(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    base = (base_license_scan, base_url_filter, base_token_count, base_lm_score, base_mix_sources)
    return {f.__name__: f for f in (*base, op1_license_scan, op2_toxicity, op3_url_filter, op4_token_count, op5_lm_score, op6_mix_sources, op7_top_k, op8_near_dup, op9_decontaminate, op10_quality)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

_BASE = license_scan.BASE_PHRASES
_PLACES = ", ".join(f"list_transform(list_filter(range(1, len(w) + 1), lambda i: array_to_string(w[i:i + {len(p.split()) - 1}], ' ') = '{p}'), lambda i: {{'at': i - 1, 'label': '{label}'}})" for p, label in _BASE.items())
_RULES = ", ".join(f"('{kind}', '{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}')" for kind, rule in url_filter.RULES)

ORACLE_SQL = {
    "base_license_scan": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
h AS (SELECT doc_id, w, flatten([{_PLACES}]) AS hits FROM d)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(hits) AS BIGINT) AS n_base, list_min(list_transform(hits, lambda h: h.at)) AS first_word, list_max(list_transform(hits, lambda h: h.at)) AS last_word,
       array_to_string(list_sort(list_distinct(list_transform(hits, lambda h: h.label))), ',') AS base_labels
FROM h
""",
    "base_url_filter": rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS h, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
q AS (SELECT page_id, translate(coalesce(h, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(path, '') AS path FROM p),
r AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(kind, length(rule)) AS verdict FROM q, (VALUES {_RULES}) AS t(kind, rule, rh, rp)
      WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT q.page_id, host, path, rule, verdict FROM q LEFT JOIN r USING (page_id)
""",
    "base_token_count": rf"SELECT doc_id, CAST(len({_WORDS}) AS BIGINT) AS n_words FROM documents",
    "base_lm_score": rf"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), i)) AS t),
d AS (SELECT doc_id, list_append({_WORDS}, chr(10)) AS w,
        coalesce(xor(list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 5 = 1, false) AS held_out
      FROM documents, crc),
tok AS (SELECT doc_id, held_out, unnest(w) AS x FROM d),
c AS (SELECT x, count(*) AS n FROM tok WHERE NOT held_out GROUP BY x),
z AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n_all, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c.n) AS n_known, any_value(n_all) AS train_tokens, round(sum(log10((coalesce(c.n, 0) + 0.5) / (n_all + 0.5 * (v + 1)))), 4) AS base_score
FROM tok LEFT JOIN c USING (x), z GROUP BY doc_id, held_out
""",
    "base_mix_sources": rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, CAST(encode(source) AS VARCHAR)) - 1) % 3 + 1] AS DOUBLE) AS weight FROM d GROUP BY source),
lvl AS (
  SELECT 0 AS round, CAST(0 AS DOUBLE) AS level
  UNION ALL
  SELECT round + 1, (SELECT (sum(source_size) - coalesce(sum(3 * source_size) FILTER (3 * source_size <= lvl.level * weight), 0)) / sum(weight) FILTER (3 * source_size > lvl.level * weight) FROM s)
  FROM lvl WHERE round < 60)
SELECT doc_id, size, source_size, round(least(3.0 * source_size, (SELECT max(level) FROM lvl) * weight), 6) AS target
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
""",
    "op7_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op8_near_dup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
                 ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, sets.doc_id = component_id AS kept
FROM sets JOIN c ON sets.doc_id = c.doc_id
""",
    "op9_decontaminate": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
ds AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')))) AS x FROM d WHERE len(w) >= 5),
isets AS (SELECT item_id, list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM i WHERE len(w) >= 5),
ish AS (SELECT item_id, len(s) AS n, unnest(s) AS x FROM isets)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS item_shingles, count(*) AS shared, count(*) / n AS containment
FROM ds JOIN ish USING (x) GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 80 * n
""",
}
