"""The registered queries of the text operators: each applies one with its production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ionweave.llm import decontamination, html, langid, neardup, packing, pii, quality, secrets, separators, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.document_tokens(table(spark, sf_dir, "documents"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop(*quality.RATES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_packing, op3_langid, op4_secrets, op5_neardup, op6_separators, op7_urls, op8_decontamination, op9_html, op10_quality)
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(name: str, key: str) -> str:
    return f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORDS}') AS w FROM {name}"


_LEAST = " ".join(f"WHEN '{k}' THEN {a!r}::DOUBLE + {r!r}::DOUBLE * min(v) FILTER (WHERE upto >= total * 0.5)" for k, (a, r, _) in quality.RATES.items())

ORACLE_SQL: dict[str, str] = {
    "op8_decontamination": f"""
WITH d AS ({_words("documents", "doc_id")}), b AS ({_words("benchmark", "item_id")}),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lengths WHERE len(w) >= n)
),
occurs AS (SELECT doc_id, item_id, dw.n, k FROM dw JOIN win ON dw.n = win.n AND dw.phrase = win.phrase),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM occurs) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occurs) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op10_quality": rf"""
WITH c AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM c WHERE len(w) >= 3)),
again AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS p FROM again) GROUP BY doc_id),
lines AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM c) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
m AS (
  SELECT c.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(dup.n_lines, 0) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM c LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)
),
r AS (
  SELECT doc_id, lang, source, u.rate, u.x, CAST(ceil(ln(u.x * 1000.0::DOUBLE + 1.0::DOUBLE) / {quality.GAMMA!r}::DOUBLE) AS INT) AS bucket
  FROM (SELECT doc_id, lang, source, unnest([
    {{'rate': 'symbol_rate', 'x': CASE WHEN word_chars > 0 THEN n_symbols::DOUBLE / word_chars ELSE 0.0::DOUBLE END}},
    {{'rate': 'dup_line_rate', 'x': CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0.0::DOUBLE END}},
    {{'rate': 'repeat_rate', 'x': CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0.0::DOUBLE END}},
    {{'rate': 'word_length', 'x': CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0.0::DOUBLE END}}]) AS u FROM m)
),
sketch AS (SELECT lang, source, rate, bucket, count(*) AS n FROM r GROUP BY ALL),
levels AS (
  SELECT 1 AS level, lang, source, rate, bucket, n FROM sketch
  UNION ALL SELECT 2, lang, NULL, rate, bucket, sum(n) FROM sketch GROUP BY lang, rate, bucket
  UNION ALL SELECT 3, NULL, NULL, rate, bucket, sum(n) FROM sketch GROUP BY rate, bucket
),
ranked AS (
  SELECT level, lang, source, rate, CASE WHEN bucket = 0 THEN 0.0::DOUBLE ELSE (exp(bucket * {quality.GAMMA!r}::DOUBLE) * (2 / (1 + exp({quality.GAMMA!r}::DOUBLE))) - 1) / 1000.0::DOUBLE END AS v,
         sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, rate) AS total
  FROM levels
),
quart AS (
  SELECT level, lang, source, rate, min(v) FILTER (WHERE upto >= total * 0.25) AS q1, min(v) FILTER (WHERE upto >= total * 0.5) AS q2, min(v) FILTER (WHERE upto >= total * 0.75) AS q3,
         CASE rate {_LEAST} END AS least
  FROM ranked WHERE level = 3 OR total >= 50 GROUP BY level, lang, source, rate
),
fence AS (
  SELECT level, lang, source, rate, CASE rate WHEN 'word_length' THEN q2 - 8 * greatest(q2 - q1, least) ELSE -1 END AS lo, q2 + 8 * greatest(q3 - q2, least) AS hi FROM quart
),
verdict AS (
  SELECT r.doc_id, bool_or(r.x < coalesce(a.lo, b.lo, e.lo) OR r.x > coalesce(a.hi, b.hi, e.hi)) AS outside
  FROM r LEFT JOIN fence a ON a.level = 1 AND a.rate = r.rate AND a.lang IS NOT DISTINCT FROM r.lang AND a.source IS NOT DISTINCT FROM r.source
  LEFT JOIN fence b ON b.level = 2 AND b.rate = r.rate AND b.lang IS NOT DISTINCT FROM r.lang
  LEFT JOIN fence e ON e.level = 3 AND e.rate = r.rate GROUP BY r.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT outside AS kept
FROM m JOIN verdict USING (doc_id)
""",
}
