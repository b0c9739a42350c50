"""The queries of this subpackage, and the SQL that states their results where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import bpe, decontam, fingerprint, jaccard_join, pii, quality, sharding, toxicity, url_filters, warc
from netloom.llm.common import held_out
from netloom.session import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), url_filters.rules_frame(spark))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve(warc.records_of_pages(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return out.select("record_id", "canonical_url", "target_id", "status", lines.alias("headers"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.neighbours(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_tables(docs, table(spark, sf_dir, "labels"))
    out = quality.score(docs.select("doc_id", "text"), model, out="score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_tables(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs.select("doc_id", "text"), model, out="score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "toxic_hits")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_warc_revisits, op3_byte_bpe, op4_decontamination, op5_fingerprints, op6_sharding, op7_pii, op8_quality, op9_toxicity, op10_jaccard_join)}

ORACLE_SQL = {
    "op1_url_filters": """
WITH cut AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fit AS (
  SELECT p.page_id, p.host, p.path, r.rule_host || r.rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.rule_host || r.rule_path) DESC, length(r.rule_host) DESC) AS k
  FROM parts p LEFT JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE k = 1
""",
    "op2_warc_revisits": r"""
WITH base AS (
  SELECT page_id, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS etag, octet_length(encode(coalesce(html, ''))) AS size,
         regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS rest
  FROM pages WHERE url IS NOT NULL AND page_id IS NOT NULL
), split AS (
  SELECT page_id, etag, size,
         regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www[0-9]*\.', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/$', '') AS path,
         regexp_replace(regexp_replace(regexp_extract(rest, '\?(.*)$', 1), '(?i)(^|&)(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid)=[^&]*', '', 'g'), '^&', '') AS query
  FROM base
), canon AS (
  SELECT page_id, etag, size, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical_url FROM split
), revisits AS (
  SELECT page_id * 2 + 1 AS record_id, canonical_url, page_id + 1 + (page_id * 7919) % 1000 AS ts, etag FROM canon
), pairs AS (
  SELECT r.record_id, r.canonical_url, r.ts, r.etag, c.page_id, c.etag AS stored, c.size,
         row_number() OVER (PARTITION BY r.record_id ORDER BY c.page_id DESC) AS k
  FROM revisits r LEFT JOIN canon c ON c.canonical_url = r.canonical_url AND (c.page_id < r.ts OR (c.page_id = r.ts AND c.page_id * 2 < r.record_id))
)
SELECT record_id, canonical_url, page_id * 2 AS target_id,
       CASE WHEN page_id IS NULL THEN 'orphan' WHEN etag = stored THEN 'resolved' ELSE 'mismatch' END AS status,
       CASE WHEN page_id IS NOT NULL AND etag = stored THEN
         'cache-control: max-age=60' || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'etag: W/' || etag END AS headers
FROM pairs WHERE k = 1
""",
    "op6_sharding": """
WITH RECURSIVE bits(i, k, v) AS (
  SELECT i::BIGINT, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8
), crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8
), sized AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
), summed AS (
  SELECT doc_id, size,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT)), lambda a, b: xor(t[xor(a & 255, b) + 1], a >> 8))) AS text_crc32
  FROM sized, crc_table
), led AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lead, sum(size) OVER () AS total FROM summed
), cut AS (
  SELECT *, CAST(least(7, (2 * lead + size) * 8 // (2 * total)) AS INTEGER) AS shard FROM led
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM cut
""",
}
