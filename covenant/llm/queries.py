"""The registered queries: each applies an operator with its production
parameters to a whole table and returns the contract's columns."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann_search, exact_dedup, lang_id, licenses, mixing, packing, pii, prefix_trie, role_repair, simhash, suffix_dedup, topk_search, warc
from .common import table


def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.scan(docs, pii.fit(docs))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk_search.usable(table(spark, sf_dir, "embeddings"))
    return topk_search.search(rows, rows.filter("id % 20 = 0"), 20)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.membership(table(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", lang_id.held_out().alias("held_out"))
    return lang_id.predict(rows, lang_id.fit(docs), ("doc_id", "held_out"))


def op10_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op11_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_repair.repaired(table(spark, sf_dir, "conversations"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_learned_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ann_search.usable(table(spark, sf_dir, "embeddings"))
    return ann_search.search(rows, rows.filter("id % 50 = 0"), 5)


QUERIES = {
    "op1_pii_spans": op1_pii_spans,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_topk_search": op3_topk_search,
    "op4_license_scan": op4_license_scan,
    "op5_source_mix": op5_source_mix,
    "op6_warc_segments": op6_warc_segments,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_language_id": op9_language_id,
    "op10_curve_packing": op10_curve_packing,
    "op11_role_repair": op11_role_repair,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_learned_ann": op13_learned_ann,
}

#: for the queries that SQL can express; tests hold the others against brute force
ORACLE_SQL = {
    "op3_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(64 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""",
    "op6_warc_segments": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS best FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
         ((strpos('0123456789abcdef', substr(h, 1 + (5 * i) // 4, 1)) - 1) * 16
          + greatest(strpos('0123456789abcdef', substr(h, 2 + (5 * i) // 4, 1)) - 1, 0)) // CAST(2 ** (3 - (5 * i) % 4) AS BIGINT)) % 32, 1)), '') AS payload_digest,
       CASE WHEN best = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN best <> page_id THEN best END AS refers_to, true AS complete
FROM d""",
    "op7_exact_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(text) AS text_sha256
FROM d WINDOW same AS (PARTITION BY text)""",
}
