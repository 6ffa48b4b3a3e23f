"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wayloom.llm.bpe import bpe_round_trip
from wayloom.llm.chat import format_conversations
from wayloom.llm.common import read_table
from wayloom.llm.decontaminate import find_leaks
from wayloom.llm.ngram_join import jaccard_components
from wayloom.llm.pii import find_pii
from wayloom.llm.token_store import token_store
from wayloom.llm.topk import top_inner_products
from wayloom.llm.toxicity import toxicity
from wayloom.llm.url_filter import filter_urls, rules_frame
from wayloom.llm.warc import archive_pages

END_ID = 2
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def tokenizer_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(read_table(spark, sf_dir, "embeddings"), "k % 50 = 0", 5)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(read_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"), rules_frame(spark, URL_RULES))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(read_table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(read_table(spark, sf_dir, "conversations"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"), 4, 85)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_topk, op2_warc, op3_url_filter, op4_token_store, op5_toxicity, op6_decontaminate, op7_bpe, op8_chat, op9_ngram_join, op10_pii)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5""",
        "op2_warc": """
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS keep FROM d GROUP BY h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT) >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM d JOIN g USING (h)""",
        "op3_url_filter": """
WITH r(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS raw, rest FROM a),
w AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path FROM u),
m AS (SELECT w.page_id, r.host || r.path AS rule, r.verdict,
  row_number() OVER (PARTITION BY w.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS n
  FROM w JOIN r ON (w.host = r.host OR ends_with(w.host, '.' || r.host)) AND starts_with(w.path, r.path))
SELECT w.page_id, w.host, w.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM w LEFT JOIN m ON w.page_id = m.page_id AND m.n = 1""",
        "op9_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS f FROM w),
e AS (SELECT doc_id, len(f) AS n, unnest(f) AS g FROM s),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
c(x, y) AS (SELECT x, y FROM p UNION SELECT c.x, p.y FROM c JOIN p ON c.y = p.x)
SELECT s.doc_id, len(f)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m.least_id, s.doc_id)) AS component_id
FROM s LEFT JOIN (SELECT x, min(y) AS least_id FROM c GROUP BY x) m ON m.x = s.doc_id""",
    }
