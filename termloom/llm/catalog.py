"""Queries over the training-data tables, and DuckDB twins where SQL has them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from termloom.llm import bitpack, decontam, langid, neardup, packing, pii, quality, quotes, sharding, topk
from termloom.llm.common import table


def op6_token_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.token_file_digest(table(spark, sf_dir, "documents"))


def op1_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "p_text", "p_meta", "quality_score", "accepted")


def op2_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op3_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op4_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op5_bigru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_ordered(table(spark, sf_dir, "conversations"))


def op10_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_cotraining_quality, op2_weak_supervision_pii, op3_lsh_forest, op4_histogram_topk, op5_bigru_language, op6_token_bitpack, op7_wu_manber, op8_histogram_shards, op9_quote_linking, op10_cutting_stock)}


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')"

OP3_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format('[^ \t-\r]+')} AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
d AS (SELECT DISTINCT doc_id, g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM d a JOIN d b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r AS (SELECT u AS a, u AS b FROM e UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u),
m AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(m.m, w.doc_id) AS BIGINT) AS component_id,
       coalesce(m.m, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = w.doc_id
"""

_ITEM_WORDS = _WORDS.format("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")

OP7_SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS w FROM benchmark),
t AS (SELECT DISTINCT item, least(8, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(8, len(w)) + 2), lambda i: array_to_string(w[i:i + least(8, len(w)) - 1], ' '))) AS g
      FROM b WHERE len(w) > 0),
d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
p AS (SELECT doc_id, k.n, unnest(range(1, len(w) - k.n + 2)) AS i, w FROM d, (SELECT DISTINCT n FROM t) k),
h AS (SELECT p.doc_id, p.i, p.n, t.item FROM p JOIN t ON t.n = p.n AND t.g = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')),
q AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
c AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(len(items), 0) >= 2 AS contaminated
FROM d LEFT JOIN q USING (doc_id) LEFT JOIN c USING (doc_id)
"""


OP4_SQL = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row AS query, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.row <> c.row AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_histogram_topk": OP4_SQL, "op3_lsh_forest": OP3_SQL, "op7_wu_manber": OP7_SQL}
