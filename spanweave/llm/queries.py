"""The driver's queries of the corpus operators, and their DuckDB equivalents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_table, cotraining, delta_lloyd, epsilon_grid, exact_dedup, harmonic, pii_semicrf, prefix_doubling, secret_forest, simhash, site_style_tree, source_divergence, topk_postings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_site_style_tree(spark, sf_dir):
    return site_style_tree.extract(table(spark, sf_dir, "pages"))


def op2_semicrf_pii(spark, sf_dir):
    return pii_semicrf.find_personal_data(table(spark, sf_dir, "documents"), pii_semicrf.model())


def op3_bpe_word_table(spark, sf_dir):
    return bpe_table.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_epsilon_grid(spark, sf_dir):
    return epsilon_grid.near_vectors(table(spark, sf_dir, "embeddings"), least=0.9)


def op5_cotraining_quality(spark, sf_dir):
    rows = cotraining.featured(table(spark, sf_dir, "documents"), ["doc_id"])
    scored = cotraining.score(rows, cotraining.fit(rows, table(spark, sf_dir, "labels")))
    return scored.selectExpr("doc_id", "round(quality_score, 6) AS quality_score", "quality_score >= 0.5 AS accepted")


def op6_secret_forest(spark, sf_dir):
    return secret_forest.scan(table(spark, sf_dir, "documents"), secret_forest.train())


def op7_harmonic_packing(spark, sf_dir):
    return harmonic.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_simhash_pigeonhole(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.dedup_exact(table(spark, sf_dir, "documents"))


def op10_prefix_doubling(spark, sf_dir):
    found = prefix_doubling.remove_repeats(table(spark, sf_dir, "documents"), length=400)
    return found.withColumn("repeated", F.col("n_removed") > 0)


def op11_topk_postings(spark, sf_dir):
    return topk_postings.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


def op12_delta_lloyd(spark, sf_dir):
    return delta_lloyd.compress(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)


def op13_source_divergence(spark, sf_dir):
    return source_divergence.audit(table(spark, sf_dir, "documents"), least_documents=30, top=50)


def queries():
    found = [op1_site_style_tree, op2_semicrf_pii, op3_bpe_word_table, op4_epsilon_grid, op5_cotraining_quality, op6_secret_forest, op7_harmonic_packing, op8_simhash_pigeonhole, op9_exact_dedup, op10_prefix_doubling, op11_topk_postings, op12_delta_lloyd, op13_source_divergence]
    return {f.__name__: f for f in found}


_OP9 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""

_OP11 = r"""
WITH e AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.q, b.q)]) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""

_OP12 = r"""
WITH e AS (
  SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), parts AS (
  SELECT vec_id, label, p, [q[p * (len(q) // 16) + i] FOR i IN range(1, len(q) // 16 + 1)] AS v FROM e, range(16) t(p)
), b0 AS (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS j, v AS c FROM parts QUALIFY j < 64
), a1 AS (
  SELECT vec_id, x.p, arg_min(j, (d, j)) AS j, any_value(v) AS v FROM (
    SELECT vec_id, parts.p, j, v, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v, c)]) AS d FROM parts JOIN b0 ON parts.p = b0.p) x
  GROUP BY vec_id, x.p
), s1 AS (
  SELECT p, j, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT p, j, v, unnest(range(1, len(v) + 1)) AS i FROM a1) x GROUP BY p, j, i
), m1 AS (
  SELECT p, j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s1 GROUP BY p, j
), b1 AS (
  SELECT b0.p, b0.j, coalesce(m1.c, b0.c) AS c FROM b0 LEFT JOIN m1 ON b0.p = m1.p AND b0.j = m1.j
), a2 AS (
  SELECT vec_id, x.p, arg_min(j, (d, j)) AS j, any_value(v) AS v FROM (
    SELECT vec_id, parts.p, j, v, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v, c)]) AS d FROM parts JOIN b1 ON parts.p = b1.p) x
  GROUP BY vec_id, x.p
), s2 AS (
  SELECT p, j, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT p, j, v, unnest(range(1, len(v) + 1)) AS i FROM a2) x GROUP BY p, j, i
), m2 AS (
  SELECT p, j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s2 GROUP BY p, j
), b2 AS (
  SELECT b1.p, b1.j, coalesce(m2.c, b1.c) AS c FROM b1 LEFT JOIN m2 ON b1.p = m2.p AND b1.j = m2.j
), a3 AS (
  SELECT vec_id, label, x.p, arg_min(j, (d, j)) AS j, min(d) AS d FROM (
    SELECT vec_id, label, parts.p, j, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v, c)]) AS d FROM parts JOIN b2 ON parts.p = b2.p) x
  GROUP BY vec_id, label, x.p
), rows AS (
  SELECT vec_id, label, string_agg(printf('%02x', j), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a3 GROUP BY vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, j)) FROM b2) AS codebooks_sha256
FROM rows
"""

_OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), w AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
full_c AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v)::HUGEINT AS p FROM full_c JOIN v USING (lang)
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v)::HUGEINT AS q
  FROM (SELECT lang, term, sum(n) AS n FROM full_c GROUP BY lang, term) x JOIN v USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM rows
QUALIFY part = 'pair' OR rank <= 50
"""


def oracle_sql():
    return {"op9_exact_dedup": _OP9, "op11_topk_postings": _OP11, "op12_delta_lloyd": _OP12, "op13_source_divergence": _OP13}
