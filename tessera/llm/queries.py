"""Queries of the training-data operators, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, keyed_upsert, log_bilinear, max_score, merkle, metric_join, mixing, packing, page_text, pieces, ppm_language, sentence_spans, token_files


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.pareto_mix(_documents(spark, sf_dir)).drop("text_hash")


def op2_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op3_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_language.identify(_documents(spark, sf_dir))


def op4_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_bilinear.score(_documents(spark, sf_dir))


def op5_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_score.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_suffix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.dedup(_documents(spark, sf_dir))


def op9_golomb_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir)).drop("text_hash")


def op10_metric_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_duplicates(_documents(spark, sf_dir)).drop("text_hash", "group_key")


def op11_set_algebra_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_upsert.upsert_clients(spark.read.parquet(f"{sf_dir}/clients.parquet"), spark.read.parquet(f"{sf_dir}/client_changes.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(_documents(spark, sf_dir))


def op13_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pareto_mixing": op1_pareto_mixing,
    "op2_repair_tokens": op2_repair_tokens,
    "op3_ppm_language": op3_ppm_language,
    "op4_log_bilinear": op4_log_bilinear,
    "op5_host_suffix_array": op5_host_suffix_array,
    "op6_max_score": op6_max_score,
    "op7_suffix_pieces": op7_suffix_pieces,
    "op8_sentence_spans": op8_sentence_spans,
    "op9_golomb_exact_dedup": op9_golomb_exact_dedup,
    "op10_metric_jaccard_join": op10_metric_jaccard_join,
    "op11_set_algebra_upsert": op11_set_algebra_upsert,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_sum_of_squares_packing": op13_sum_of_squares_packing,
}

#: The same ranking and the same prefix, without the histogram.
OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM d GROUP BY source
), c AS (
  SELECT *, (3 * source_size)::DOUBLE AS cap, CASE turn % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s
), l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - (sum(cap) OVER up - cap)) / ((sum(weight) OVER ()) - (sum(weight) OVER up - weight)) AS level
  FROM c WINDOW up AS (ORDER BY cap / weight, turn ROWS UNBOUNDED PRECEDING)
), t AS (
  SELECT source, source_size, least(cap, (SELECT max(level) FROM l WHERE level <= cap / weight) * weight) AS target FROM l
), e AS (
  SELECT doc_id, source, size, u, source_size, target,
         CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size::DOUBLE) ELSE 0.0::DOUBLE END AS expected
  FROM d JOIN t USING (source) WHERE source IS NOT NULL
  UNION ALL
  SELECT doc_id, d.source, size, u, source_size, target,
         CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size::DOUBLE) ELSE 0.0::DOUBLE END
  FROM d JOIN t ON d.source IS NULL AND t.source IS NULL
), f AS (
  SELECT *, floor(expected)::BIGINT AS sure, expected - floor(expected) AS p FROM e
), r AS (
  SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q,
         target - sum(sure * size) OVER (PARTITION BY source) AS need FROM f
), x AS (
  SELECT *, sum(CASE WHEN q IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM r
), y AS (
  SELECT *, sure + CASE WHEN q IS NOT NULL AND 2 * upto - size <= 2 * need THEN 1 ELSE 0 END AS copies FROM x
)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies, p FROM y
"""

OP9_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""

OP6_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS key, vec_id AS id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), e AS (
  SELECT key, id, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM v
), s AS (
  SELECT q.key, q.id AS query_id, c.key AS other, c.id AS vec_id, sum(q.x * c.x)::BIGINT AS score FROM e q JOIN e c ON q.d = c.d AND q.key <> c.key WHERE q.id % 20 = 0 GROUP BY ALL
)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY key ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20
"""

#: Sets of shingles, links between all that share one, and what links reach.
OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS x FROM d
), e AS (
  SELECT doc_id, len(x) AS n, unnest(x) AS h FROM s
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), r AS (
  SELECT a AS doc_id, b AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other
)
SELECT s.doc_id, len(x)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id
FROM s LEFT JOIN (SELECT doc_id, min(other) AS m FROM r GROUP BY 1) c USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op6_max_score": OP6_SQL, "op1_pareto_mixing": OP1_SQL, "op9_golomb_exact_dedup": OP9_SQL, "op10_metric_jaccard_join": OP10_SQL}
