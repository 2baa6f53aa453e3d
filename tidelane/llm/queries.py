"""Queries of the training-data operators with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelane.llm import embeddings, language, lines, packing, pieces, quality, rules, simhash, substrings, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


#: All pairs of valid vectors, and the least id that links reach.
_OP1_SQL = """
WITH RECURSIVE valid AS (
  SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
unit AS (SELECT vec_id, [x / sqrt(list_dot_product(v, v)) FOR x IN v] AS u FROM valid),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.u, b.u) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
root AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM root LEFT JOIN counts USING (vec_id)
"""


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("mark")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"), keep_text=False)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision on every line; ``lines.remove_lines`` rewrites the texts."""
    found = lines.similar_lines(_table(spark, sf_dir, "documents"))
    return found.selectExpr("id AS doc_id", "CAST(no AS BIGINT) AS line_no", "kept")


#: Every line against every earlier one with which it shares a shingle.
_OP7_SQL = r"""
WITH texts AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
l AS (SELECT doc_id, (generate_subscripts(ls, 1) - 1)::BIGINT AS line_no, unnest(ls) AS line FROM texts),
w AS (SELECT doc_id, line_no, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l),
t AS (SELECT doc_id, line_no, CASE WHEN len(ws) >= 5 THEN list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)])
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS tokens FROM w),
e AS (SELECT doc_id, line_no, len(tokens) AS k, unnest(tokens) AS token FROM t),
pairs AS (SELECT a.doc_id, a.line_no, a.k AS ka, b.k AS kb, count(*) AS c FROM e a JOIN e b
  ON a.token = b.token AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.line_no < a.line_no))
  GROUP BY a.doc_id, a.line_no, a.k, b.doc_id, b.line_no, b.k),
gone AS (SELECT DISTINCT doc_id, line_no FROM pairs WHERE c >= 0.8 * (ka + kb - c) - 1e-9)
SELECT doc_id, line_no, g IS NULL AS kept FROM t LEFT JOIN (SELECT *, 1 AS g FROM gone) USING (doc_id, line_no)
"""


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.encode(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model")))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_table(spark, sf_dir, "documents"))


#: Every 13-word window as text, its least document, and the words left.
_OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 11, 1))) AS i FROM w),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM starts),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
bad AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN least USING (k) WHERE doc_id > m),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN bad USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_language_id": op4_language_id,
    "op5_toxicity": op5_toxicity,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_quality_rules": op10_quality_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_near_dedup": _OP1_SQL,
    "op6_substring_dedup": _OP6_SQL,
    "op7_line_dedup": _OP7_SQL,
}
