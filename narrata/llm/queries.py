"""The operators' queries over their whole tables, with the parameters meant for production."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.llm import audit, chat, fingerprints, jaccard, lm, mixing, packing, periodic, piece_bpe, quality, secrets, tokens, warc

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_table(_table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secrets.scan(_table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(secrets.rendered(F.col("found"), secrets.BASE).cast("binary"), 256)
    return found.select("doc_id", *map(n, secrets.BASE), base.alias("base_sha256"), secrets.rendered(F.col("found")).alias("spans"))


def op5_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.held_out_scores(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_table(spark, sf_dir, "conversations"))


def op9_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"), jaccard.Likeness(4, 85))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.find_runs(periodic.with_planted_periods(_table(spark, sf_dir, "documents"))))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


QUERIES = {
    f.__name__: f
    for f in (
        op1_fingerprints, op2_mix_sources, op3_quality_rules, op4_secret_scan, op5_warc_archives, op6_lm_scoring,
        op7_token_counts, op8_chat_rotation, op9_best_two_fit, op10_jaccard_join, op11_filter_audit, op12_periodic_runs,
        op13_sentencepiece,
    )
}

ORACLES = {
    "op8_chat_rotation": """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), v AS (
  SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'
), h AS (
  SELECT t.conv_id, perspective, turn, role, role = perspective AS own, text,
    '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head
  FROM t JOIN v ON t.conv_id IS NOT DISTINCT FROM v.conv_id
), s AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM h
), o AS (
  SELECT *, row_number() OVER w - 1 AS seq,
    sum(length(segment)) OVER (w ROWS UNBOUNDED PRECEDING) - length(segment) AS start
  FROM s WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, segment)
)
SELECT conv_id, perspective, turn, CAST(seq AS BIGINT) AS seq, segment, CAST(start AS BIGINT) AS start,
  CASE WHEN own THEN CAST(start + length(head) AS BIGINT) END AS learn_start,
  CASE WHEN own THEN CAST(start + length(segment) - 1 AS BIGINT) END AS learn_end
FROM o
""",
    "op11_filter_audit": r"""
WITH RECURSIVE orders AS (
  SELECT '' AS o UNION ALL
  SELECT o || f FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(f) WHERE length(o) < 5 AND NOT contains(o, f)
), d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS lowest FROM documents
), w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d
), f AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > lowest THEN 'E' ELSE '' END AS fails
  FROM w
), l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), g AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails
), s AS (SELECT o AS filter_order, step, substr(o, step, 1) AS own, substr(o, 1, step - 1) AS before FROM orders, range(1, 6) r(step) WHERE length(o) = 5
), x AS (
  SELECT *, contains(fails, own) AS failed, len(list_intersect(string_split(fails, ''), string_split(before, ''))) > 0 AND before <> '' AS gone FROM g, s
), r AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, own,
    CAST(coalesce(sum(n) FILTER (WHERE NOT failed AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE failed AND NOT gone), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (WHERE failed AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (WHERE fails = own), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (WHERE failed AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (WHERE failed AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM x GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
""",
}
