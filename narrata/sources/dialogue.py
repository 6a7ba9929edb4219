"""The text model over the given tables: canonical texts of conversations, their quotes, chapters, gaps and ledgers.

A conversation's canonical text joins, turn by turn, its quoted text on one line and a line of narration. Offsets are
code points, ranges half open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION = "scanner-1"
#: Longest quote that is kept, turns of a chapter.
MAX_QUOTE, CHAPTER_TURNS = 1200, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, turn, role, quoted, seg, start_cp, end_cp of each turn's lines."""
    t = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("book"), "turn", "role", F.concat(F.lit("「"), F.regexp_replace("text", "\n", " "), F.lit("」")).alias("quoted")
    )
    t = t.withColumn("seg", F.concat("quoted", F.lit("\n"), "role", F.lit("。\n")))
    w = Window.partitionBy("book").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("seg").cast("long")).over(w)
    return t.withColumn("end_cp", end).withColumn("start_cp", F.col("end_cp") - F.length("seg"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, quote_id, turn, role, quoted, start_cp, end_cp of the quotes within the length limit."""
    q = segments(spark, sf_dir).withColumn("end_cp", F.col("start_cp") + F.length("quoted")).filter(F.length("quoted") <= MAX_QUOTE)
    key = F.concat_ws("|", F.col("book").cast("string"), F.col("start_cp").cast("string"), F.col("end_cp").cast("string"), F.lit(VERSION))
    return q.select("book", F.concat(F.lit("q"), F.substring(F.sha1(key.cast("binary")), 1, 31)).alias("quote_id"), "turn", "role", "quoted", "start_cp", "end_cp")


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    return s.groupBy("book", F.floor(F.col("turn") / CHAPTER_TURNS).alias("ordinal")).agg(F.min("start_cp").alias("start_cp"), F.max("end_cp").alias("end_cp"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelling of every quote, by rules on its turn and role."""
    q = quotes(spark, sf_dir)
    m = F.col("turn") % 5
    return q.select(
        "book", "quote_id", "turn", "start_cp", "end_cp", F.col("role").alias("speaker"),
        F.when(F.col("role") == "system", "quotation").otherwise("speech").alias("kind"),
        F.when(m == 4, "UNKNOWN").otherwise("EXISTING").alias("assignment"),
        F.when(m == 0, "DIRECT").when(m == 1, "CONTEXT").otherwise("ALTERNATION").alias("basis"),
        F.when(m == 4, "UNKNOWN").when(m >= 2, "PROVISIONAL").otherwise("ACCEPTED").alias("status"),
        (F.col("turn") % 7 == 6).alias("stale"), (F.col("turn") % 11 == 3).alias("user_locked"),
        F.when(F.col("turn") % 3 == 0, F.col("end_cp")).otherwise(F.col("start_cp")).alias("visible_from_cp"),
    )


def review_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, target, status, reason, detail of labelled documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    t = table(spark, sf_dir, "labels").join(d, "doc_id")
    return t.select(
        F.col("doc_id").alias("item"), (F.col("doc_id") % 50).alias("target"), "n_chars", "source",
        F.when(F.col("toxic") == 1, "PENDING").when(F.col("quality") == 0, "DEFERRED").otherwise("RESOLVED").alias("status"),
        F.when(F.col("n_chars") > 3000, "MODEL").otherwise("RULE").alias("reason"),
        F.when(F.col("doc_id") % 9 == 0, "{bad").otherwise(F.concat(F.lit('{"reason":"r'), (F.col("doc_id") % 3).cast("string"), F.lit('"}'))).alias("detail"),
    )


#: The same tables in the SQL of the other engine.
SQL = {
    "segments": """segments AS (
  SELECT book, turn, role, quoted, seg, start_cp, start_cp + length(seg) AS end_cp FROM (
    SELECT *, CAST(coalesce(sum(length(seg)) OVER (PARTITION BY book ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_cp FROM (
      SELECT *, quoted || chr(10) || role || '。' || chr(10) AS seg FROM (
        SELECT conv_id AS book, turn, role, '「' || replace(text, chr(10), ' ') || '」' AS quoted FROM conversations))))""",
    "quotes": """quotes AS (
  SELECT book, 'q' || substring(sha1(book || '|' || start_cp || '|' || (start_cp + length(quoted)) || '|scanner-1'), 1, 31) AS quote_id,
    turn, role, quoted, start_cp, start_cp + length(quoted) AS end_cp FROM segments WHERE length(quoted) <= 1200)""",
    "chapters": """chapters AS (
  SELECT book, CAST(floor(turn / 4) AS BIGINT) AS ordinal, min(start_cp) AS start_cp, max(end_cp) AS end_cp FROM segments GROUP BY 1, 2)""",
    "annotations": """annotations AS (
  SELECT book, quote_id, turn, start_cp, end_cp, role AS speaker, CASE WHEN role = 'system' THEN 'quotation' ELSE 'speech' END AS kind,
    CASE WHEN turn % 5 = 4 THEN 'UNKNOWN' ELSE 'EXISTING' END AS assignment,
    CASE turn % 5 WHEN 0 THEN 'DIRECT' WHEN 1 THEN 'CONTEXT' ELSE 'ALTERNATION' END AS basis,
    CASE WHEN turn % 5 = 4 THEN 'UNKNOWN' WHEN turn % 5 >= 2 THEN 'PROVISIONAL' ELSE 'ACCEPTED' END AS status,
    turn % 7 = 6 AS stale, turn % 11 = 3 AS user_locked,
    CASE WHEN turn % 3 = 0 THEN end_cp ELSE start_cp END AS visible_from_cp FROM quotes)""",
    "review": """review AS (
  SELECT l.doc_id AS item, l.doc_id % 50 AS target, n_chars, source,
    CASE WHEN toxic = 1 THEN 'PENDING' WHEN quality = 0 THEN 'DEFERRED' ELSE 'RESOLVED' END AS status,
    CASE WHEN n_chars > 3000 THEN 'MODEL' ELSE 'RULE' END AS reason,
    CASE WHEN l.doc_id % 9 = 0 THEN '{bad' ELSE '{"reason":"r' || (l.doc_id % 3) || '"}' END AS detail
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)""",
}


def with_sql(*names: str) -> str:
    order = ["segments", "quotes", "chapters", "annotations", "review"]
    needs = {"segments": [], "quotes": ["segments"], "chapters": ["segments"], "annotations": ["segments", "quotes"], "review": []}
    used = {x for n in names for x in [n, *needs[n]]}
    return "WITH " + ", ".join(SQL[n] for n in order if n in used) + " "
