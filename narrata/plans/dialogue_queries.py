"""Queries over the text model and its ledgers, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from narrata.operators import intervals, text
from narrata.sources import dialogue as src
from narrata.sources.dialogue import table, with_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BIG = "CAST({} AS BIGINT)"


def query(sql: str | None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def n(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


@query("""SELECT doc_id, CAST(line - 1 AS BIGINT) AS line, CAST(e - length(t) AS BIGINT) AS start_cp, CAST(e AS BIGINT) AS end_cp FROM (
SELECT doc_id, line, t, sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY line) - 1 AS e FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents))""")
def s5_line_offsets(s, d):
    return text.lines(table(s, d, "documents"))


@query("""SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 1.0 ELSE 1 - (length(text) - length(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{E000}-\\x{F8FF}\\x{FFFD}]', '', 'g'))) / length(text) END, 6) AS plausibility FROM documents""")
def s2_plausibility(s, d):
    return table(s, d, "documents").select("doc_id", F.round(text.plausibility(F.col("text")), 6).alias("plausibility"))


@query("SELECT sha256(text) AS digest, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1")
def s18_import_dedup(s, d):
    return table(s, d, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.min("doc_id").alias("first_id"), n("copies"))


@query(with_sql("quotes") + "SELECT book, left_id, right_id, a AS gap_start, b AS gap_end FROM (SELECT book, quote_id AS left_id, lead(quote_id) OVER w AS right_id, end_cp AS a, lead(start_cp) OVER w AS b FROM quotes WINDOW w AS (PARTITION BY book ORDER BY start_cp)) WHERE b > a")
def t8_gaps(s, d):
    return intervals.gaps(src.quotes(s, d)).select("book", "left_id", "right_id", "gap_start", "gap_end")


@query(with_sql("quotes") + "SELECT book, quote_id, start_cp FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY start_cp) AS k FROM quotes WHERE start_cp > 200) WHERE k <= 3")
def f1_keyset_page(s, d):
    w = Window.partitionBy("book").orderBy("start_cp")
    return src.quotes(s, d).filter("start_cp > 200").withColumn("k", F.row_number().over(w)).filter("k <= 3").select("book", "quote_id", "start_cp")


@query("SELECT event_id, user_id, ts FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-03 00:00:00', 50) ORDER BY ts, event_id LIMIT 51")
def f2_time_cursor(s, d):
    after = F.struct("ts", "event_id") > F.struct(F.lit("2024-01-03 00:00:00").cast("timestamp").alias("ts"), F.lit(50).cast("long").alias("event_id"))
    return table(s, d, "events").filter(after).orderBy("ts", "event_id").limit(51).select("event_id", "user_id", "ts")


@query(with_sql("review") + "SELECT item, CASE WHEN json_valid(detail) THEN json_extract_string(detail, '$.reason') END AS why FROM review WHERE status IN ('PENDING', 'DEFERRED')")
def f5_queue_json(s, d):
    return src.review_items(s, d).filter(F.col("status").isin("PENDING", "DEFERRED")).select("item", F.get_json_object("detail", "$.reason").alias("why"))


@query(with_sql("annotations") + "SELECT book, quote_id, speaker FROM annotations WHERE visible_from_cp <= 1500 AND NOT stale AND status <> 'UNKNOWN'")
def f7_horizon(s, d):
    return src.annotations(s, d).filter("visible_from_cp <= 1500 AND NOT stale AND status <> 'UNKNOWN'").select("book", "quote_id", "speaker")


@query(with_sql("review") + "SELECT item, CASE WHEN status = 'PENDING' AND reason = 'MODEL' THEN 'model' WHEN status = 'PENDING' THEN 'rule' ELSE 'other' END AS shown FROM review WHERE status <> 'RESOLVED'")
def f8_display_reason(s, d):
    shown = F.when((F.col("status") == "PENDING") & (F.col("reason") == "MODEL"), "model").when(F.col("status") == "PENDING", "rule").otherwise("other")
    return src.review_items(s, d).filter("status <> 'RESOLVED'").select("item", shown.alias("shown"))


@query(with_sql("quotes", "chapters") + "SELECT q.book, q.quote_id, c.ordinal FROM quotes q JOIN chapters c ON q.book = c.book AND q.start_cp < c.end_cp AND c.start_cp < q.end_cp")
def j4_overlap(s, d):
    q = src.quotes(s, d).select("book", "quote_id", F.col("start_cp").alias("l_start"), F.col("end_cp").alias("l_end"))
    c = src.chapters(s, d).select("book", "ordinal", F.col("start_cp").alias("r_start"), F.col("end_cp").alias("r_end"))
    return intervals.overlapping(q, c).select("book", "quote_id", "ordinal")


@query(with_sql("quotes") + ", h AS (SELECT DISTINCT book, unnest([100, 1000, 5000]) AS at FROM quotes) SELECT h.book, CAST(h.at AS BIGINT) AS at, q.quote_id FROM h JOIN quotes q ON h.book = q.book AND q.start_cp <= h.at AND h.at < q.end_cp")
def j5_stabbing(s, d):
    q = src.quotes(s, d)
    h = q.select("book").distinct().select("book", F.explode(F.array(*[F.lit(x).cast("long") for x in (100, 1000, 5000)])).alias("at"))
    r = q.select("book", "quote_id", F.col("start_cp").alias("r_start"), F.col("end_cp").alias("r_end"))
    return intervals.containing(h, r).select("book", "at", "quote_id")


@query(with_sql("quotes") + "SELECT book, quote_id, lag(quote_id) OVER w AS prev_id, lead(quote_id) OVER w AS next_id FROM quotes WINDOW w AS (PARTITION BY book ORDER BY start_cp)")
def j8_neighbours(s, d):
    w = Window.partitionBy("book").orderBy("start_cp")
    return src.quotes(s, d).select("book", "quote_id", F.lag("quote_id").over(w).alias("prev_id"), F.lead("quote_id").over(w).alias("next_id"))


@query(with_sql("annotations") + ", h AS (SELECT unnest([500, 2000]) AS horizon) SELECT book, CAST(horizon AS BIGINT) AS horizon, max_by(speaker, (visible_from_cp, speaker)) AS speaker FROM annotations, h WHERE visible_from_cp <= horizon GROUP BY 1, 2")
def j9_as_of(s, d):
    a = src.annotations(s, d).select("book", "speaker", "visible_from_cp")
    h = a.select("book").distinct().select("book", F.explode(F.array(F.lit(500).cast("long"), F.lit(2000).cast("long"))).alias("horizon"))
    return intervals.latest_as_of(a, h, ["book"], "speaker")


@query(with_sql("review") + "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM review r WHERE r.item = d.doc_id AND r.status = 'PENDING')")
def j10_semi(s, d):
    r = src.review_items(s, d).filter("status = 'PENDING'").select(F.col("item").alias("doc_id"))
    return table(s, d, "documents").select("doc_id").join(r, "doc_id", "left_semi")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j12_anti(s, d):
    return table(s, d, "documents").select("doc_id").join(table(s, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query(with_sql("annotations") + """, p AS (SELECT book, speaker AS gold, CASE WHEN turn % 7 = 0 THEN 'user' ELSE speaker END AS pred, count(*) AS c FROM annotations GROUP BY 1, 2, 3)
SELECT book, CAST(hit AS BIGINT) AS tp, CAST(p2 - hit AS BIGINT) AS fp, CAST(g2 - hit AS BIGINT) AS fn FROM (SELECT book, sum(c * (c - 1) / 2) AS hit FROM p GROUP BY 1)
JOIN (SELECT book, sum(c * (c - 1) / 2) AS p2 FROM (SELECT book, pred, sum(c) AS c FROM p GROUP BY 1, 2) GROUP BY 1) USING (book)
JOIN (SELECT book, sum(c * (c - 1) / 2) AS g2 FROM (SELECT book, gold, sum(c) AS c FROM p GROUP BY 1, 2) GROUP BY 1) USING (book)""")
def j14_pair_counts(s, d):
    # Pairs are counted from group sizes; none is made.
    a = src.annotations(s, d).select("book", F.col("speaker").alias("gold"), F.when(F.col("turn") % 7 == 0, "user").otherwise(F.col("speaker")).alias("pred"))
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2).cast("long")
    cell = a.groupBy("book", "gold", "pred").agg(n("c"))
    both = cell.groupBy("book").agg(two("c").alias("both"))
    p = cell.groupBy("book", "pred").agg(F.sum("c").alias("c")).groupBy("book").agg(two("c").alias("p"))
    g = cell.groupBy("book", "gold").agg(F.sum("c").alias("c")).groupBy("book").agg(two("c").alias("g"))
    return both.join(p, "book").join(g, "book").select("book", F.col("both").alias("tp"), (F.col("p") - F.col("both")).alias("fp"), (F.col("g") - F.col("both")).alias("fn"))


@query(with_sql("review") + "SELECT status, count(*) AS items, count(DISTINCT target) AS targets FROM review GROUP BY 1")
def a1_review_counts(s, d):
    return src.review_items(s, d).groupBy("status").agg(n("items"), F.count_distinct("target").alias("targets"))


@query(with_sql("annotations", "chapters") + "SELECT a.book, speaker, count(DISTINCT quote_id) AS dialogues, count(DISTINCT ordinal) AS chapters, min(a.start_cp) AS first_cp FROM annotations a JOIN chapters c ON a.book = c.book AND a.start_cp >= c.start_cp AND a.start_cp < c.end_cp WHERE kind = 'speech' AND NOT stale AND status IN ('ACCEPTED', 'PROVISIONAL', 'USER_CONFIRMED') GROUP BY 1, 2")
def a2_appearances(s, d):
    a = src.annotations(s, d).filter("kind = 'speech' AND NOT stale AND status IN ('ACCEPTED', 'PROVISIONAL', 'USER_CONFIRMED')").withColumn("at", F.col("start_cp"))
    c = src.chapters(s, d).select("book", "ordinal", F.col("start_cp").alias("r_start"), F.col("end_cp").alias("r_end"))
    return intervals.containing(a, c).groupBy("book", "speaker").agg(F.count_distinct("quote_id").alias("dialogues"), F.count_distinct("ordinal").alias("chapters"), F.min("at").alias("first_cp"))


@query("SELECT event_type AS state, count(*) AS runs, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens, count(*) FILTER (json_extract_string(props, '$.k') IS NULL) AS unknown_runs FROM events GROUP BY 1")
def a3_usage(s, d):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(s, d, "events").groupBy(F.col("event_type").alias("state")).agg(n("runs"), F.sum(k).alias("tokens"), F.count_if(k.isNull()).alias("unknown_runs"))


@query("SELECT count(*) AS runs FROM events WHERE event_type IN ('error', 'purchase')")
def a5_runs_by_state(s, d):
    return table(s, d, "events").filter(F.col("event_type").isin("error", "purchase")).agg(n("runs"))


@query(with_sql("annotations", "chapters") + "SELECT c.book, c.ordinal, count(a.quote_id) AS quotes, count(a.quote_id) FILTER (a.assignment <> 'UNKNOWN') AS annotated FROM chapters c LEFT JOIN annotations a ON a.book = c.book AND a.start_cp >= c.start_cp AND a.start_cp < c.end_cp GROUP BY 1, 2")
def a8_chapter_coverage(s, d):
    c = src.chapters(s, d).select("book", "ordinal", F.col("start_cp").alias("r_start"), F.col("end_cp").alias("r_end"))
    met = intervals.containing(src.annotations(s, d).withColumn("at", F.col("start_cp")), c)
    got = met.groupBy("book", "ordinal").agg(n("quotes"), F.count_if(F.col("assignment") != "UNKNOWN").alias("annotated"))
    return c.select("book", "ordinal").join(got, ["book", "ordinal"], "left").na.fill(0, ["quotes", "annotated"])


@query(with_sql("annotations") + "SELECT kind, status, count(*) AS n FROM annotations GROUP BY 1, 2")
def a11_kind_histogram(s, d):
    return src.annotations(s, d).groupBy("kind", "status").agg(n())


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def w1_latest_run(s, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(s, d, "events").withColumn("k", F.row_number().over(w)).filter("k = 1").select("user_id", "event_id", "ts")


@query(with_sql("quotes") + "SELECT book, quote_id, max(end_cp) OVER (PARTITION BY book ORDER BY start_cp ROWS UNBOUNDED PRECEDING) AS furthest FROM quotes")
def w4_prefix_max(s, d):
    w = Window.partitionBy("book").orderBy("start_cp").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return src.quotes(s, d).select("book", "quote_id", F.max("end_cp").over(w).alias("furthest"))


@query(with_sql("quotes") + "SELECT book, CAST(floor((k - 1) / 8) AS BIGINT) AS block, count(*) AS quotes, min(start_cp) AS start_cp, max(end_cp) AS end_cp FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY start_cp) AS k FROM quotes) GROUP BY 1, 2")
def w5_blocks(s, d):
    k = F.row_number().over(Window.partitionBy("book").orderBy("start_cp")) - 1
    return src.quotes(s, d).withColumn("block", F.floor(k / 8)).groupBy("book", "block").agg(n("quotes"), F.min("start_cp").alias("start_cp"), F.max("end_cp").alias("end_cp"))


@query(with_sql("quotes") + "SELECT book, quote_id, start_cp FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY start_cp DESC) AS k FROM quotes) WHERE k <= 8")
def w7_last_turns(s, d):
    w = Window.partitionBy("book").orderBy(F.desc("start_cp"))
    return src.quotes(s, d).withColumn("k", F.row_number().over(w)).filter("k <= 8").select("book", "quote_id", "start_cp")


@query(with_sql("annotations") + """SELECT book, min(start_cp) AS start_cp, max(end_cp) AS end_cp, count(*) AS quotes FROM (SELECT *, sum(CASE WHEN prev IS NOT DISTINCT FROM speaker THEN 0 ELSE 1 END) OVER (PARTITION BY book ORDER BY start_cp) AS run FROM (SELECT *, lag(speaker) OVER (PARTITION BY book ORDER BY start_cp) AS prev FROM annotations)) GROUP BY book, run""")
def w9_islands(s, d):
    w = Window.partitionBy("book").orderBy("start_cp")
    a = src.annotations(s, d).withColumn("new", F.when(F.lag("speaker").over(w).eqNullSafe(F.col("speaker")), 0).otherwise(1))
    return a.withColumn("run", F.sum("new").over(w)).groupBy("book", "run").agg(F.min("start_cp").alias("start_cp"), F.max("end_cp").alias("end_cp"), n("quotes")).drop("run")


@query(with_sql("annotations") + "SELECT speaker, count(DISTINCT book) AS books, count(*) AS dialogues FROM annotations GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 8")
def o4_top_speakers(s, d):
    return src.annotations(s, d).groupBy("speaker").agg(F.count_distinct("book").alias("books"), n("dialogues")).orderBy(F.desc("books"), F.desc("dialogues"), "speaker").limit(8)


@query("SELECT o_custkey AS key FROM orders UNION SELECT c_custkey FROM customer")
def u1_union(s, d):
    return table(s, d, "orders").select(F.col("o_custkey").alias("key")).union(table(s, d, "customer").select("c_custkey")).distinct()


@query("SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders")
def u2_difference(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("key")).exceptAll(table(s, d, "orders").select("o_custkey")).distinct()


@query(with_sql("annotations") + "SELECT book, quote_id FROM annotations WHERE NOT user_locked AND start_cp >= 500 AND NOT stale")
def d32_stale_targets(s, d):
    return src.annotations(s, d).filter("NOT user_locked AND start_cp >= 500 AND NOT stale").select("book", "quote_id")


@query(with_sql("quotes") + """SELECT q.book, q.quote_id, substring(whole, CAST(greatest(q.start_cp - 120, 0) AS BIGINT) + 1, CAST(q.start_cp - greatest(q.start_cp - 120, 0) AS BIGINT)) AS before FROM quotes q JOIN (SELECT book, string_agg(seg, '' ORDER BY turn) AS whole FROM segments GROUP BY 1) t ON q.book = t.book""")
def x1_quote_context(s, d):
    # Segments that end in the 120 code points before a quote are found by range, so that no whole text is built.
    seg = src.segments(s, d).select("book", F.col("start_cp").alias("r_start"), F.col("end_cp").alias("r_end"), "seg")
    q = src.quotes(s, d).select("book", "quote_id", F.greatest(F.col("start_cp") - 120, F.lit(0)).alias("l_start"), F.col("start_cp").alias("l_end"))
    met = intervals.overlapping(q.filter("l_start < l_end"), seg)
    a = F.greatest("l_start", "r_start")
    part = met.withColumn("part", F.substring("seg", (a - F.col("r_start") + 1).cast("int"), (F.least("l_end", "r_end") - a).cast("int")))
    joined = part.groupBy("book", "quote_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_start", "part"))), lambda x: x["part"]), "").alias("before"))
    return q.select("book", "quote_id").join(joined, ["book", "quote_id"], "left").na.fill("", ["before"])
