"""Review queue, usage ledgers and projections, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from narrata.plans.dialogue_queries import n, query
from narrata.sources.model import frame, with_sql

ACTIVE = ("ACCEPTED", "PROVISIONAL", "USER_CONFIRMED")


def json(column: str, path: str):
    """The value at path; null for malformed texts."""
    return F.get_json_object(column, path)


def shown_reason():
    """The reason that a queue shows: active items of two reasons show what their cause says."""
    active, cause = F.col("status") != "RESOLVED", json("candidates", "$.reason")
    low = active & (F.col("reason") == "LOW_CONFIDENCE")
    return (
        F.when(low & (cause == "unknown_quote_kind"), "UNKNOWN_QUOTE_KIND")
        .when(low & (cause == "unapproved_expression_owner"), "AMBIGUOUS_SPEAKER")
        .when(active & (F.col("reason") == "UNKNOWN_SPEAKER") & (F.col("kind") == "quotation") & (cause == "insufficient_evidence"), "UNKNOWN_QUOTE_SOURCE")
        .otherwise(F.col("reason"))
    )


def with_kind(s, d):
    return frame(s, d, "items").join(frame(s, d, "outputs").select("quote_id", "kind"), "quote_id", "left")


REASON = """CASE WHEN status <> 'RESOLVED' AND reason = 'LOW_CONFIDENCE' AND cause = 'unknown_quote_kind' THEN 'UNKNOWN_QUOTE_KIND'
  WHEN status <> 'RESOLVED' AND reason = 'LOW_CONFIDENCE' AND cause = 'unapproved_expression_owner' THEN 'AMBIGUOUS_SPEAKER'
  WHEN status <> 'RESOLVED' AND reason = 'UNKNOWN_SPEAKER' AND kind = 'quotation' AND cause = 'insufficient_evidence' THEN 'UNKNOWN_QUOTE_SOURCE' ELSE reason END"""
SHOWN = with_sql("items", "outputs") + f""", shown AS (SELECT *, {REASON} AS shown FROM (
  SELECT i.*, o.kind, CASE WHEN json_valid(candidates) THEN json_extract_string(candidates, '$.reason') END AS cause FROM items i LEFT JOIN outputs o ON o.quote_id = i.quote_id)) """


@query(SHOWN + "SELECT item, shown AS reason FROM shown")
def f8_shown_reason(s, d):
    return with_kind(s, d).select("item", shown_reason().alias("reason"))


@query(SHOWN + """SELECT book, 'status' AS facet, status AS key, count(*) AS items, count(DISTINCT coalesce('quote:' || quote_id, 'gap:' || gap_id)) AS targets FROM shown GROUP BY 1, 3
UNION ALL SELECT book, 'reason', shown, count(*), NULL FROM shown GROUP BY 1, 3
UNION ALL SELECT book, 'all', 'all', count(*), count(DISTINCT coalesce('quote:' || quote_id, 'gap:' || gap_id)) FROM shown GROUP BY 1""")
def a1_review_summary(s, d):
    target = F.coalesce(F.concat(F.lit("quote:"), "quote_id"), F.concat(F.lit("gap:"), "gap_id"))
    # Each item is counted in three facets, from one reading of the rows.
    facet = lambda name, key: F.struct(F.lit(name).alias("facet"), key.alias("key"))
    facets = F.array(facet("status", F.col("status")), facet("reason", shown_reason()), facet("all", F.lit("all")))
    rows = with_kind(s, d).select("book", target.alias("target"), F.explode(facets).alias("f")).select("book", "target", "f.*")
    counts = rows.groupBy("book", "facet", "key").agg(n("items"), F.count_distinct("target").alias("targets"))
    return counts.withColumn("targets", F.when(F.col("facet") != "reason", F.col("targets")))


@query(SHOWN + """, g AS (SELECT gap_id AS gid, start_cp AS gs, end_cp AS ge FROM gaps), q AS (SELECT quote_id AS qid, start_cp AS qs, end_cp AS qe FROM quotes)
SELECT item, created, shown AS reason, coalesce(qs, gs) AS start_cp, coalesce(qe, ge) AS end_cp, k AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY book ORDER BY created, item) AS k FROM shown LEFT JOIN q ON qid = quote_id LEFT JOIN g ON gid = gap_id
  WHERE status = 'PENDING' AND (created, item) > (2, '')) WHERE k <= 4""")
def x8_review_page(s, d):
    rows = with_kind(s, d).filter("status = 'PENDING'").filter(F.struct("created", "item") > F.struct(F.lit(2).cast("long").alias("created"), F.lit("").alias("item")))
    q = frame(s, d, "quotes").select("quote_id", F.col("start_cp").alias("qs"), F.col("end_cp").alias("qe"))
    g = frame(s, d, "gaps").select("gap_id", F.col("start_cp").alias("gs"), F.col("end_cp").alias("ge"))
    w = Window.partitionBy("book").orderBy("created", "item")
    page = rows.withColumn("position", F.row_number().over(w)).filter("position <= 4")
    page = page.join(q, "quote_id", "left").join(g, "gap_id", "left")
    return page.select("item", "created", shown_reason().alias("reason"), F.coalesce("qs", "gs").alias("start_cp"), F.coalesce("qe", "ge").alias("end_cp"), "position")


USAGE = """SELECT *, unknown IS NOT TRUE AND (i IS NOT NULL OR o IS NOT NULL OR t IS NOT NULL) AS known FROM (
  SELECT *, CAST(j->>'$.input_tokens' AS BIGINT) AS i, CAST(j->>'$.output_tokens' AS BIGINT) AS o, CAST(j->>'$.total_tokens' AS BIGINT) AS t, (j->>'$.unknown') = 'true' AS unknown
  FROM (SELECT *, CASE WHEN json_valid(usage) THEN usage END AS j FROM runs))"""


def with_usage(runs):
    """Adds i, o, t (tokens), known (whether the run's usage says anything)."""
    i, o, t = (json("usage", f"$.{k}_tokens").cast("long") for k in ("input", "output", "total"))
    told = F.coalesce(json("usage", "$.unknown"), F.lit("")) != "true"
    return runs.withColumns({"i": i, "o": o, "t": t}).withColumn("known", told & F.coalesce("i", "o", "t").isNotNull())


def tokens(name: str, value):
    return F.coalesce(F.sum(F.when(F.col("known"), value)), F.lit(0)).alias(name)


def token_sums():
    total = F.coalesce("t", F.coalesce("i", F.lit(0)) + F.coalesce("o", F.lit(0)))
    return [tokens("input_tokens", F.coalesce("i", F.lit(0))), tokens("output_tokens", F.coalesce("o", F.lit(0))), tokens("total_tokens", total)]


SUMS = """CAST(coalesce(sum(coalesce(i, 0)) FILTER (known), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(coalesce(o, 0)) FILTER (known), 0) AS BIGINT) AS output_tokens,
  CAST(coalesce(sum(coalesce(t, coalesce(i, 0) + coalesce(o, 0))) FILTER (known), 0) AS BIGINT) AS total_tokens"""


@query(with_sql("runs") + f", u AS ({USAGE}) SELECT book, count(*) AS runs, count(*) FILTER (NOT known) AS unknown_runs, {SUMS} FROM u GROUP BY 1")
def a3_usage_summary(s, d):
    return with_usage(frame(s, d, "runs")).groupBy("book").agg(n("runs"), F.count_if(~F.col("known")).alias("unknown_runs"), *token_sums())


@query(with_sql("runs") + """SELECT book, 'state' AS facet, state AS key, count(*) AS runs FROM runs GROUP BY 1, 3
UNION ALL SELECT book, 'model', model, count(*) FROM (SELECT book, CASE WHEN json_valid(p) THEN json_extract_string(p, '$.model') END AS model FROM (SELECT book, coalesce(own_profile, job_profile) AS p FROM runs)) WHERE model <> '' GROUP BY 1, 3""")
def a3_usage_facets(s, d):
    runs = frame(s, d, "runs").select("book", "state", F.coalesce("own_profile", "job_profile").alias("profile"))
    by_state = runs.groupBy("book", F.lit("state").alias("facet"), F.col("state").alias("key")).agg(n("runs"))
    by_model = runs.withColumn("key", json("profile", "$.model")).filter("key <> ''").groupBy("book", F.lit("model").alias("facet"), "key").agg(n("runs"))
    return by_state.unionByName(by_model)


#: Failures after which a provider may have charged (fixed values).
CHARGED = ("INVALID_MODEL_OUTPUT", "LOCAL_FINALIZATION_FAILED", "PROVIDER_UNAVAILABLE")


@query(with_sql("runs") + f""", u AS ({USAGE}) SELECT job, {SUMS}, count(*) FILTER (CASE WHEN usage IS NULL THEN state IN ('DISPATCHED', 'UNKNOWN_OUTCOME', 'SUCCEEDED')
  OR (state = 'FAILED' AND error_code IN {CHARGED}) ELSE NOT known END) AS unknown_runs FROM u GROUP BY 1""")
def a4_spent_by_job(s, d):
    may_cost = F.col("state").isin("DISPATCHED", "UNKNOWN_OUTCOME", "SUCCEEDED") | ((F.col("state") == "FAILED") & F.col("error_code").isin(*CHARGED))
    unknown = F.when(F.col("usage").isNull(), may_cost).otherwise(~F.col("known"))
    return with_usage(frame(s, d, "runs")).groupBy("job").agg(*token_sums(), F.count_if(unknown).alias("unknown_runs"))


@query(with_sql("runs") + """, l AS (SELECT *, row_number() OVER (PARTITION BY job, win ORDER BY created_at DESC, run DESC) AS back, count(*) OVER (PARTITION BY job, win) AS attempts FROM runs)
SELECT job, count(*) AS windows, CAST(sum(attempts) AS BIGINT) AS calls, max(attempts) AS most_attempts, count(*) FILTER (state = 'SUCCEEDED') AS done,
  max_by(run, (created_at, run)) FILTER (state = 'FAILED' AND error_code IN ('RATE_LIMITED', 'PROVIDER_QUOTA_EXHAUSTED')) AS service_error_run FROM l WHERE back = 1 GROUP BY 1""")
def a7_job_detail(s, d):
    last = F.max(F.struct("created_at", "run", "state", "error_code"))
    windows = frame(s, d, "runs").groupBy("job", "win").agg(last.alias("last"), n("attempts")).select("job", "attempts", "last.*")
    failed = (F.col("state") == "FAILED") & F.col("error_code").isin("RATE_LIMITED", "PROVIDER_QUOTA_EXHAUSTED")
    return windows.groupBy("job").agg(
        n("windows"), F.sum("attempts").alias("calls"), F.max("attempts").alias("most_attempts"), F.count_if(F.col("state") == "SUCCEEDED").alias("done"),
        F.max(F.when(failed, F.struct("created_at", "run")))["run"].alias("service_error_run"),
    )


@query(with_sql("runs") + """SELECT run, json_extract_string(j, '$.input_tokens') AS input, json_extract_string(j, '$.output_tokens') AS output, json_extract_string(j, '$.total_tokens') AS total,
  json_extract_string(p, '$.model') AS model FROM (SELECT *, CASE WHEN json_valid(usage) THEN usage ELSE '{}' END AS j, CASE WHEN json_valid(own_profile) THEN own_profile ELSE '{}' END AS p,
  row_number() OVER (PARTITION BY book ORDER BY created_at DESC, run DESC) AS k FROM runs WHERE state IN ('DISPATCHED', 'SUCCEEDED') AND (created_at, run) < (TIMESTAMP '2024-01-20 00:00:00', 0)) WHERE k <= 20""")
def f5_task_queue(s, d):
    before = F.struct("created_at", "run") < F.struct(F.lit("2024-01-20 00:00:00").cast("timestamp_ntz").alias("created_at"), F.lit(0).cast("long").alias("run"))
    w = Window.partitionBy("book").orderBy(F.desc("created_at"), F.desc("run"))
    rows = frame(s, d, "runs").withColumn("created_at", F.col("created_at").cast("timestamp_ntz")).filter(F.col("state").isin("DISPATCHED", "SUCCEEDED") & before)
    paths = {"input": ("usage", "$.input_tokens"), "output": ("usage", "$.output_tokens"), "total": ("usage", "$.total_tokens"), "model": ("own_profile", "$.model")}
    return rows.withColumn("k", F.row_number().over(w)).filter("k <= 20").select("run", *(json(*p).alias(c) for c, p in paths.items()))


@query(with_sql("items", "outputs") + """, wanted AS (SELECT quote_id, 'LOW_CONFIDENCE' AS reason, '{"by": "rescan"}' AS candidates FROM outputs WHERE basis = 'STYLE_ONLY')
SELECT coalesce(i.quote_id, w.quote_id) AS quote_id, coalesce(i.reason, w.reason) AS reason, i.item IS NULL AS created,
  CASE WHEN w.quote_id IS NULL THEN i.status WHEN i.status = 'DEFERRED' THEN 'DEFERRED' ELSE 'PENDING' END AS status, coalesce(w.candidates, i.candidates) AS candidates
FROM (SELECT * FROM items WHERE quote_id IS NOT NULL) i FULL JOIN wanted w ON w.quote_id = i.quote_id AND w.reason = i.reason""")
def x6_review_upsert(s, d):
    wanted = frame(s, d, "outputs").filter("basis = 'STYLE_ONLY'").select("quote_id", F.lit("LOW_CONFIDENCE").alias("reason"), F.lit('{"by": "rescan"}').alias("_new"))
    both = frame(s, d, "items").filter("quote_id IS NOT NULL").join(wanted, ["quote_id", "reason"], "full")
    # A resolved item opens again, a deferred one stays so.
    status = F.when(F.col("_new").isNull(), F.col("status")).when(F.col("status") == "DEFERRED", "DEFERRED").otherwise("PENDING")
    return both.select("quote_id", "reason", F.col("item").isNull().alias("created"), status.alias("status"), F.coalesce("_new", "candidates").alias("candidates"))


@query(with_sql("items", "annotations") + """SELECT i.item, CASE WHEN NOT a.stale AND i.status <> 'RESOLVED' AND i.cause IN ('unknown_quote_kind', 'insufficient_evidence', 'style_only_basis')
  AND i.cause <> CASE WHEN a.status = 'UNKNOWN' THEN 'insufficient_evidence' ELSE 'direct_evidence' END THEN 'RESOLVED' ELSE i.status END AS status
FROM (SELECT *, CASE WHEN json_valid(candidates) THEN json_extract_string(candidates, '$.reason') END AS cause FROM items) i JOIN annotations a ON a.quote_id = i.quote_id""")
def x7_review_sync(s, d):
    now = frame(s, d, "annotations").select("quote_id", "stale", F.when(F.col("status") == "UNKNOWN", "insufficient_evidence").otherwise("direct_evidence").alias("now"))
    cause = json("candidates", "$.reason")
    over = ~F.col("stale") & (F.col("status") != "RESOLVED") & cause.isin("unknown_quote_kind", "insufficient_evidence", "style_only_basis") & (cause != F.col("now"))
    return frame(s, d, "items").join(now, "quote_id").select("item", F.when(over, "RESOLVED").otherwise(F.col("status")).alias("status"))


@query(with_sql("annotations", "items") + """, old AS (SELECT quote_id, item, status FROM items WHERE reason = 'STALE_DEPENDENCY' AND quote_id IS NOT NULL),
t AS (SELECT * FROM annotations WHERE start_cp >= 300 AND quote_id NOT IN (SELECT quote_id FROM annotations WHERE turn = 3))
SELECT t.quote_id, t.user_locked AS skipped, NOT t.user_locked AS stale, CASE WHEN NOT t.user_locked THEN CASE WHEN o.status = 'DEFERRED' THEN 'DEFERRED' ELSE 'PENDING' END END AS review,
  NOT t.user_locked AND o.item IS NULL AS new_item FROM t LEFT JOIN old o ON o.quote_id = t.quote_id""")
def d32_stale_propagation(s, d):
    """Annotations from a position on, but for excluded ones, go stale and get a review item; locked ones are told."""
    a = frame(s, d, "annotations")
    excluded = a.filter("turn = 3").select("quote_id")
    targets = a.filter("start_cp >= 300").join(excluded, "quote_id", "left_anti").select("quote_id", "user_locked")
    old = frame(s, d, "items").filter("reason = 'STALE_DEPENDENCY' AND quote_id IS NOT NULL").select("quote_id", "item", "status")
    free = ~F.col("user_locked")
    return targets.join(old, "quote_id", "left").select(
        "quote_id", F.col("user_locked").alias("skipped"), free.alias("stale"),
        F.when(free, F.when(F.col("status") == "DEFERRED", "DEFERRED").otherwise("PENDING")).alias("review"), (free & F.col("item").isNull()).alias("new_item"),
    )


@query(with_sql("items", "quotes", "gaps") + """SELECT i.item FROM items i WHERE i.quote_id IN (SELECT quote_id FROM quotes WHERE book % 2 = 0) OR i.gap_id IN (SELECT gap_id FROM gaps WHERE book % 2 = 0)""")
def j11_version_scope(s, d):
    items, even = frame(s, d, "items"), "book % 2 = 0"
    of_quotes = items.join(frame(s, d, "quotes").filter(even).select("quote_id"), "quote_id", "left_semi")
    of_gaps = items.join(frame(s, d, "gaps").filter(even).select("gap_id"), "gap_id", "left_semi")
    return of_quotes.select("item").unionByName(of_gaps.select("item")).distinct()


@query(with_sql("quotes", "annotations") + """, h AS (SELECT a.*, a.visible_from_cp > 900 AS withheld FROM annotations a WHERE start_cp < 2500 AND end_cp > 400)
SELECT q.book, count(h.quote_id) AS total, count(*) FILTER (h.status = 'ACCEPTED') AS accepted, count(*) FILTER (h.status = 'PROVISIONAL') AS provisional,
  count(*) FILTER (h.status = 'UNKNOWN') AS unknown, count(*) FILTER (h.stale) AS stale, count(*) FILTER (h.withheld) AS withheld, count(*) FILTER (h.quote_id IS NULL) AS unprocessed
FROM quotes q LEFT JOIN (SELECT * FROM h WHERE turn <> 5) h ON h.quote_id = q.quote_id WHERE q.start_cp < 2500 AND q.end_cp > 400 GROUP BY 1""")
def a9_projection_counts(s, d):
    near = "start_cp < 2500 AND end_cp > 400"
    a = frame(s, d, "annotations").filter(near).filter("turn <> 5").select("quote_id", "status", "stale", (F.col("visible_from_cp") > 900).alias("withheld"))
    both = frame(s, d, "quotes").filter(near).select("book", "quote_id", F.lit(1).alias("q")).join(a.withColumn("a", F.lit(1)), "quote_id", "left")
    of = lambda c, name: F.count_if(c).alias(name)
    st = F.col("status")
    return both.groupBy("book").agg(
        F.count("a").alias("total"), of(st == "ACCEPTED", "accepted"), of(st == "PROVISIONAL", "provisional"), of(st == "UNKNOWN", "unknown"),
        of(F.col("stale"), "stale"), of(F.col("withheld"), "withheld"), of(F.col("a").isNull(), "unprocessed"),
    )


@query(with_sql("annotations") + """SELECT book, speaker AS identity, count(*) AS quotes, min(start_cp) AS first_cp, min_by(description, start_cp) FILTER (description <> '' AND description <> speaker) AS description
FROM (SELECT *, CASE WHEN turn % 2 = 1 THEN 'says ' || kind ELSE '' END AS description FROM annotations WHERE status <> 'UNKNOWN' AND visible_from_cp <= 900) GROUP BY 1, 2""")
def a9_legend(s, d):
    a = frame(s, d, "annotations").filter("status <> 'UNKNOWN' AND visible_from_cp <= 900")
    description = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("says "), "kind")).otherwise("")
    a = a.withColumn("description", description)
    told = (F.col("description") != "") & (F.col("description") != F.col("speaker"))
    return a.groupBy("book", F.col("speaker").alias("identity")).agg(n("quotes"), F.min("start_cp").alias("first_cp"), F.min_by("description", F.when(told, F.col("start_cp"))).alias("description"))


@query(with_sql("annotations", "chapters") + """, q AS (SELECT a.book, CASE WHEN a.turn % 6 = 5 THEN 'speaker:' || a.speaker ELSE a.speaker END AS key, a.quote_id, c.ordinal FROM annotations a
  LEFT JOIN chapters c ON c.book = a.book AND a.start_cp >= c.start_cp AND a.start_cp < c.end_cp AND c.ordinal <> 1
  WHERE kind = 'speech' AND NOT stale AND status IN ('ACCEPTED', 'PROVISIONAL', 'USER_CONFIRMED')),
r AS (SELECT book, unnest(['user', 'narrator']) AS key, ordinal FROM chapters WHERE ordinal % 2 = 0),
t AS (SELECT book, key, count(DISTINCT quote_id) AS dialogues FROM q GROUP BY 1, 2),
c AS (SELECT book, key, count(DISTINCT ordinal) AS chapters FROM (SELECT book, key, ordinal FROM q WHERE ordinal IS NOT NULL UNION SELECT * FROM r) GROUP BY 1, 2)
SELECT coalesce(t.book, c.book) AS book, coalesce(t.key, c.key) AS key, coalesce(dialogues, 0) AS dialogues, coalesce(chapters, 0) AS chapters FROM t FULL JOIN c ON t.book = c.book AND t.key = c.key""")
def a2_appearance_statistics(s, d):
    """Dialogues and chapters of every identity: chapters come from dialogues and from confirmed rosters."""
    from narrata.operators import intervals

    a = frame(s, d, "annotations").filter((F.col("kind") == "speech") & ~F.col("stale") & F.col("status").isin(*ACTIVE))
    key = F.when(F.col("turn") % 6 == 5, F.concat(F.lit("speaker:"), "speaker")).otherwise(F.col("speaker"))
    a = a.select("book", key.alias("key"), "quote_id", F.col("start_cp").alias("at"))
    c = frame(s, d, "chapters").select("book", "ordinal", F.col("start_cp").alias("r_start"), F.col("end_cp").alias("r_end"))
    met = intervals.containing(a, c.filter("ordinal <> 1")).select("book", "key", "ordinal")
    roster = c.filter("ordinal % 2 = 0").select("book", F.explode(F.array(F.lit("user"), F.lit("narrator"))).alias("key"), "ordinal")
    chapters = met.unionByName(roster).groupBy("book", "key").agg(F.count_distinct("ordinal").alias("chapters"))
    dialogues = a.groupBy("book", "key").agg(F.count_distinct("quote_id").alias("dialogues"))
    return dialogues.join(chapters, ["book", "key"], "full").na.fill(0, ["dialogues", "chapters"])
