"""Windows, budgets, estimates and the job ledger, each with the SQL that says the same."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Window
from pyspark.sql import functions as F

from narrata.functions import digests
from narrata.operators import graph, text, windows
from narrata.plans.dialogue_queries import n, query
from narrata.sources.dialogue import table
from narrata.sources.model import frame, with_sql

WIDE = "[\\x{3400}-\\x{9FFF}\\x{3040}-\\x{30FF}\\x{3000}-\\x{303F}\\x{AC00}-\\x{D7AF}\\x{FF00}-\\x{FFEF}\\x{20000}-\\x{2FA1F}]"


def est(column: str) -> str:
    other = f"length(regexp_replace({column}, '{WIDE}', '', 'g'))"
    return f"CAST(length({column}) - {other} + floor(({other} + 3) / 4) AS BIGINT)"


TARGETS = with_sql("segments") + f""", t AS (SELECT book, turn, start_cp, {est('quoted')} AS tokens, coalesce(lag({est("substring(seg, length(quoted) + 1)")}) OVER (PARTITION BY book ORDER BY turn), 0) AS gap_before, row_number() OVER (PARTITION BY book ORDER BY turn) AS i FROM segments) """


def targets(s, d):
    seg = frame(s, d, "segments")
    after = text.estimated_tokens(F.substring("seg", F.length("quoted") + 1, F.lit(1 << 30)))
    w = Window.partitionBy("book").orderBy("turn")
    return seg.select("book", "turn", "start_cp", text.estimated_tokens(F.col("quoted")).alias("tokens"), F.coalesce(F.lag(after).over(w), F.lit(0).cast("long")).alias("gap_before"))


PACKED = TARGETS.replace("WITH ", "WITH RECURSIVE ", 1) + """, r AS (SELECT book, i, 0 AS win, tokens > 300 AS big, CASE WHEN tokens > 300 THEN 0 ELSE tokens END AS q, 0 AS g, CASE WHEN tokens > 300 THEN 0 ELSE 1 END AS held FROM t WHERE i = 1
  UNION ALL SELECT t.book, t.i, CASE WHEN fits THEN r.win ELSE r.win + 1 END, t.tokens > 300, CASE WHEN t.tokens > 300 THEN 0 WHEN fits THEN r.q + t.tokens ELSE t.tokens END, CASE WHEN fits THEN r.g + t.gap_before ELSE 0 END, CASE WHEN t.tokens > 300 THEN 0 WHEN fits THEN r.held + 1 ELSE 1 END
  FROM (SELECT r.*, r.held > 0 AND x.tokens <= 300 AND r.q + x.tokens + r.g + x.gap_before <= 300 AND r.held < 3 AS fits FROM r JOIN t x ON x.book = r.book AND x.i = r.i + 1) r JOIN t ON t.book = r.book AND t.i = r.i + 1) """


@query(PACKED + "SELECT t.book, t.turn, CAST(r.win AS BIGINT) AS win, r.big AS oversized FROM t JOIN r ON r.book = t.book AND r.i = t.i")
def d4_target_packing(s, d):
    return windows.packed(targets(s, d), 300, 3).select("book", "turn", F.col("window").alias("win"), "oversized")


@query(PACKED + """, w AS (SELECT t.book, r.win, min(t.start_cp) AS at, count(*) AS targets, CAST(sum(t.tokens) AS BIGINT) AS tokens, string_agg(CAST(t.turn AS STRING), ',' ORDER BY t.turn) AS turns FROM t JOIN r ON r.book = t.book AND r.i = t.i GROUP BY 1, 2)
SELECT book, CAST(win AS BIGINT) AS win, 'w' || substring(sha256(book || ':' || turns), 1, 16) AS window_id, targets, tokens, CASE WHEN win > 0 THEN 'w' || substring(sha256(book || ':' || lag(turns) OVER (PARTITION BY book ORDER BY win)), 1, 16) END AS carries FROM w""")
def d5_windows(s, d):
    """Windows with ids made of what they hold, each linked to the one before."""
    p = windows.packed(targets(s, d), 300, 3)
    turns = F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda x: x.cast("string")), ",")
    w = p.groupBy("book", "window").agg(n("targets"), F.sum("tokens").alias("tokens"), turns.alias("turns"))
    own = F.concat(F.lit("w"), F.substring(F.sha2(F.concat(F.col("book").cast("string"), F.lit(":"), "turns").cast("binary"), 256), 1, 16))
    w = w.withColumn("window_id", own)
    return w.select("book", F.col("window").alias("win"), "window_id", "targets", "tokens", F.lag("window_id").over(Window.partitionBy("book").orderBy("window")).alias("carries"))


@query(PACKED + f""", w AS (SELECT t.book, r.win, min(t.start_cp) AS at FROM t JOIN r ON r.book = t.book AND r.i = t.i GROUP BY 1, 2), p AS (SELECT book, start_cp AS ps, end_cp AS pe, {est('seg')} AS tokens FROM segments),
b AS (SELECT w.book, w.win, p.ps, sum(p.tokens) OVER (PARTITION BY w.book, w.win ORDER BY p.ps DESC) AS c, row_number() OVER (PARTITION BY w.book, w.win ORDER BY p.ps DESC) AS k FROM w JOIN p ON p.book = w.book AND p.pe <= w.at)
SELECT book, CAST(win AS BIGINT) AS win, min(ps) AS start_cp FROM b WHERE k = 1 OR c <= 200 GROUP BY 1, 2""")
def d3_overlap_ranges(s, d):
    w = windows.packed(targets(s, d), 300, 3).groupBy("book", "window").agg(F.min("start_cp").alias("at"))
    p = frame(s, d, "segments").select("book", F.col("start_cp").alias("p_start"), F.col("end_cp").alias("p_end"), text.estimated_tokens(F.col("seg")).alias("tokens"))
    return windows.overlap(w, p, 200).select("book", F.col("window").alias("win"), "start_cp")


_POLICIES = """('context-1', 2500, 200, 300, false, 0, false, false, 0), ('context-2', 2500, 200, 300, true, 3, false, false, 0), ('context-chapter-1', 32000, 200, 300, false, 0, true, false, 0), ('context-chapter-2', 32000, 200, 300, false, 0, true, true, 0), ('context-chapter-3', 32000, 200, 300, false, 0, true, true, 128), ('unheard-of', 2500, 200, 300, false, 0, false, false, 0)"""
_NAMED = with_sql("runs") + ", named AS (SELECT CASE win WHEN 0 THEN 'context-1' WHEN 1 THEN 'context-2' WHEN 2 THEN 'context-chapter-1' WHEN 3 THEN 'context-chapter-2' WHEN 4 THEN 'context-chapter-3' ELSE 'unheard-of' END AS name FROM runs) "


@query(_NAMED + f"SELECT t.*, (SELECT count(*) FROM named n WHERE n.name = t.name) AS runs FROM (VALUES {_POLICIES}) t(name, context_tokens, overlap_tokens, state_tokens, gap_compression, recheck_max_targets, full_source, dialogue_blocks, dialogue_target_limit)")
def d7_policies(s, d):
    """What each policy allows, and how many runs name it."""
    names = [*windows.POLICIES, "unheard-of"]
    rows = [(k, *asdict(windows.policy(k)).values()) for k in names]
    told = s.createDataFrame(rows, "name string, context_tokens int, overlap_tokens int, state_tokens int, gap_compression boolean, recheck_max_targets int, full_source boolean, dialogue_blocks boolean, dialogue_target_limit int")
    named = F.coalesce(F.get(F.array(*map(F.lit, names[:-1])), F.col("win").cast("int")), F.lit(names[-1]))
    return told.join(frame(s, d, "runs").groupBy(named.alias("name")).agg(n("runs")), "name", "left").na.fill(0, ["runs"])


@query(with_sql("segments") + f", c AS (SELECT book, turn, sum({est('seg')}) OVER (PARTITION BY book ORDER BY turn) AS total FROM segments) SELECT book, count(*) FILTER (total <= 900) AS kept, CAST(coalesce(max(total) FILTER (total <= 900), 0) AS BIGINT) AS used, count(*) FILTER (total > 900) AS left_out FROM c GROUP BY 1")
def d7_budget_ledger(s, d):
    total = F.sum(text.estimated_tokens(F.col("seg"))).over(Window.partitionBy("book").orderBy("turn"))
    c = frame(s, d, "segments").select("book", total.alias("total"))
    fits = F.col("total") <= 900
    return c.groupBy("book").agg(F.count_if(fits).alias("kept"), F.coalesce(F.max(F.when(fits, F.col("total"))), F.lit(0)).alias("used"), F.count_if(~fits).alias("left_out"))


@query(with_sql("segments") + """, q AS (SELECT *, start_cp + length(quoted) AS qe FROM segments WHERE turn % 5 <> 2), g AS (SELECT *, CASE WHEN start_cp - max(qe) OVER (PARTITION BY book ORDER BY start_cp, qe ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 200 THEN 1 ELSE 0 END AS new FROM q)
SELECT book, turn, 'b0-scene-' || CAST(sum(new) OVER (PARTITION BY book ORDER BY start_cp, qe) AS BIGINT) AS scene FROM g""")
def t16_baseline_scenes(s, d):
    """A scene of the rule baseline ends where more than 200 code points pass without a quote."""
    q = frame(s, d, "segments").filter("turn % 5 <> 2").withColumn("qe", F.col("start_cp") + F.length("quoted"))
    w = Window.partitionBy("book").orderBy("start_cp", "qe")
    furthest = F.max("qe").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start_cp") - furthest > 200, 1).otherwise(0)
    return q.withColumn("new", new).select("book", "turn", F.concat(F.lit("b0-scene-"), F.sum("new").over(w).cast("string")).alias("scene"))


@query("SELECT doc_id, 'L' || k AS ref, sha256(l) AS digest FROM (SELECT doc_id, unnest(p) AS l, generate_subscripts(p, 1) AS k, len(p) AS many FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') AS p FROM documents)) WHERE NOT (k = many AND l = '')")
def t17_original_lines(s, d):
    """Each line's number and digest; a break at a text's end begins no line."""
    brk = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
    # Nothing of the whole text is asked for beside its lines: it would be worked out again for each of them.
    lines = F.split(F.regexp_replace("text", rf"(?:{brk})\z", ""), brk, -1)
    t = table(s, d, "documents").filter("text <> ''").select("doc_id", F.posexplode(lines).alias("k", "l"))
    return t.select("doc_id", F.concat(F.lit("L"), (F.col("k") + 1).cast("string")).alias("ref"), F.sha2(F.col("l").cast("binary"), 256).alias("digest"))


@query(with_sql("runs") + """, u AS (SELECT job, run, created_at, CASE WHEN json_valid(usage) THEN CAST(json_extract_string(usage, '$.total_tokens') AS BIGINT) END AS t FROM runs),
c AS (SELECT *, count(*) OVER w AS calls, coalesce(sum(t) OVER w, 0) AS spent, coalesce(sum(CASE WHEN t IS NULL THEN 1 ELSE 0 END) OVER w, 0) AS unknown FROM u WINDOW w AS (PARTITION BY job ORDER BY created_at, run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT run, CASE WHEN unknown > 2 THEN 'unknown_usage' WHEN calls >= 12 THEN 'calls' WHEN spent >= 600 THEN 'tokens' ELSE 'allowed' END AS verdict FROM c""")
def d52_call_budget(s, d):
    """Whether each call was within what its job had left before it: calls, tokens, and unknown usage."""
    w = Window.partitionBy("job").orderBy("created_at", "run").rowsBetween(Window.unboundedPreceding, -1)
    t = F.get_json_object("usage", "$.total_tokens").cast("long")
    c = frame(s, d, "runs").withColumn("t", t).withColumns({"calls": F.count(F.lit(1)).over(w), "spent": F.coalesce(F.sum("t").over(w), F.lit(0)), "unknown": F.count_if(F.col("t").isNull()).over(w)})
    verdict = F.when(F.col("unknown") > 2, "unknown_usage").when(F.col("calls") >= 12, "calls").when(F.col("spent") >= 600, "tokens").otherwise("allowed")
    return c.select("run", verdict.alias("verdict"))


@query(TARGETS + """, e AS (SELECT book, count(*) AS targets, sum(tokens + gap_before) AS ins FROM t GROUP BY 1), m AS (SELECT *, unnest([0, 1, 2]) AS rounds, unnest([false, true, true]) AS review, unnest([0, 0, 1]) AS feedback FROM e)
SELECT book, CAST(rounds AS INT) AS rounds, targets, CAST(ins * (1 + CASE WHEN review THEN 3 ELSE 1 END * rounds + feedback) AS BIGINT) AS input_tokens, CAST(targets * 20 * (1 + CASE WHEN review THEN 3 ELSE 1 END * rounds + feedback) AS BIGINT) AS output_tokens FROM m""")
def d53_estimate(s, d):
    """Input and output tokens of a range for three ways to review it."""
    e = targets(s, d).groupBy("book").agg(n("targets"), F.sum(F.col("tokens") + F.col("gap_before")).alias("ins"))
    ways = F.array(*(F.struct(F.lit(r).alias("rounds"), F.lit(1 + (3 if review else 1) * r + f).alias("times")) for r, review, f in ((0, False, 0), (1, True, 0), (2, True, 1))))
    e = e.withColumn("w", F.explode(ways))
    return e.select("book", "w.rounds", "targets", (F.col("ins") * F.col("w.times")).alias("input_tokens"), (F.col("targets") * 20 * F.col("w.times")).alias("output_tokens"))


@query(with_sql("runs") + """, w AS (SELECT job, win, max_by(state, (created_at, run)) AS last, row_number() OVER (PARTITION BY job ORDER BY win) AS i FROM runs GROUP BY 1, 2), f AS (SELECT *, min(CASE WHEN last = 'FAILED' THEN i END) OVER (PARTITION BY job) AS first FROM w)
SELECT job, win, CASE WHEN last = 'SUCCEEDED' AND (first IS NULL OR i < first) THEN 'completed' WHEN last = 'FAILED' THEN 'failed' WHEN i > first THEN 'blocked' ELSE 'open' END AS state, i - 1 AS level FROM f""")
def d51_dependent_windows(s, d):
    """Windows that carry one another's state: after one that failed, the rest is blocked."""
    last = frame(s, d, "runs").groupBy("job", "win").agg(F.max_by("state", F.struct("created_at", "run")).alias("last"))
    i = F.row_number().over(Window.partitionBy("job").orderBy("win"))
    w = last.withColumn("i", i).withColumn("first", F.min(F.when(F.col("last") == "FAILED", F.col("i"))).over(Window.partitionBy("job")))
    clear = F.col("first").isNull() | (F.col("i") < F.col("first"))
    state = F.when((F.col("last") == "SUCCEEDED") & clear, "completed").when(F.col("last") == "FAILED", "failed").when(F.col("i") > F.col("first"), "blocked").otherwise("open")
    return w.select("job", "win", state.alias("state"), (F.col("i") - 1).cast("long").alias("level"))


@query(with_sql("runs") + """, l AS (SELECT *, row_number() OVER (PARTITION BY job, win ORDER BY created_at DESC, run DESC) = 1 AS latest, run % 4 = 3 AS returned FROM runs),
o AS (SELECT job, run, CASE WHEN returned AND state = 'DISPATCHED' THEN 'FAILED' WHEN NOT returned AND (state = 'DISPATCHED' OR (latest AND state IN ('SUCCEEDED', 'UNKNOWN_OUTCOME') AND win % 3 = 0)) THEN 'UNKNOWN_OUTCOME' ELSE state END AS settled FROM l)
SELECT job, count(*) FILTER (settled = 'UNKNOWN_OUTCOME') AS unknown, count(*) FILTER (settled = 'FAILED') AS failed, CASE WHEN count(*) FILTER (settled = 'UNKNOWN_OUTCOME') > 0 THEN 'NEEDS_RECONCILIATION' WHEN job % 5 = 0 THEN 'PAUSED' WHEN count(*) FILTER (settled = 'SUCCEEDED') > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS state FROM o GROUP BY 1""")
def x31_settlement(s, d):
    """Runs that an interruption left open, settled by whether their answer came back; and what that makes of the job."""
    r = frame(s, d, "runs").withColumn("k", F.row_number().over(Window.partitionBy("job", "win").orderBy(F.desc("created_at"), F.desc("run"))))
    returned, sent = F.col("run") % 4 == 3, F.col("state") == "DISPATCHED"
    lost = sent | ((F.col("k") == 1) & F.col("state").isin("SUCCEEDED", "UNKNOWN_OUTCOME") & (F.col("win") % 3 == 0))
    r = r.withColumn("settled", F.when(returned & sent, "FAILED").when(~returned & lost, "UNKNOWN_OUTCOME").otherwise(F.col("state")))
    of = lambda x: F.count_if(F.col("settled") == x)
    state = F.when(F.col("unknown") > 0, "NEEDS_RECONCILIATION").when(F.col("job") % 5 == 0, "PAUSED").when(F.col("done") > 0, "PARTIAL").otherwise("FAILED")
    return r.groupBy("job").agg(of("UNKNOWN_OUTCOME").alias("unknown"), of("FAILED").alias("failed"), of("SUCCEEDED").alias("done")).select("job", "unknown", "failed", state.alias("state"))


#: What can be done about a job in each state, in order, and whether it may cost (fixed values).
ACTIONS = {
    "COMPLETED": [], "QUEUED": [("pause", False), ("run", True)], "RUNNING": [("pause", False)], "PAUSING": [("wait", False)], "PAUSED": [("resume", True)], "PARTIAL": [("resume", True)],
    "BUDGET_EXHAUSTED": [("new_job", True)], "NEEDS_RECONCILIATION": [("reconcile_keep", False), ("reconcile_retry", True)], "FAILED": [("run", True)],
}


@query(with_sql("runs") + """, j AS (SELECT job, CASE job % 9 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'QUEUED' WHEN 2 THEN 'RUNNING' WHEN 3 THEN 'PAUSING' WHEN 4 THEN 'PAUSED' WHEN 5 THEN 'PARTIAL' WHEN 6 THEN 'BUDGET_EXHAUSTED' WHEN 7 THEN 'NEEDS_RECONCILIATION' ELSE 'FAILED' END AS state, count(*) FILTER (state <> 'SUCCEEDED') AS remaining FROM runs GROUP BY job),
a AS (SELECT * FROM (VALUES ('QUEUED', 0, 'pause', false), ('QUEUED', 1, 'run', true), ('RUNNING', 0, 'pause', false), ('PAUSING', 0, 'wait', false), ('PAUSED', 0, 'resume', true), ('PARTIAL', 0, 'resume', true), ('BUDGET_EXHAUSTED', 0, 'new_job', true), ('NEEDS_RECONCILIATION', 0, 'reconcile_keep', false), ('NEEDS_RECONCILIATION', 1, 'reconcile_retry', true), ('FAILED', 0, 'run', true)) t(state, position, action, paid))
SELECT j.job, a.position, a.action, a.paid AND (a.action <> 'resume' OR j.remaining > 0) AS paid FROM j JOIN a ON a.state = j.state""")
def x32_recovery_actions(s, d):
    states = F.array(*map(F.lit, ACTIONS))
    j = frame(s, d, "runs").groupBy("job").agg(F.count_if(F.col("state") != "SUCCEEDED").alias("remaining")).withColumn("state", F.element_at(states, (F.col("job") % 9 + 1).cast("int")))
    a = s.createDataFrame([(st, k, name, paid) for st, xs in ACTIONS.items() for k, (name, paid) in enumerate(xs)], "state string, position int, action string, paid boolean")
    return j.join(F.broadcast(a), "state").select("job", "position", "action", (F.col("paid") & ((F.col("action") != "resume") | (F.col("remaining") > 0))).alias("paid"))


STRATEGIES = ["legacy", "complete", "complete-review", "complete-blocks", "complete-blocks-review", "complete-blocks-isolated", "complete-blocks-isolated-review", "complete-blocks-isolated-feedback-review"]


_STRATEGIES = """('legacy', NULL, NULL, NULL, NULL, NULL), ('complete', 'context-chapter-1', 'expression-production-1', NULL, NULL, NULL), ('complete-review', 'context-chapter-1', 'expression-production-1', NULL, 'expression-evidence-review-1', NULL), ('complete-blocks', 'context-chapter-3', 'expression-production-1', NULL, NULL, NULL), ('complete-blocks-review', 'context-chapter-3', 'expression-production-1', NULL, 'expression-evidence-review-1', NULL), ('complete-blocks-isolated', 'context-chapter-3', 'expression-production-1', 'expression-auxiliary-isolation-1', NULL, NULL), ('complete-blocks-isolated-review', 'context-chapter-3', 'expression-production-1', 'expression-auxiliary-isolation-1', 'expression-evidence-review-1', NULL), ('complete-blocks-isolated-feedback-review', 'context-chapter-3', 'expression-production-1', 'expression-auxiliary-isolation-1', 'expression-evidence-review-1', 'identity-feedback-1')"""


@query(with_sql("runs") + f"SELECT t.*, count(r.run) AS runs FROM (VALUES {_STRATEGIES}) t(strategy, context_policy, output_protocol, auxiliary_protocol, review_protocol, feedback_protocol) LEFT JOIN runs r ON t.strategy = CASE WHEN r.state = 'FAILED' THEN 'legacy' WHEN r.state = 'DISPATCHED' THEN 'complete-review' WHEN r.win = 3 THEN 'complete-blocks-isolated' ELSE 'complete' END GROUP BY ALL")
def x34_strategies(s, d):
    """What a named strategy stands for, and how many runs took it."""
    t, c = s.createDataFrame([(x,) for x in STRATEGIES], "strategy string"), F.col("strategy")
    took = F.when(F.col("state") == "FAILED", "legacy").when(F.col("state") == "DISPATCHED", "complete-review").when(F.col("win") == 3, "complete-blocks-isolated").otherwise("complete")
    t = t.join(frame(s, d, "runs").groupBy(took.alias("strategy")).agg(n("runs")), "strategy", "left").na.fill(0, ["runs"])
    new = c != "legacy"
    return t.select(
        "strategy", F.when(new, F.when(c.startswith("complete-blocks"), "context-chapter-3").otherwise("context-chapter-1")).alias("context_policy"),
        F.when(new, "expression-production-1").alias("output_protocol"), F.when(c.contains("-isolated"), "expression-auxiliary-isolation-1").alias("auxiliary_protocol"),
        F.when(c.endswith("-review"), "expression-evidence-review-1").alias("review_protocol"), F.when(c.contains("-feedback"), "identity-feedback-1").alias("feedback_protocol"), "runs",
    )


@query(with_sql("outputs") + """SELECT quote_id, CASE WHEN basis = 'DIRECT' AND e_prev IS NULL THEN 0 WHEN k % 6 = 1 THEN 2 ELSE 1 END AS priority, row_number() OVER (PARTITION BY book ORDER BY start_cp) AS position FROM outputs WHERE k % 13 <> 0 AND (assignment = 'UNKNOWN' OR basis IN ('STYLE_ONLY', 'INSUFFICIENT', 'DIRECT'))""")
def x18_unresolved_targets(s, d):
    """Unlocked quotes without a sure speaker, in order, with how soon they should be looked at again."""
    u = frame(s, d, "outputs").filter("k % 13 <> 0 AND (assignment = 'UNKNOWN' OR basis IN ('STYLE_ONLY', 'INSUFFICIENT', 'DIRECT'))")
    priority = F.when((F.col("basis") == "DIRECT") & F.col("e_prev").isNull(), 0).when(F.col("k") % 6 == 1, 2).otherwise(1)
    return u.select("quote_id", priority.alias("priority"), F.row_number().over(Window.partitionBy("book").orderBy("start_cp")).alias("position"))


@query(with_sql("runs", "outputs") + """, j AS (SELECT job, min(run) AS a, min(run) + 300 AS b FROM runs WHERE state IN ('DISPATCHED', 'UNKNOWN_OUTCOME') GROUP BY 1), t AS (SELECT job, run AS target FROM runs WHERE state IN ('DISPATCHED', 'UNKNOWN_OUTCOME'))
SELECT x.job, y.job AS other FROM j x JOIN j y ON x.job < y.job AND x.a < y.b AND y.a < x.b AND x.job % 4 = y.job % 4 WHERE EXISTS (SELECT 1 FROM t p JOIN t q ON p.target % 50 = q.target % 50 WHERE p.job = x.job AND q.job = y.job)""")
def j15_occupied_targets(s, d):
    """Jobs of a version whose ranges meet and that share a target."""
    r = frame(s, d, "runs").filter(F.col("state").isin("DISPATCHED", "UNKNOWN_OUTCOME"))
    t = r.select("job", (F.col("job") % 4).alias("version"), (F.col("run") % 50).alias("target"), F.min("run").over(Window.partitionBy("job")).alias("a")).distinct()
    other = t.select(F.col("job").alias("other"), "version", "target", F.col("a").alias("a2"))
    met = t.join(other, ["version", "target"]).filter((F.col("job") < F.col("other")) & (F.col("a") < F.col("a2") + 300) & (F.col("a2") < F.col("a") + 300))
    return met.select("job", "other").distinct()


@query(with_sql("runs") + """, r AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY created_at, run) AS k FROM runs WHERE state = 'SUCCEEDED') SELECT sha256(win || ':m1') AS cache_key, run FROM r WHERE k = 1""")
def k4_result_cache(s, d):
    """The first result of each key stays, whatever comes later."""
    r = frame(s, d, "runs").filter("state = 'SUCCEEDED'")
    key = F.sha2(F.concat(F.col("win").cast("string"), F.lit(":m1")).cast("binary"), 256)
    return r.groupBy(key.alias("cache_key")).agg(F.min_by("run", F.struct("created_at", "run")).alias("run"))


@query(with_sql("runs") + """SELECT run, sha256('{"acceptance_policy_version": "acceptance-1", "book_version_id": "' || book || '", "model": "m1", "params": {}, "prompt_version": "p' || (win % 3) || '", "reading_mode": "initial", "target_ids": ["' || run || '", "' || win || '"], "visible_horizon_cp": ' || CASE WHEN run % 2 = 0 THEN 'null' ELSE CAST(run AS STRING) END || '}') AS key FROM runs""")
def d56_cache_keys(s, d):
    """Digests of what a result depends on, as JSON with sorted keys."""
    as_text = lambda c: F.col(c).cast("string")
    blob = F.concat(
        F.lit('{"acceptance_policy_version": "acceptance-1", "book_version_id": "'), as_text("book"), F.lit('", "model": "m1", "params": {}, "prompt_version": "p'), (F.col("win") % 3).cast("string"),
        F.lit('", "reading_mode": "initial", "target_ids": ["'), as_text("run"), F.lit('", "'), as_text("win"), F.lit('"], "visible_horizon_cp": '), F.when(F.col("run") % 2 == 0, "null").otherwise(as_text("run")), F.lit("}"),
    )
    return frame(s, d, "runs").select("run", F.sha2(blob.cast("binary"), 256).alias("key"))


@query(with_sql("facts") + """, h AS (SELECT book, person, sha256(string_agg(visible_from_cp || '=' || value, ';' ORDER BY idx)) AS digest FROM facts GROUP BY 1, 2) SELECT book, digest, min(person) AS baseline, count(*) AS uses FROM h GROUP BY 1, 2""")
def d55_shared_histories(s, d):
    """Histories that are alike within a version are stored once."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("idx", F.concat(F.col("visible_from_cp").cast("string"), F.lit("="), "value").alias("x")))), lambda r: r["x"])
    h = frame(s, d, "facts").groupBy("book", "person").agg(F.sha2(F.array_join(rows, ";").cast("binary"), 256).alias("digest"))
    return h.groupBy("book", "digest").agg(F.min("person").alias("baseline"), n("uses"))


@query("SELECT count(*) AS n, CAST(sum(CAST('0x' || substring(sha256(o_orderkey || '|' || coalesce(CAST(o_custkey AS STRING), '')), 1, 12) AS BIGINT)) AS BIGINT) AS digest FROM orders")
def d54_table_digest(s, d):
    """A digest of a table's rows that doesn't depend on their order."""
    row = F.concat(F.col("o_orderkey").cast("string"), F.lit("|"), F.coalesce(F.col("o_custkey").cast("string"), F.lit("")))
    return table(s, d, "orders").agg(n(), digests.summed(row).alias("digest"))


@query(with_sql("runs") + """SELECT job, count(*) FILTER (state IN ('SUCCEEDED', 'FAILED') AND usage IS NOT NULL) AS archived, bool_and(state <> 'DISPATCHED') AS eligible, CAST(sum(CASE WHEN state IN ('SUCCEEDED', 'FAILED') AND usage IS NOT NULL THEN length(usage) ELSE 0 END) AS BIGINT) AS bytes FROM runs GROUP BY 1""")
def d54_retention_plan(s, d):
    done = F.col("state").isin("SUCCEEDED", "FAILED") & F.col("usage").isNotNull()
    return frame(s, d, "runs").groupBy("job").agg(F.count_if(done).alias("archived"), F.min(F.col("state") != "DISPATCHED").alias("eligible"), F.sum(F.when(done, F.length("usage")).otherwise(0)).alias("bytes"))


@query(with_sql("runs") + "SELECT book, CAST(sum(calls) AS BIGINT) AS calls, count(*) FILTER (u > 0) AS unknown_jobs, CAST(coalesce(sum(t), 0) AS BIGINT) AS tokens FROM (SELECT book, job, count(*) AS calls, count(*) FILTER (usage IS NULL) AS u, sum(CASE WHEN json_valid(usage) THEN CAST(json_extract_string(usage, '$.total_tokens') AS BIGINT) END) AS t FROM runs GROUP BY 1, 2) GROUP BY 1")
def a15_report_totals(s, d):
    t = F.get_json_object("usage", "$.total_tokens").cast("long")
    j = frame(s, d, "runs").groupBy("book", "job").agg(n("calls"), F.count_if(F.col("usage").isNull()).alias("u"), F.sum(t).alias("t"))
    return j.groupBy("book").agg(F.sum("calls").alias("calls"), F.count_if(F.col("u") > 0).alias("unknown_jobs"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"))


@query(with_sql("runs") + "SELECT DISTINCT j.job, CAST(coalesce(k.k, j.job) AS BIGINT) AS receipt FROM runs j LEFT JOIN (SELECT user_id AS job, min(event_id) AS k FROM events WHERE event_type = 'purchase' GROUP BY 1) k ON k.job = j.job")
def u1_request_receipts(s, d):
    k = table(s, d, "events").filter("event_type = 'purchase'").groupBy(F.col("user_id").alias("job")).agg(F.min("event_id").alias("k"))
    return frame(s, d, "runs").select("job").distinct().join(k, "job", "left").select("job", F.coalesce("k", "job").alias("receipt"))


EVIDENCE = with_sql("segments").replace("WITH ", "WITH RECURSIVE ", 1) + f""", e AS (SELECT book AS win, turn AS item, CASE turn % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 - turn % 2 END AS rank, start_cp, end_cp, {est('seg')} AS cost, turn % 4 < 2 AS required FROM segments), o AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY rank, start_cp) AS i FROM e),
j AS (SELECT *, CASE WHEN required THEN CASE WHEN cost > 250 THEN 'oversized_quote' ELSE 'required' END WHEN end_cp > 2500 THEN 'beyond_visible_horizon' END AS fixed FROM o),
r AS (SELECT win, i, CASE WHEN fixed IS NOT NULL THEN fixed WHEN cost <= 250 THEN 'optional' ELSE 'budget_exhausted' END AS outcome, CASE WHEN fixed = 'required' OR (fixed IS NULL AND cost <= 250) THEN cost ELSE 0 END AS used FROM j WHERE i = 1
UNION ALL SELECT j.win, j.i, CASE WHEN fixed IS NOT NULL THEN fixed WHEN r.used + cost <= 250 THEN 'optional' ELSE 'budget_exhausted' END, r.used + CASE WHEN fixed = 'required' OR (fixed IS NULL AND r.used + cost <= 250) THEN cost ELSE 0 END FROM r JOIN j ON j.win = r.win AND j.i = r.i + 1) """


@query(EVIDENCE + "SELECT o.win, o.item, r.outcome FROM o JOIN r ON r.win = o.win AND r.i = o.i")
def d2_evidence_selection(s, d):
    """What a window shows a model: targets and inner gaps, then what else fits and may be seen yet."""
    t = F.col("turn") % 4
    e = frame(s, d, "segments").select(F.col("book").alias("window"), F.col("turn").alias("item"), F.when(t == 0, 0).when(t == 1, 1).otherwise(3 - F.col("turn") % 2).cast("long").alias("rank"), "start_cp", "end_cp", text.estimated_tokens(F.col("seg")).alias("cost"), (t < 2).alias("required"))
    return windows.evidence(e, 250, 2500).withColumnRenamed("window", "win")


UNITS = with_sql("headed").replace("WITH ", "WITH RECURSIVE ", 1) + f""", p AS (SELECT book, line, {est('body')} AS tokens, line % 4 >= 2 AS q, line % 12 = 0 AS ex FROM headed WHERE body <> '' OR sep <> ''), n AS (SELECT *, coalesce(lag(tokens) OVER w, 0) AS bf, CASE WHEN q AND coalesce(lag(q) OVER w, false) AND NOT ex THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (PARTITION BY book ORDER BY line)),
g AS (SELECT *, sum(new) OVER (PARTITION BY book ORDER BY line) AS blk FROM n), b AS (SELECT book, blk, min(line) AS first, max(line) AS last, sum(tokens) AS tokens, sum(CASE WHEN q THEN 1 ELSE 0 END) AS quotes, min_by(bf, line) AS bf, min_by(ex, line) AS ex, row_number() OVER (PARTITION BY book ORDER BY min(line)) AS i FROM g GROUP BY 1, 2),
r AS (SELECT book, i, 0 AS unit, tokens AS used, quotes AS qs, bf FROM b WHERE i = 1 UNION ALL SELECT book, i, CASE WHEN fits THEN unit ELSE unit + 1 END, CASE WHEN fits THEN used + tokens ELSE tokens END, CASE WHEN fits THEN qs + quotes ELSE quotes END, CASE WHEN fits THEN rbf ELSE nbf END
  FROM (SELECT b.book, b.i, r.unit, r.used, r.qs, r.bf AS rbf, b.bf AS nbf, b.tokens, b.quotes, NOT b.ex AND r.used + b.tokens + r.bf <= 220 AND r.qs + b.quotes <= 6 AS fits FROM r JOIN b ON b.book = r.book AND b.i = r.i + 1) x) """


@query(UNITS + "SELECT r.book, CAST(r.unit AS BIGINT) AS unit, min(b.first) AS first, max(b.last) AS last, CAST(sum(b.tokens) AS BIGINT) AS tokens, CAST(min_by(b.bf, b.i) AS BIGINT) AS before, sum(b.tokens) + min_by(b.bf, b.i) <= 220 AS fits FROM r JOIN b ON b.book = r.book AND b.i = r.i GROUP BY 1, 2")
def t19_dialogue_units(s, d):
    """Blocks of dialogue that a request takes whole, with the paragraph before each."""
    line = F.col("line")
    p = frame(s, d, "headed").filter("body <> '' OR sep <> ''").select("book", "line", text.estimated_tokens(F.col("body")).alias("tokens"), (line % 4 >= 2).alias("has_quote"), (line % 12 == 0).alias("explicit"))
    return windows.dialogue_units(p, 220, 6)
