"""Predictions against gold, and the decisions and audits around them, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from narrata.operators import decisions, evaluation, text
from narrata.plans.dialogue_queries import n, query
from narrata.sources.dialogue import table
from narrata.sources.model import frame, with_sql

#: Greedy one-to-one by rounds: in each, edges that come first for both of their ends are taken.
def _rounds(edges: str, group: str, left: str, right: str, order: str, count: int) -> str:
    out, had = [], []
    for k in range(count):
        free = " AND ".join(f"NOT EXISTS (SELECT 1 FROM {h} t WHERE {' AND '.join(f't.{g} = e.{g}' for g in group.split(', '))} AND (t.{left} = e.{left} OR t.{right} = e.{right}))" for h in had) or "true"
        key = f"{edges}_{k}"
        out.append(f"{key} AS (SELECT * EXCLUDE (ra, rb) FROM (SELECT *, row_number() OVER (PARTITION BY {group}, {left} ORDER BY {order}) AS ra, row_number() OVER (PARTITION BY {group}, {right} ORDER BY {order}) AS rb FROM {edges} e WHERE {free}) WHERE ra = 1 AND rb = 1)")
        had.append(key)
    return ", ".join(out) + f", {edges}_won AS (" + " UNION ALL ".join(f"SELECT * FROM {h}" for h in had) + ")"


PAIRS = with_sql("gold", "pred") + """, cand AS (SELECT * FROM (SELECT g.book, g.key AS gold, p.key AS pred, g.start_cp AS gs, p.start_cp AS ps,
  greatest(least(g.end_cp, p.end_cp) - greatest(g.start_cp, p.start_cp), 0) / (greatest(g.end_cp, p.end_cp) - least(g.start_cp, p.start_cp)) AS score
  FROM gold g JOIN pred p ON p.book = g.book AND p.start_cp < g.end_cp AND g.start_cp < p.end_cp) WHERE score >= 0.5),
""" + _rounds("cand", "book", "gold", "pred", "-score, gs, ps, gold, pred", 3) + """,
pr AS (SELECT g.book, g.key AS gold, g.start_cp AS start, g.end_cp AS "end", g.scene AS g_scene, g.grp AS g_grp, g.resolvable, w.pred, p.scene AS p_scene, p.grp AS p_grp,
  coalesce(p.flag, p.grp IS NOT NULL AND upper(p.status) IN ('', 'ACCEPTED', 'USER_CONFIRMED')) AS acc0
  FROM gold g LEFT JOIN cand_won w ON w.book = g.book AND w.gold = g.key LEFT JOIN pred p ON p.book = g.book AND p.key = w.pred),
pairs AS (SELECT *, CASE WHEN pred IS NOT NULL THEN acc0 END AS accepted FROM pr),
ok AS (SELECT *, coalesce(g_scene, '-') AS scene FROM pairs WHERE pred IS NOT NULL AND resolvable AND g_grp IS NOT NULL AND accepted) """  # fmt: skip


def pairs(s, d):
    return evaluation.paired(frame(s, d, "gold"), frame(s, d, "pred"))


@query(PAIRS + "SELECT book, gold, pred, round(score, 9) AS score FROM cand_won")
def j13_matched(s, d):
    return evaluation.matched(frame(s, d, "gold"), frame(s, d, "pred")).withColumn("score", F.round("score", 9))


@query(with_sql("pred") + "SELECT book, key, start_cp, end_cp, coalesce(flag, grp IS NOT NULL AND upper(status) IN ('', 'ACCEPTED', 'USER_CONFIRMED')) AS accepted, row_number() OVER (PARTITION BY book ORDER BY start_cp, end_cp, key) AS position FROM pred")
def x35_prediction_rows(s, d):
    w = Window.partitionBy("book").orderBy("start_cp", "end_cp", "key")
    return evaluation.with_acceptance(frame(s, d, "pred")).select("book", "key", "start_cp", "end_cp", "accepted", F.row_number().over(w).alias("position"))


@query(PAIRS + """, e AS (SELECT g.book, g.gold, g.matched, coalesce(p.predicted, 0) AS predicted FROM (SELECT book, count(*) AS gold, count(pred) AS matched FROM pairs GROUP BY 1) g LEFT JOIN (SELECT book, count(*) AS predicted FROM pred GROUP BY 1) p ON p.book = g.book)
SELECT *, round(matched / predicted, 9) AS precision, round(matched / gold, 9) AS recall, round(CASE WHEN matched > 0 THEN 2 * (matched / predicted) * (matched / gold) / (matched / predicted + matched / gold) END, 9) AS f1 FROM e""")
def d41_extraction(s, d):
    out = evaluation.extraction(pairs(s, d), frame(s, d, "pred"))
    return out.select("book", "gold", "matched", "predicted", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query(PAIRS + """, nx AS (SELECT *, lead(pred) OVER w AS np, lead(g_scene) OVER w AS ng, lead(p_scene) OVER w AS ns FROM pairs WINDOW w AS (PARTITION BY book ORDER BY start, "end", gold)),
c AS (SELECT book, count(*) AS compared, count(*) FILTER (g_scene IS NOT DISTINCT FROM ng AND p_scene IS DISTINCT FROM ns) AS wrong_split, count(*) FILTER (g_scene IS DISTINCT FROM ng AND p_scene IS NOT DISTINCT FROM ns) AS wrong_join FROM nx WHERE pred IS NOT NULL AND np IS NOT NULL GROUP BY 1)
SELECT *, round((compared - wrong_split - wrong_join) / compared, 9) AS accuracy FROM c""")
def d41_scene_boundaries(s, d):
    return evaluation.scene_boundaries(pairs(s, d)).withColumn("accuracy", F.round("accuracy", 9))


VOTES = PAIRS + ", votes AS (SELECT book, scene, g_grp, p_grp, count(*) AS c FROM ok WHERE p_grp IS NOT NULL GROUP BY 1, 2, 3, 4), " + _rounds("votes", "book, scene", "g_grp", "p_grp", "-c, g_grp, p_grp", 3)


@query(VOTES + " SELECT book, scene, g_grp, p_grp FROM votes_won")
def d41_group_mapping(s, d):
    return evaluation.group_mapping(pairs(s, d))


@query(VOTES + """, a AS (SELECT o.book, count(*) AS accepted, count(*) FILTER (v.p_grp IS NOT DISTINCT FROM o.p_grp) AS correct FROM ok o LEFT JOIN votes_won v ON v.book = o.book AND v.scene = o.scene AND v.g_grp = o.g_grp GROUP BY 1),
b AS (SELECT *, correct / accepted AS p, 1 + 3.8416 / accepted AS z FROM a),
c AS (SELECT *, (p + 3.8416 / (2 * accepted)) / z AS mid, 1.96 * sqrt(p * (1 - p) / accepted + 3.8416 / (4 * accepted * accepted)) / z AS half FROM b)
SELECT book, accepted, correct, round(p, 9) AS accuracy, round(greatest(0, mid - half), 9) AS low, round(least(1, mid + half), 9) AS high FROM c""")
def d41_accepted_accuracy(s, d):
    out = evaluation.accepted_accuracy(pairs(s, d))
    return out.select("book", "accepted", "correct", *(F.round(c, 9).alias(c) for c in ("accuracy", "low", "high")))


@query(PAIRS + """, t AS (SELECT a.book, count(*) FILTER (a.g_grp = b.g_grp AND a.p_grp IS NOT DISTINCT FROM b.p_grp) AS tp, count(*) FILTER (a.g_grp <> b.g_grp AND a.p_grp IS NOT DISTINCT FROM b.p_grp) AS fp,
  count(*) FILTER (a.g_grp = b.g_grp AND a.p_grp IS DISTINCT FROM b.p_grp) AS fn FROM ok a JOIN ok b ON b.book = a.book AND b.g_scene IS NOT DISTINCT FROM a.g_scene AND a.gold < b.gold GROUP BY 1)
SELECT o.book, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, round(CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END, 9) AS f1 FROM (SELECT DISTINCT book FROM ok) o LEFT JOIN t ON t.book = o.book""")
def d41_pairwise(s, d):
    return evaluation.pairwise(pairs(s, d)).withColumn("f1", F.round("f1", 9))


@query(PAIRS + """, sc AS (SELECT book, g_scene, count(DISTINCT CASE WHEN resolvable THEN g_grp END) AS g, count(DISTINCT CASE WHEN resolvable AND g_grp IS NOT NULL AND accepted THEN p_grp END) AS p FROM pairs WHERE g_scene IS NOT NULL GROUP BY 1, 2)
SELECT book, CAST(sum(greatest(p - g, 0)) AS BIGINT) AS extra_groups, CAST(sum(greatest(g - p, 0)) AS BIGINT) AS missing_groups FROM sc GROUP BY 1""")
def d41_group_counts(s, d):
    return evaluation.group_counts(pairs(s, d))


@query(PAIRS + """SELECT book, round(count(*) FILTER (accepted) / count(*), 9) AS coverage, round((count(*) - count(*) FILTER (accepted)) / count(*), 9) AS refusal_rate,
  round(CASE WHEN count(*) FILTER (NOT resolvable) > 0 THEN count(*) FILTER (NOT resolvable AND p_grp IS NOT NULL) / count(*) FILTER (NOT resolvable) END, 9) AS unknown_force_rate, count(*) FILTER (resolvable) >= 30 AS sufficient,
  count(*) FILTER (accepted) = 0 AS all_refusal, count(*) FILTER (NOT resolvable) > 0 AND count(*) FILTER (NOT resolvable AND p_grp IS NOT NULL) = count(*) FILTER (NOT resolvable) AS forced_all FROM pairs GROUP BY 1""")
def d41_coverage(s, d):
    out = evaluation.coverage(pairs(s, d))
    return out.withColumns({c: F.round(c, 9) for c in ("coverage", "refusal_rate", "unknown_force_rate")})


@query(PAIRS + """, w AS (SELECT 'lib' AS lib, * EXCLUDE (book), book || ':' || coalesce(g_scene, '') AS k FROM pairs),
u AS (SELECT count(*) AS gold, count(pred) AS matched, count(*) FILTER (accepted) AS covered, count(*) FILTER (resolvable) AS resolvable, count(DISTINCT k) AS scenes FROM w)
SELECT gold, matched, (SELECT count(*) FROM pred) AS predicted, round(matched / gold, 9) AS recall, round(covered / gold, 9) AS coverage, resolvable >= 30 AS sufficient, scenes,
  CASE WHEN resolvable >= 30 THEN covered / gold >= 0.7 END AS coverage_met FROM u""")
def a14_library_metrics(s, d):
    """Metrics over all books at once, their scenes told apart by the book."""
    use = pairs(s, d).agg(
        n("gold"), F.count("pred").alias("matched"), F.count_if(F.col("accepted")).alias("covered"), F.count_if(F.col("resolvable")).alias("resolvable"),
        F.count_distinct(F.concat_ws(":", F.col("book").cast("string"), F.coalesce("g_scene", F.lit("")))).alias("scenes"),
    )
    use = use.crossJoin(F.broadcast(frame(s, d, "pred").agg(n("predicted"))))  # one row each
    share, enough = F.col("covered") / F.col("gold"), F.col("resolvable") >= evaluation.LEAST_QUOTES
    return use.select(
        "gold", "matched", "predicted", F.round(F.col("matched") / F.col("gold"), 9).alias("recall"), F.round(share, 9).alias("coverage"),
        enough.alias("sufficient"), "scenes", F.when(enough, share >= evaluation.COVERAGE).alias("coverage_met"),
    )


@query(with_sql("gold", "quotes") + """, g AS (SELECT book, key, CASE WHEN turn % 4 = 1 THEN start_cp + 2 ELSE start_cp END AS a, CASE WHEN turn % 4 = 2 THEN end_cp + 5 WHEN turn % 4 = 1 THEN end_cp - 3 ELSE end_cp END AS b FROM gold)
SELECT g.book, g.key, CASE WHEN EXISTS (SELECT 1 FROM quotes q WHERE q.book = g.book AND q.start_cp = g.a AND q.end_cp = g.b) THEN 'exact'
  WHEN EXISTS (SELECT 1 FROM quotes q WHERE q.book = g.book AND q.start_cp <= g.a AND q.end_cp >= g.b) THEN 'inside' ELSE 'missing' END AS found FROM g""")
def d39_scanner_recall(s, d):
    t = F.col("turn") % 4
    g = frame(s, d, "gold").select("book", "key", F.when(t == 1, F.col("start_cp") + 2).otherwise(F.col("start_cp")).alias("l_start"), F.when(t == 2, F.col("end_cp") + 5).when(t == 1, F.col("end_cp") - 3).otherwise(F.col("end_cp")).alias("l_end"))
    q = frame(s, d, "quotes").select("book", F.col("start_cp").alias("r_start"), F.col("end_cp").alias("r_end"))
    return decisions.scanner_recall(g, q)


CHECKS = with_sql("gold") + """, q AS (SELECT book, CASE WHEN turn = 3 THEN 'dup' ELSE key END AS key, CASE WHEN turn = 4 THEN end_cp ELSE start_cp END AS start_cp, end_cp, CASE WHEN turn = 2 THEN 's99' ELSE scene END AS scene, grp, turn FROM gold
  UNION ALL SELECT book, 'dup', start_cp, end_cp, scene, grp, turn FROM gold WHERE turn = 1),
sc AS (SELECT DISTINCT book, scene FROM gold WHERE scene IS NOT NULL), gr AS (SELECT DISTINCT book, grp FROM gold WHERE grp <> 'g-system') """


@query(CHECKS + """SELECT book, key, 'duplicate_quote' AS issue FROM q GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT book, key, 'empty_range' FROM q WHERE end_cp <= start_cp
UNION ALL SELECT book, key, 'unknown_scene' FROM q WHERE scene IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sc WHERE sc.book = q.book AND sc.scene = q.scene)
UNION ALL SELECT book, key, 'unknown_group' FROM q WHERE grp IS NOT NULL AND NOT EXISTS (SELECT 1 FROM gr WHERE gr.book = q.book AND gr.grp = q.grp)
UNION ALL SELECT book, key, 'overlap' FROM (SELECT *, max(end_cp) OVER (PARTITION BY book ORDER BY start_cp, end_cp, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM q) WHERE start_cp < e""")
def d38_gold_checks(s, d):
    g, t = frame(s, d, "gold"), F.col("turn")
    q = g.select("book", F.when(t == 3, "dup").otherwise(F.col("key")).alias("key"), F.when(t == 4, F.col("end_cp")).otherwise(F.col("start_cp")).alias("start_cp"), "end_cp", F.when(t == 2, "s99").otherwise(F.col("scene")).alias("scene"), "grp")
    q = q.unionByName(g.filter("turn = 1").select("book", F.lit("dup").alias("key"), "start_cp", "end_cp", "scene", "grp"))
    return decisions.gold_issues(q, g.select("book", "scene"), g.filter("grp <> 'g-system'").select("book", "grp"))


@query("""WITH b AS (SELECT doc_id, CASE WHEN doc_id % 50 = 1 THEN doc_id - 1 ELSE doc_id END AS book, CASE WHEN doc_id % 7 = 1 THEN doc_id - 1 ELSE doc_id END AS work, CASE doc_id % 5 WHEN 0 THEN 'dev' WHEN 1 THEN 'test' ELSE 'train' END AS split FROM documents)
SELECT 'duplicate_book' AS issue, book AS key FROM b GROUP BY book HAVING count(*) > 1 UNION ALL SELECT 'work_in_several_splits', work FROM b GROUP BY work HAVING count(DISTINCT split) > 1""")
def d40_manifest_checks(s, d):
    k, i = F.col("doc_id") % 5, F.col("doc_id")
    b = table(s, d, "documents").select(F.when(i % 50 == 1, i - 1).otherwise(i).alias("book"), F.when(i % 7 == 1, i - 1).otherwise(i).alias("work"), F.when(k == 0, "dev").when(k == 1, "test").otherwise("train").alias("split"))
    return decisions.manifest_issues(b)


@query(with_sql("gold") + "SELECT book || ':' || key AS key, CASE WHEN scene IS NOT NULL THEN book || ':' || scene END AS scene, CASE WHEN grp IS NOT NULL THEN book || ':' || grp END AS grp, start_cp, end_cp FROM gold")
def d42_merged_books(s, d):
    """Books merged under prefixed keys; positions stay as they are, so books overlap there."""
    named = lambda c: F.concat(F.col("book").cast("string"), F.lit(":"), c).alias(c)
    return frame(s, d, "gold").select(named("key"), named("scene"), named("grp"), "start_cp", "end_cp")


#: The texts of gaps: documents with full stops and some cues in them.
GAP = "replace(replace(text, '.', '。'), 'dly', '说')"
COMPRESSED = f"""WITH g AS (SELECT doc_id, {GAP} AS t FROM documents), p AS (SELECT doc_id, length(t) AS n, regexp_extract_all(t, '[^。！？!?\\n]*[。！？!?\\n]|[^。！？!?\\n]+$') AS p FROM g),
x AS (SELECT doc_id, n, unnest(p) AS s, generate_subscripts(p, 1) AS k, len(p) AS many FROM p WHERE n > 80 AND len(p) >= 3),
o AS (SELECT *, sum(length(s)) OVER w AS e, CASE WHEN regexp_matches(s, '[「」『』“”"'']') OR regexp_matches(s, '{"|".join(text.CUES)}') OR k = 1 OR k = many THEN 1 ELSE 0 END AS hit FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
k AS (SELECT *, max(hit) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS kept FROM o),
r AS (SELECT *, sum(CASE WHEN kept THEN length(s) ELSE 0 END) OVER (PARTITION BY doc_id) <= n * 0.6 AS worth FROM k),
i AS (SELECT *, k - sum(CASE WHEN kept THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS isle FROM r WHERE worth),
spans AS (SELECT doc_id, true AS kept, CAST(min(e - length(s)) AS BIGINT) AS start_cp, CAST(max(e) AS BIGINT) AS end_cp FROM i WHERE kept GROUP BY doc_id, isle
  UNION ALL SELECT doc_id, false, CAST(e - length(s) AS BIGINT), CAST(e AS BIGINT) FROM i WHERE NOT kept) """


def gap_texts(s, d):
    return table(s, d, "documents").select("doc_id", F.replace(F.replace("text", F.lit("."), F.lit("。")), F.lit("dly"), F.lit("说")).alias("text"))


@query(COMPRESSED + "SELECT * FROM spans")
def d1_gap_compression(s, d):
    return text.compressed(gap_texts(s, d), "doc_id")


@query(COMPRESSED + """, v AS (SELECT *, CASE WHEN NOT kept AND ((start_cp < 160 AND end_cp > 100) OR (start_cp < 420 AND end_cp > 400)) THEN 1 ELSE 0 END AS bad FROM spans)
SELECT g.doc_id, count(DISTINCT v.doc_id) AS compressed, count(*) FILTER (NOT v.kept) AS dropped_spans, CAST(coalesce(sum(CASE WHEN NOT v.kept THEN end_cp - start_cp END), 0) AS BIGINT) AS dropped_cp, CAST(coalesce(sum(bad), 0) AS BIGINT) AS violations FROM g LEFT JOIN v ON v.doc_id = g.doc_id GROUP BY 1""")
def d43_loss_ledger(s, d):
    """What compression drops from each gap, and how often that meets ranges that must stay."""
    gaps = gap_texts(s, d)
    keep = F.array(F.struct(F.lit(100).alias("a"), F.lit(160).alias("b")), F.struct(F.lit(400).alias("a"), F.lit(420).alias("b")))
    return text.loss(gaps.select("doc_id", "text", keep.alias("must_keep")), "doc_id")


@query(with_sql("outputs") + """, a AS (SELECT *, kind = 'speech' OR (versioned AND kind IN ('thought', 'quotation')) AS owned, coalesce(basis, 'INSUFFICIENT') AS b FROM outputs)
SELECT book, quote_id, CASE WHEN kind = 'unknown' THEN 'UNKNOWN' WHEN NOT owned THEN 'ACCEPTED' WHEN assignment = 'UNKNOWN' OR b = 'INSUFFICIENT' THEN 'UNKNOWN' WHEN b = 'STYLE_ONLY' THEN 'PROVISIONAL'
    WHEN b = 'DIRECT' THEN CASE WHEN e_prev IS NULL THEN 'PROVISIONAL' ELSE 'ACCEPTED' END WHEN e_prev IS NOT NULL OR e_self IS NOT NULL THEN 'ACCEPTED' ELSE 'PROVISIONAL' END AS status,
  CASE WHEN kind = 'unknown' THEN 'unknown_quote_kind' WHEN NOT owned THEN 'non_speech_type' WHEN assignment = 'UNKNOWN' OR b = 'INSUFFICIENT' THEN 'insufficient_evidence' WHEN b = 'STYLE_ONLY' THEN 'style_only_basis'
    WHEN b = 'DIRECT' THEN CASE WHEN e_prev IS NULL THEN 'unverified_direct_basis' ELSE 'direct_evidence' END WHEN e_prev IS NOT NULL OR e_self IS NOT NULL THEN 'linked_' || lower(b) ELSE 'unverified_' || lower(b) END AS reason,
  CASE WHEN kind = 'unknown' THEN 'UNKNOWN_QUOTE_KIND' WHEN NOT owned THEN NULL WHEN assignment = 'UNKNOWN' OR b = 'INSUFFICIENT' THEN CASE WHEN kind = 'quotation' THEN 'UNKNOWN_QUOTE_SOURCE' ELSE 'UNKNOWN_SPEAKER' END
    WHEN b = 'STYLE_ONLY' THEN 'LOW_CONFIDENCE' WHEN b = 'DIRECT' THEN CASE WHEN e_prev IS NULL THEN 'LOW_CONFIDENCE' END WHEN e_prev IS NOT NULL OR e_self IS NOT NULL THEN NULL ELSE 'AMBIGUOUS_SPEAKER' END AS review FROM a""")
def d9_acceptance(s, d):
    return decisions.accepted(decisions.with_evidence(frame(s, d, "outputs"))).select("book", "quote_id", "status", "reason", "review")


@query(with_sql("outputs") + "SELECT quote_id, coalesce(greatest(e_prev_end, CASE WHEN e_self IS NOT NULL THEN end_cp END), start_cp) AS visible_from_cp FROM outputs")
def d10_visible_from(s, d):
    positions = F.array_compact(F.array("e_prev_end", F.when(F.col("e_self").isNotNull(), F.col("end_cp"))))
    return frame(s, d, "outputs").select("quote_id", decisions.visible_from(positions, F.col("start_cp")).alias("visible_from_cp"))


@query(with_sql("people") + """SELECT person, CASE WHEN locked THEN 'touches_user_locked' WHEN b IS NULL THEN 'missing_basis' WHEN b NOT IN ('DIRECT', 'COREFERENCE') THEN 'evidence_too_weak:' || b
  WHEN op = 'MERGE' AND ins < 2 THEN 'merge_needs_two_inputs' WHEN op = 'SPLIT' AND outs < 2 THEN 'split_needs_two_outputs' WHEN b = 'COREFERENCE' THEN 'cold_start_coreference' ELSE 'explicit_direct' END AS reason,
  NOT locked AND coalesce(b, '') = 'DIRECT' AND NOT (op = 'MERGE' AND ins < 2) AND NOT (op = 'SPLIT' AND outs < 2) AS applied FROM (SELECT person, locked, CASE person % 5 WHEN 0 THEN 'DIRECT' WHEN 1 THEN 'COREFERENCE' WHEN 2 THEN 'STYLE_ONLY' WHEN 3 THEN NULL ELSE 'DIRECT' END AS b,
  CASE person % 2 WHEN 0 THEN 'MERGE' ELSE 'SPLIT' END AS op, person % 4 AS ins, person % 3 AS outs FROM people)""")
def d16_identity_proposals(s, d):
    k = F.col("person") % 5
    basis = F.when(k == 1, "COREFERENCE").when(k == 2, "STYLE_ONLY").when(k != 3, "DIRECT")
    p = frame(s, d, "people").select("person", "locked", basis.alias("basis"), F.when(F.col("person") % 2 == 0, "MERGE").otherwise("SPLIT").alias("operation"), (F.col("person") % 4).alias("inputs"), (F.col("person") % 3).alias("outputs"))
    return decisions.identity_proposals(p).select("person", "reason", "applied")


@query(with_sql("runs") + """, w AS (SELECT job, win, count(*) AS targets, max(CASE WHEN run % 17 = 0 THEN 1 ELSE 0 END) AS omitted, max(CASE WHEN run % 23 = 0 THEN 1 ELSE 0 END) AS recheck FROM runs GROUP BY 1, 2),
h AS (SELECT *, recheck = 1 OR omitted = 1 OR targets >= 4 AS hard, CAST(floor(0.4 * count(*) OVER (PARTITION BY job)) AS BIGINT) AS cap FROM w),
u AS (SELECT *, coalesce(sum(CASE WHEN hard THEN 1 ELSE 0 END) OVER (PARTITION BY job ORDER BY win ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h)
SELECT job, win, cap, CASE WHEN cap <= 0 THEN 'disabled_by_policy' WHEN before >= cap THEN 'share_cap_reached' WHEN NOT hard THEN 'not_hard' ELSE 'hard_window' END AS reason FROM u""")
def d8_window_routes(s, d):
    """Hard windows go to the strong model until a share of the job's windows has; the rest stay with the base one."""
    flag = lambda m: F.max(F.when(F.col("run") % m == 0, 1).otherwise(0))
    w = frame(s, d, "runs").groupBy("job", "win").agg(n("targets"), flag(17).alias("omitted"), flag(23).alias("recheck"))
    return decisions.routed(w, share=0.4).select("job", "win", "cap", "reason")


@query(with_sql("outputs") + """, u AS (SELECT *, CASE WHEN basis = 'DIRECT' AND e_prev IS NULL THEN 0 WHEN k % 6 = 1 THEN 2 ELSE 1 END AS priority FROM outputs WHERE assignment = 'UNKNOWN' OR basis IN ('STYLE_ONLY', 'DIRECT')),
r AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY priority, start_cp) AS rk FROM u) SELECT book, quote_id, row_number() OVER (PARTITION BY book ORDER BY start_cp) AS position FROM r WHERE rk <= 2""")
def o6_recheck_targets(s, d):
    u = frame(s, d, "outputs").filter("assignment = 'UNKNOWN' OR basis IN ('STYLE_ONLY', 'DIRECT')")
    priority = F.when((F.col("basis") == "DIRECT") & F.col("e_prev").isNull(), 0).when(F.col("k") % 6 == 1, 2).otherwise(1)
    return decisions.recheck_targets(u.withColumn("priority", priority), most=2)


RISKS = with_sql("outputs") + """, o AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY start_cp) - 1 AS i, count(*) OVER (PARTITION BY book) AS many FROM outputs),
d AS (SELECT a.quote_id, p.assignment = 'UNKNOWN' OR p.kind = 'unknown' OR p.basis IN ('STYLE_ONLY', 'INSUFFICIENT') AS weak FROM outputs a JOIN outputs p ON p.quote_id = a.e_prev),
u AS (SELECT e, count(DISTINCT speaker) > 1 AS shared FROM (SELECT e_prev AS e, speaker FROM outputs WHERE e_prev IS NOT NULL UNION ALL SELECT e_self, speaker FROM outputs WHERE e_self IS NOT NULL) GROUP BY 1),
f AS (SELECT o.book, o.quote_id, o.i, o.start_cp, o.e_prev, o.kind, kind <> 'speech' AS r1, assignment = 'UNKNOWN' OR kind = 'unknown' AS r2, coalesce(basis IN ('STYLE_ONLY', 'INSUFFICIENT'), false) AS r3, kind = 'speech' AND e_prev IS NULL AS r4,
  assignment = 'NEW' AS r5, coalesce(u.shared, false) AS r6, coalesce(d.weak, false) AS r7, i = 0 OR i = many - 1 AS r8, i % 16 = 0 AS r9 FROM o LEFT JOIN d ON d.quote_id = o.quote_id LEFT JOIN u ON u.e = o.e_prev) """
NAMED = "concat_ws(',', CASE WHEN r1 THEN 'speech_type_ambiguity' END, CASE WHEN r2 THEN 'unknown' END, CASE WHEN r3 THEN 'weak_basis' END, CASE WHEN r4 THEN 'no_external_evidence' END, CASE WHEN r5 THEN 'new_identity' END, CASE WHEN r6 THEN 'shared_evidence_conflict' END, CASE WHEN r7 THEN 'uncertain_evidence_chain' END, CASE WHEN r8 THEN 'window_edge' END, CASE WHEN r9 THEN 'accepted_sample_audit' END)"


@query(RISKS + f"SELECT book, quote_id, {NAMED} AS reasons FROM f WHERE r1 OR r2 OR r3 OR r4 OR r5 OR r6 OR r7 OR r8 OR r9")
def d45_risks(s, d):
    return decisions.risks(frame(s, d, "outputs")).select("book", "quote_id", F.array_join("reasons", ",").alias("reasons"))


@query(RISKS.replace("WITH ", "WITH RECURSIVE ", 1) + """, reach AS (SELECT quote_id FROM f WHERE r2 OR r3 OR r6 UNION SELECT f.quote_id FROM reach JOIN f ON f.e_prev = reach.quote_id WHERE f.kind = 'speech')
SELECT f.book, f.quote_id FROM f JOIN reach ON reach.quote_id = f.quote_id""")
def d46_chain_risks(s, d):
    """Quotes whose evidence leads back to an uncertain one."""
    return decisions.chain_risks(frame(s, d, "outputs")).select("book", "quote_id")


@query(RISKS + """, t AS (SELECT DISTINCT book, i + o AS i FROM (SELECT book, i FROM f WHERE r3 OR r2) x CROSS JOIN (SELECT unnest([-2, -1, 0, 1, 2]) AS o) y), k AS (SELECT t.book, t.i, f.quote_id FROM t JOIN f ON f.book = t.book AND f.i = t.i),
g AS (SELECT *, i - row_number() OVER (PARTITION BY book ORDER BY i) AS isle FROM k), b AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY book, isle ORDER BY i) - 1) / 4) AS BIGINT) AS part FROM g)
SELECT book, min(i) AS first, max(i) AS last, count(*) AS targets FROM b GROUP BY book, isle, part""")
def w6_review_blocks(s, d):
    """Risky quotes with two neighbours on each side, in runs of at most four."""
    r = decisions.risks(frame(s, d, "outputs"))
    return decisions.review_blocks(r.filter(F.arrays_overlap("reasons", F.array(F.lit("unknown"), F.lit("weak_basis")))), frame(s, d, "outputs"), neighbours=2, most=4)


@query(RISKS + """, e AS (SELECT quote_id, r2 OR r3 OR r4 AS picked, i % 3 = 0 AS wrong, i % 3 = 1 AS fine FROM f)
SELECT round(count(*) FILTER (wrong AND picked) / count(*) FILTER (wrong), 9) AS error_recall, round(count(*) FILTER (fine AND picked) / count(*) FILTER (fine), 9) AS unnecessary_review_rate, count(*) FILTER (wrong) AS errors, count(*) FILTER (picked) AS picked FROM e""")
def d45_risk_scores(s, d):
    r = decisions.numbered(frame(s, d, "outputs")).select("quote_id", "i")
    picked = decisions.risks(frame(s, d, "outputs")).filter(F.arrays_overlap("reasons", F.array(*map(F.lit, ("unknown", "weak_basis", "no_external_evidence"))))).select("quote_id", F.lit(True).alias("p"))
    e = r.join(picked, "quote_id", "left").select(F.coalesce("p", F.lit(False)).alias("p"), (F.col("i") % 3 == 0).alias("w"), (F.col("i") % 3 == 1).alias("f"))
    both = lambda c: F.round(F.count_if(F.col(c) & F.col("p")) / F.count_if(F.col(c)), 9)
    return e.agg(both("w").alias("error_recall"), both("f").alias("unnecessary_review_rate"), F.count_if("w").alias("errors"), F.count_if("p").alias("picked"))


@query(PAIRS + """SELECT book, count(*) AS quotes, count(*) FILTER (p_grp IS NOT NULL AND substring(p_grp, 3) = substring(g_grp, 3)) AS right_, count(*) FILTER (p_grp IS NOT NULL AND g_grp IS NOT NULL AND substring(p_grp, 3) <> substring(g_grp, 3)) AS wrong,
  count(*) FILTER (p_grp IS NULL AND g_grp IS NOT NULL) AS unknown, count(*) FILTER (g_grp IS NULL) AS unscored FROM pairs GROUP BY 1""")
def d47_identity_scores(s, d):
    """Exact identities; an unknown one is neither right nor wrong."""
    name = lambda c: F.substring(c, 3, 1000)
    p, g = F.col("p_grp"), F.col("g_grp")
    return pairs(s, d).groupBy("book").agg(n("quotes"), F.count_if(name("p_grp") == name("g_grp")).alias("right_"), F.count_if(name("p_grp") != name("g_grp")).alias("wrong"), F.count_if(p.isNull() & g.isNotNull()).alias("unknown"), F.count_if(g.isNull()).alias("unscored"))


VOTE = with_sql("outputs") + """, v AS (SELECT quote_id, k % 13 = 0 AS locked, speaker AS base, CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN speaker ELSE 'other' END AS review, CASE WHEN k % 5 = 0 THEN 'other' WHEN k % 5 = 1 THEN speaker END AS third, k % 2 = 0 AS supported FROM outputs) """


@query(VOTE + """SELECT quote_id, CASE WHEN locked THEN base WHEN review IS NULL OR review = base THEN base WHEN third = review THEN review WHEN third = base THEN base END AS speaker,
  CASE WHEN locked THEN 'locked' WHEN review IS NULL THEN 'unreviewed' WHEN review = base THEN 'agreed' WHEN third IS NULL THEN 'unresolved_conflict' WHEN third IN (review, base) THEN 'adjudicated' ELSE 'unresolved_conflict' END AS outcome FROM v""")
def d48_reconciled(s, d):
    return decisions.reconciled(decisions.votes(frame(s, d, "outputs"))).select("quote_id", "speaker", "outcome")


@query(VOTE + "SELECT quote_id, NOT locked AND review IS NOT NULL AND review = base AND third IS NOT NULL AND third <> base AND supported AS challenged FROM v")
def x43_agreement_challenges(s, d):
    return decisions.challenged(decisions.votes(frame(s, d, "outputs"))).select("quote_id", "challenged")


@query(VOTE + """, o AS (SELECT *, CASE WHEN NOT locked AND review <> base AND (third IS NULL OR third NOT IN (review, base)) THEN true ELSE false END AS conflict FROM v)
SELECT o.quote_id FROM o JOIN outputs t ON t.quote_id = o.quote_id WHERE NOT locked AND (conflict OR t.k % 11 = 0 OR (t.kind = 'speech' AND t.e_prev IS NULL))""")
def x42_adjudication_triggers(s, d):
    v = decisions.reconciled(decisions.votes(frame(s, d, "outputs")))
    wanted = (F.col("outcome") == "unresolved_conflict") | (F.col("k") % 11 == 0) | ((F.col("kind") == "speech") & F.col("e_prev").isNull())
    return v.filter(~F.col("locked") & wanted).select("quote_id")


APPLIED = with_sql("outputs", "gaps") + """, a AS (SELECT *, kind = 'speech' OR (versioned AND kind IN ('thought', 'quotation')) AS owned, coalesce(basis, 'INSUFFICIENT') AS b FROM outputs),
st AS (SELECT *, CASE WHEN kind = 'unknown' THEN 'UNKNOWN' WHEN NOT owned THEN 'ACCEPTED' WHEN assignment = 'UNKNOWN' OR b = 'INSUFFICIENT' THEN 'UNKNOWN' WHEN b = 'STYLE_ONLY' THEN 'PROVISIONAL'
    WHEN b = 'DIRECT' THEN CASE WHEN e_prev IS NULL THEN 'PROVISIONAL' ELSE 'ACCEPTED' END WHEN e_prev IS NOT NULL OR e_self IS NOT NULL THEN 'ACCEPTED' ELSE 'PROVISIONAL' END AS status,
  CASE WHEN kind = 'unknown' THEN 'UNKNOWN_QUOTE_KIND' WHEN NOT owned THEN NULL WHEN assignment = 'UNKNOWN' OR b = 'INSUFFICIENT' THEN CASE WHEN kind = 'quotation' THEN 'UNKNOWN_QUOTE_SOURCE' ELSE 'UNKNOWN_SPEAKER' END
    WHEN b = 'STYLE_ONLY' THEN 'LOW_CONFIDENCE' WHEN b = 'DIRECT' THEN CASE WHEN e_prev IS NULL THEN 'LOW_CONFIDENCE' END WHEN e_prev IS NOT NULL OR e_self IS NOT NULL THEN NULL ELSE 'AMBIGUOUS_SPEAKER' END AS review FROM a),
sc AS (SELECT st.*, (SELECT count(*) FROM gaps g WHERE g.book = st.book AND g.end_cp <= st.start_cp AND g.turn % 4 = 0) AS scene, k % 13 = 0 AS locked, CASE WHEN k % 5 <> 4 THEN k % 3 END AS ver FROM st),
ow AS (SELECT *, NOT (locked AND ver IS NOT NULL) AND status <> 'UNKNOWN' AND kind IN ('speech', 'thought', 'quotation') AS slotted, locked AND ver IS NOT NULL AS held FROM sc),
fi AS (SELECT *, min(CASE WHEN slotted THEN start_cp END) OVER (PARTITION BY book, scene, speaker) AS f FROM ow), sl AS (SELECT *, dense_rank() OVER (PARTITION BY book, scene ORDER BY f NULLS LAST) AS slot FROM fi) """


@query(APPLIED + """SELECT book, quote_id, scene, CASE WHEN slotted THEN 'S' || slot END AS label, CASE WHEN held THEN 'OLD' ELSE status END AS status, CASE WHEN NOT held THEN review END AS review,
  coalesce(greatest(e_prev_end, CASE WHEN e_self IS NOT NULL THEN end_cp END), start_cp) AS visible_from_cp, coalesce(ver, 0) + CASE WHEN held THEN 0 ELSE 1 END AS version, ver IS NOT NULL AND NOT held AS history FROM sl""")
def d12_window_application(s, d):
    """Labels and gap decisions of an answer, applied in the order of the text."""
    k = F.col("k")
    o = decisions.with_evidence(frame(s, d, "outputs")).withColumn("evidence_cp", F.array_compact(F.array("e_prev_end", F.when(F.col("e_self").isNotNull(), F.col("end_cp")))))
    g = frame(s, d, "gaps").select("book", F.col("end_cp").alias("at"), F.when(F.col("turn") % 4 == 0, "BREAK").otherwise("CONTINUE").alias("decision"))
    stored = frame(s, d, "outputs").filter("k % 5 <> 4").select("quote_id", (k % 3).alias("version"), (k % 13 == 0).alias("locked"), F.lit("OLD").alias("was"))
    return decisions.applied(o, g, stored)
