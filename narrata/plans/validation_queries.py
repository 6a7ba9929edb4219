"""Issues of outputs over the derived windows, one SELECT a code in the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from narrata.operators import validation
from narrata.operators.graph import settled
from narrata.plans.dialogue_queries import query
from narrata.sources.model import frame, with_sql

_ALLOWED = "(SELECT ref FROM v_targets t WHERE t.win = x.win AND t.kind = '{}')"
_BAD_NAME = "(coalesce(trim({0}), '') = '' OR length(trim({0})) > 32 OR regexp_matches(trim({0}), '[（）(),，。；;\\n]|本章|第一人称|叙述者') OR regexp_full_match(lower(trim({0})), 's[0-9]+|new[0-9]+|未知人物|未知|不确定'))"
_quote, _gap, _scene, _speaker, _person = (_ALLOWED.format(k) for k in ("quote", "gap", "scene", "speaker", "character"))

ISSUES = with_sql("v_targets", "v_updates", "v_decisions", "v_speakers", "v_labels") + f""", br AS (SELECT DISTINCT win, gap FROM v_decisions WHERE decision = 'BREAK'), made AS (SELECT DISTINCT win, temp_ref AS scene FROM v_updates),
u AS (SELECT *, row_number() OVER (PARTITION BY win, temp_ref ORDER BY i) AS n1, row_number() OVER (PARTITION BY win, after_gap ORDER BY i) AS n2, row_number() OVER (PARTITION BY win, starts_at ORDER BY i) AS n3 FROM v_updates),
st AS (SELECT win, starts_at AS quote, arg_max(temp_ref, i) AS scene FROM v_updates GROUP BY 1, 2),
ex AS (SELECT t.win, t.ref AS quote, t.position, coalesce(last_value(st.scene IGNORE NULLS) OVER (PARTITION BY t.win ORDER BY t.position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 's0') AS expected FROM v_targets t LEFT JOIN st ON st.win = t.win AND st.quote = t.ref WHERE t.kind = 'quote'),
sp AS (SELECT *, row_number() OVER (PARTITION BY win, temp_ref ORDER BY i) AS n1 FROM v_speakers), home AS (SELECT win, temp_ref, arg_max(scene, i) AS scene FROM v_speakers GROUP BY 1, 2),
fu AS (SELECT l.win, l.speaker, arg_min(struct_pack(quote := l.quote, how := l.assignment), (coalesce(ex.position, 999), l.i)) AS f FROM v_labels l LEFT JOIN ex ON ex.win = l.win AND ex.quote = l.quote WHERE l.owned GROUP BY 1, 2),
l AS (SELECT l.*, row_number() OVER (PARTITION BY l.win, l.quote ORDER BY l.i) AS n1, ex.expected, h.scene AS at_home FROM v_labels l LEFT JOIN ex ON ex.win = l.win AND ex.quote = l.quote LEFT JOIN home h ON h.win = l.win AND h.temp_ref = l.speaker),
lc AS (SELECT win, quote, CASE WHEN n1 > 1 THEN 'duplicate_label' WHEN expected IS NULL THEN 'unknown_quote' WHEN scene <> 's0' AND NOT EXISTS (SELECT 1 FROM made m WHERE m.win = x.win AND m.scene = x.scene) THEN 'unknown_scene' WHEN scene <> expected THEN 'speaker_scene_mismatch'
  WHEN owned AND assignment = 'EXISTING' AND NOT (expected = 's0' AND speaker IN {_speaker}) AND coalesce(at_home, '?') <> expected THEN CASE WHEN expected <> 's0' THEN 'old_scene_speaker' ELSE 'unknown_speaker' END
  WHEN owned AND assignment = 'NEW' AND at_home IS NULL THEN 'undeclared_new_speaker' WHEN owned AND assignment = 'NEW' AND at_home <> scene THEN 'speaker_scene_mismatch'
  WHEN cited IS NOT NULL AND EXISTS (SELECT 1 FROM v_targets t WHERE t.win = x.win AND t.kind = 'evidence') AND NOT EXISTS (SELECT 1 FROM v_targets t WHERE t.win = x.win AND t.kind = 'evidence' AND t.ref = x.cited) THEN 'unknown_evidence' END AS code FROM l x)
SELECT win, code, ref, count(*) AS times FROM (
  SELECT win, 'duplicate_scene_ref' AS code, temp_ref AS ref FROM u x WHERE n1 > 1 OR temp_ref = 's0' UNION ALL SELECT win, 'duplicate_scene_update', after_gap FROM u WHERE n2 > 1 UNION ALL SELECT win, 'duplicate_scene_start', starts_at FROM u WHERE n3 > 1
  UNION ALL SELECT win, 'unknown_gap_in_scene_update', temp_ref FROM u x WHERE after_gap NOT IN {_gap}
  UNION ALL SELECT win, 'scene_update_without_break', temp_ref FROM u x WHERE after_gap IN {_gap} AND NOT EXISTS (SELECT 1 FROM br WHERE br.win = x.win AND br.gap = x.after_gap)
  UNION ALL SELECT win, 'unknown_quote_in_scene_update', temp_ref FROM u x WHERE starts_at NOT IN {_quote}
  UNION ALL SELECT win, 'break_without_scene_update', gap FROM br WHERE NOT EXISTS (SELECT 1 FROM v_updates v WHERE v.win = br.win AND v.after_gap = br.gap)
  UNION ALL SELECT win, 'unknown_character_in_speaker', temp_ref FROM sp x WHERE character <> '' AND character NOT IN {_person} UNION ALL SELECT win, 'missing_character_evidence', temp_ref FROM sp WHERE character <> '' AND evidence = 0
  UNION ALL SELECT win, 'missing_speaker_name', temp_ref FROM sp WHERE {_BAD_NAME.format("name")} AND NOT (name IS NULL AND character = 'c1')
  UNION ALL SELECT win, 'missing_real_name_evidence', temp_ref FROM sp WHERE real_name IS NOT NULL AND ({_BAD_NAME.format("real_name")} OR evidence = 0)
  UNION ALL SELECT win, 'duplicate_speaker_ref', temp_ref FROM sp WHERE n1 > 1
  UNION ALL SELECT win, 'unknown_scene_in_speaker', temp_ref FROM sp x WHERE scene <> 's0' AND NOT EXISTS (SELECT 1 FROM made m WHERE m.win = x.win AND m.scene = x.scene)
  UNION ALL SELECT win, 'unknown_quote_in_speaker', temp_ref FROM sp x WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.win = x.win AND ex.quote = x.first_quote)
  UNION ALL SELECT x.win, 'speaker_used_before_creation', f.quote FROM sp x JOIN fu ON fu.win = x.win AND fu.speaker = x.temp_ref WHERE x.temp_ref <> 'user' AND NOT (f.how = 'NEW' AND f.quote IS NOT DISTINCT FROM x.first_quote)
  UNION ALL SELECT win, 'duplicate_gap_decision', gap FROM (SELECT *, row_number() OVER (PARTITION BY win, gap ORDER BY i) AS n1 FROM v_decisions) WHERE n1 > 1 UNION ALL SELECT win, 'unknown_gap', gap FROM v_decisions x WHERE gap NOT IN {_gap}
  UNION ALL SELECT win, code, quote FROM lc WHERE code IS NOT NULL
  UNION ALL SELECT DISTINCT win, 'missing_targets', NULL FROM ex WHERE NOT EXISTS (SELECT 1 FROM v_labels v WHERE v.win = ex.win AND v.quote = ex.quote)
  UNION ALL SELECT book, 'unknown_needs_context', quote_id FROM outputs WHERE turn IN (4, 5) AND turn = 5) GROUP BY 1, 2, 3"""


@query(ISSUES)
def d13_validation(s, d):
    """All that is wrong with each window's output: every code, with what it is about and how often."""
    of = lambda name: settled(frame(s, d, f"v_{name}"))
    labels = of("labels").withColumn("evidence", F.when(F.col("cited").isNotNull(), F.array("cited"))).drop("cited")
    needs = frame(s, d, "outputs").filter("turn IN (4, 5)").select(F.col("book").alias("win"), F.col("quote_id").alias("quote"))
    found = validation.issues(of("targets"), of("updates"), of("decisions"), of("speakers"), labels, needs)
    return found.groupBy("win", "code", "ref").agg(F.count(F.lit(1)).alias("times"))
