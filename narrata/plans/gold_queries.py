"""Issues of gold standards and risks of answers over derived tables, one SELECT a code in the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from narrata.operators import gold, risks
from narrata.operators.graph import settled
from narrata.plans.dialogue_queries import query
from narrata.sources.model import frame, with_sql

_IN = "({0} >= {2} AND {0} < {1} AND {1} <= {3})"
_BOOK = _IN.format("coalesce({0}, -1)", "coalesce({1}, -1)", "0", "b.length_cp")
_range = lambda start, end: f"b.length_cp IS NOT NULL AND NOT {_BOOK.format(start, end)}"

ISSUES = with_sql("r_books", "r_scenes", "r_people", "r_quotes", "r_gaps") + f""", s AS (SELECT *, row_number() OVER (PARTITION BY book, scene_id ORDER BY i) AS nth, row_number() OVER (PARTITION BY book, scene_id ORDER BY i DESC) AS back FROM r_scenes),
q AS (SELECT *, row_number() OVER (PARTITION BY book, quote_id ORDER BY i) AS nth, row_number() OVER (PARTITION BY book, quote_id ORDER BY i DESC) AS back FROM r_quotes), lq AS (SELECT * FROM q WHERE back = 1),
g AS (SELECT *, row_number() OVER (PARTITION BY book, gap_id ORDER BY i) AS nth FROM r_gaps)
SELECT book, CASE WHEN code IN ('visible_before_evidence', 'must_keep_outside_gap', 'quote_not_delimited') THEN 'warning' ELSE 'error' END AS level, code, target, count(*) AS times FROM (
  SELECT book, 'duplicate_scene_id' AS code, scene_id AS target FROM s WHERE nth > 1 UNION ALL SELECT s.book, 'scene_range_out_of_bounds', scene_id FROM s JOIN r_books b ON b.book = s.book WHERE {_range("start_cp", "end_cp")}
  UNION ALL SELECT book, 'duplicate_quote_id', quote_id FROM q WHERE nth > 1 UNION ALL SELECT q.book, 'quote_range_out_of_bounds', quote_id FROM q JOIN r_books b ON b.book = q.book WHERE {_range("start_cp", "end_cp")}
  UNION ALL SELECT book, 'unknown_scene', quote_id FROM q WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.book = q.book AND s.scene_id = q.scene_id)
  UNION ALL SELECT book, 'resolvable_without_group', quote_id FROM q WHERE resolvable AND group_id IS NULL UNION ALL SELECT book, 'unresolvable_with_group', quote_id FROM q WHERE NOT resolvable AND group_id IS NOT NULL
  UNION ALL SELECT book, 'group_not_in_scene', quote_id FROM q WHERE group_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s JOIN r_people p ON p.book = s.book AND p.i = s.i WHERE s.back = 1 AND s.book = q.book AND s.scene_id = q.scene_id AND p.label = q.group_id)
  UNION ALL SELECT book, 'fragment_out_of_quote', quote_id FROM q WHERE NOT {_IN.format("f_start", "f_end", "start_cp", "end_cp")}
  UNION ALL SELECT q.book, 'evidence_range_out_of_bounds', quote_id FROM q JOIN r_books b ON b.book = q.book WHERE {_range("e_start", "e_end")} UNION ALL SELECT book, 'visible_before_evidence', quote_id FROM q WHERE coalesce(visible_from_cp, 0) < e_start
  UNION ALL SELECT book, 'quote_not_delimited', quote_id FROM q WHERE kind <> 'other' AND start_cp < end_cp AND body IS NOT NULL AND NOT regexp_full_match(body, '[「『“‘〈《（(](.|\\n)*[」』”’〉》）)]')
  UNION ALL SELECT book, 'duplicate_gap_id', gap_id FROM g WHERE nth > 1
  UNION ALL SELECT book, 'unknown_quote_in_gap', gap_id FROM (SELECT book, gap_id, left_id AS x FROM g UNION ALL SELECT book, gap_id, right_id FROM g) y WHERE x IS NOT NULL AND NOT EXISTS (SELECT 1 FROM q WHERE q.book = y.book AND q.quote_id = y.x)
  UNION ALL SELECT g.book, 'must_keep_outside_gap', gap_id FROM g JOIN lq l ON l.book = g.book AND l.quote_id = g.left_id JOIN lq r ON r.book = g.book AND r.quote_id = g.right_id WHERE NOT {_IN.format("m_start", "m_end", "l.end_cp", "r.start_cp")}) GROUP BY 1, 2, 3, 4"""


@query(ISSUES)
def d38_reference_checks(s, d):
    """All fifteen codes of a gold standard's references, with what each is about and how often."""
    of = lambda name: settled(frame(s, d, f"r_{name}"))
    people = of("people").groupBy("book", "i").agg(F.collect_set("label").alias("participants"))
    scenes = of("scenes").join(people, ["book", "i"], "left")
    span = lambda a, b, *more: F.array(F.struct(F.col(a).alias("start_cp"), F.col(b).alias("end_cp"), *more))
    quotes = of("quotes").withColumns({"fragments": span("f_start", "f_end"), "evidence": span("e_start", "e_end", "visible_from_cp")})
    gaps = of("gaps").withColumnsRenamed({"left_id": "left_quote_id", "right_id": "right_quote_id"}).withColumn("must_keep", span("m_start", "m_end"))
    return gold.reference_issues(of("books"), scenes, quotes, gaps)


_CUE, _SELF = "'说|问|答|喊|叫|开口|吐槽'", "'我是|我叫|本人'"
RISKS = with_sql("k_targets", "k_labels", "k_context", "k_people", "k_declared", "k_requested") + f""", t AS (SELECT win, quote_id, row_number() OVER (PARTITION BY win ORDER BY i) - 1 AS i, count(*) OVER (PARTITION BY win) - 1 AS last FROM k_targets),
e AS (SELECT win, quote_id, speaker, e_self AS ref FROM k_labels WHERE e_self IS NOT NULL UNION ALL SELECT win, quote_id, speaker, e_prev FROM k_labels WHERE e_prev IS NOT NULL),
sh AS (SELECT win, ref FROM e GROUP BY 1, 2 HAVING count(DISTINCT speaker) > 1),
x AS (SELECT e.win, e.quote_id, c.ref, c.text FROM e JOIN k_context c ON c.win = e.win AND c.ref = e.ref WHERE e.ref <> e.quote_id),
l AS (SELECT l.*, d.temp_ref IS NOT NULL AND coalesce(d.character_id, '') = '' AS is_new, p.name, p.alias, c.text AS own FROM k_labels l LEFT JOIN k_declared d ON d.win = l.win AND d.temp_ref = l.speaker
  LEFT JOIN k_people p ON p.win = l.win AND ((d.temp_ref IS NULL AND p.existing_ref = l.speaker) OR (d.temp_ref IS NOT NULL AND p.character_id = d.character_id)) LEFT JOIN k_context c ON c.win = l.win AND c.ref = l.quote_id),
r AS (SELECT t.win, t.quote_id, t.i, concat_ws(',', CASE WHEN EXISTS (SELECT 1 FROM k_requested r WHERE r.win = t.win AND r.quote_id = t.quote_id) THEN 'requested_context' END, CASE WHEN l.kind IS NULL THEN 'missing_label' END,
  CASE WHEN l.kind <> 'speech' THEN 'speech_type_ambiguity' END, CASE WHEN l.assignment = 'UNKNOWN' OR l.kind = 'unknown' THEN 'unknown' END, CASE WHEN l.basis IN ('STYLE_ONLY', 'INSUFFICIENT') THEN 'weak_basis' END,
  CASE WHEN l.kind = 'speech' AND NOT EXISTS (SELECT 1 FROM x WHERE x.win = t.win AND x.quote_id = t.quote_id) THEN 'no_external_evidence' END, CASE WHEN l.is_new THEN 'new_identity' END,
  CASE WHEN l.basis = 'DIRECT' AND NOT (EXISTS (SELECT 1 FROM x WHERE x.win = t.win AND x.quote_id = t.quote_id AND (contains(x.text, l.name) OR contains(x.text, l.alias))) AND EXISTS (SELECT 1 FROM x WHERE x.win = t.win AND x.quote_id = t.quote_id AND regexp_matches(x.text, {_CUE}))) THEN 'direct_relation_unverified' END,
  CASE WHEN EXISTS (SELECT 1 FROM x JOIN sh ON sh.win = x.win AND sh.ref = x.ref WHERE x.win = t.win AND x.quote_id = t.quote_id) THEN 'shared_evidence_conflict' END,
  CASE WHEN EXISTS (SELECT 1 FROM x JOIN k_labels y ON y.win = x.win AND y.quote_id = x.ref WHERE x.win = t.win AND x.quote_id = t.quote_id AND (y.assignment = 'UNKNOWN' OR y.kind = 'unknown' OR y.basis IN ('STYLE_ONLY', 'INSUFFICIENT'))) THEN 'uncertain_evidence_chain' END,
  CASE WHEN (contains(l.own, l.name) OR contains(l.own, l.alias)) AND NOT regexp_matches(l.own, {_SELF}) THEN 'addressed_person_conflict' END,
  CASE WHEN t.i = 0 OR t.i = t.last THEN 'window_edge' END, CASE WHEN t.i % 16 = 0 THEN 'accepted_sample_audit' END) AS reasons FROM t LEFT JOIN l ON l.win = t.win AND l.quote_id = t.quote_id)
SELECT win, quote_id, CAST(i AS BIGINT) AS i, reasons FROM r WHERE reasons <> ''"""


@query(RISKS)
def d45_all_reasons(s, d):
    """All thirteen reasons to look at an answer again, for every target of a window."""
    of = lambda name: settled(frame(s, d, f"k_{name}"))
    labels = of("labels").withColumn("evidence", F.array_compact(F.array("e_self", "e_prev")))
    people = of("people").withColumn("aliases", F.array("alias"))
    found = risks.detected(of("targets"), labels, of("context"), people, of("declared"), of("requested"))
    return found.select("win", "quote_id", F.col("i").cast("long").alias("i"), F.array_join("reasons", ",").alias("reasons"))
