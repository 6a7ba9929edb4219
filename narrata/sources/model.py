"""The rest of the model over the given tables: model outputs, predictions, review items, runs, scenes, people, headed texts.

These tables stand in for what a service would have stored. Each is one SELECT that Spark and the other engine both
read, so that the operators over them are held against the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from narrata.sources.dialogue import SQL as _DIALOGUE
from narrata.sources.dialogue import table

#: The given tables.
GIVEN = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations"]

#: By name, in the order in which one builds on another.
SQL = {
    **{k: v.partition(" AS (")[2].strip().removesuffix(")") for k, v in _DIALOGUE.items()},
    "numbered": "SELECT *, book * 7 + turn AS k FROM quotes",
    "scenes": """SELECT book, CAST(floor(turn / 3) AS BIGINT) AS scene, min(start_cp) AS start_cp, max(end_cp) AS end_cp
      FROM segments GROUP BY book, CAST(floor(turn / 3) AS BIGINT)""",
    "gaps": """SELECT book, 'g' || substring(sha1(book || '|' || a || '|' || b || '|scanner-1'), 1, 31) AS gap_id, left_id, right_id, a AS start_cp, b AS end_cp, turn
      FROM (SELECT book, turn, quote_id AS left_id, lead(quote_id) OVER (PARTITION BY book ORDER BY start_cp) AS right_id, end_cp AS a,
        lead(start_cp) OVER (PARTITION BY book ORDER BY start_cp) AS b FROM quotes) x WHERE b > a""",
    "story": """SELECT book, turn, role, t, quoted, seg, CAST(coalesce(sum(length(seg)) OVER (PARTITION BY book ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_cp
      FROM (SELECT *, quoted || CASE WHEN turn % 4 = 3 THEN chr(10) || '  ' WHEN turn % 4 = 2 THEN '' ELSE chr(10) || role || '。' END || CASE WHEN turn % 4 = 2 THEN '' ELSE chr(10) END AS seg
        FROM (SELECT *, '「' || t || CASE WHEN turn % 3 = 1 THEN '『in「ner」』' ELSE '' END || '」' AS quoted
          FROM (SELECT conv_id AS book, turn, role, replace(replace(replace(text, chr(10), ' '), '(', '['), ')', ']') AS t FROM conversations) x) y) z""",
    "told": """SELECT book, turn, role, quoted, seg, CAST(coalesce(sum(length(seg)) OVER (PARTITION BY book ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_cp
      FROM (SELECT *, quoted || CASE (book + turn) % 9 WHEN 0 THEN role || '说道。' WHEN 1 THEN chr(10) || 'a' || substring(role, 1, 4) || '，低声回答他' WHEN 2 THEN '少年没有回答，她问' WHEN 3 THEN '说' WHEN 4 THEN '——' || role || '忽然说：'
          WHEN 5 THEN substring(t, 1, 25) || '喊道' WHEN 6 THEN substring(t, 1, 45) || '叫' WHEN 7 THEN '他、她道' ELSE '' END || chr(10) AS seg
        FROM (SELECT conv_id AS book, turn, role, replace(text, chr(10), ' ') AS t, '「' || replace(text, chr(10), ' ') || '」' AS quoted FROM conversations) x) y""",
    "naming": """SELECT book, role AS person, 'designation' AS kind, role AS value, CAST(0 AS BIGINT) AS visible_from_cp FROM segments GROUP BY book, role
      UNION ALL SELECT book, role, 'name', max(substring(quoted, 2, 9)), min(start_cp) + 900 FROM segments GROUP BY book, role
      UNION ALL SELECT book, role, 'alias', max(substring(quoted, 12, 3)), min(end_cp) FROM segments GROUP BY book, role
      UNION ALL SELECT book, 'guest' || turn, 'alias', substring(quoted, 5, 5), start_cp FROM segments WHERE turn > 2
      UNION ALL SELECT book, 'guest' || turn, 'designation', 'the ' || substring(quoted, 5, 2), start_cp FROM segments WHERE turn > 3""",
    "headed": """SELECT book, turn * 4 + j AS line, body, CASE WHEN turn = last AND j = 3 AND book % 2 = 1 THEN '' ELSE sep END AS sep FROM (
      SELECT conv_id AS book, turn, j, max(turn) OVER (PARTITION BY conv_id) AS last,
        CASE j WHEN 0 THEN CASE WHEN turn = 0 AND conv_id % 2 = 1 THEN 'preface' WHEN turn % 4 = 0 THEN '第' || (turn + 1) || '章 起' WHEN turn % 4 = 1 THEN '第' || turn || '节，正文、行' WHEN turn % 4 = 2 THEN '序章' ELSE 'plain ' || role END
          WHEN 1 THEN CASE WHEN turn % 2 = 0 THEN '' ELSE '  ' END WHEN 2 THEN CASE WHEN turn % 4 = 2 THEN '序章' WHEN turn % 4 = 0 THEN ' 番外 ' || turn ELSE 'x' END
          ELSE replace(text, chr(10), ' ') END AS body,
        CASE (turn + j) % 3 WHEN 0 THEN chr(13) || chr(10) WHEN 1 THEN chr(10) ELSE chr(13) END AS sep
      FROM conversations CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) x) y""",
    "outputs": """SELECT book, quote_id, turn, k, start_cp, end_cp, role AS speaker, k % 2 = 0 AS versioned,
        CASE k % 8 WHEN 4 THEN 'thought' WHEN 5 THEN 'quotation' WHEN 6 THEN CASE WHEN k % 3 = 0 THEN 'group' ELSE 'other' END
          WHEN 7 THEN CASE WHEN k % 3 = 0 THEN 'unknown' ELSE 'speech' END ELSE 'speech' END AS kind,
        CASE WHEN k % 9 = 8 THEN 'UNKNOWN' WHEN k % 9 = 0 THEN 'NEW' ELSE 'EXISTING' END AS assignment,
        CASE k % 7 WHEN 0 THEN 'DIRECT' WHEN 1 THEN 'COREFERENCE' WHEN 2 THEN 'RESPONSE_LINK' WHEN 3 THEN 'STYLE_ONLY'
          WHEN 4 THEN 'INSUFFICIENT' WHEN 5 THEN 'DIRECT' END AS basis,
        CASE WHEN k % 3 <> 1 THEN quote_id END AS e_self,
        CASE WHEN k % 4 <> 3 THEN lag(quote_id) OVER (PARTITION BY book ORDER BY start_cp) END AS e_prev,
        CASE WHEN k % 4 <> 3 THEN lag(end_cp) OVER (PARTITION BY book ORDER BY start_cp) END AS e_prev_end
      FROM numbered""",
    "gold": """SELECT book, quote_id AS key, turn, start_cp, end_cp, CASE WHEN k % 17 <> 16 THEN 's' || CAST(floor(turn / 3) AS BIGINT) END AS scene,
        CASE WHEN k % 12 <> 11 THEN 'g-' || role END AS grp, k % 8 <> 7 AS resolvable FROM numbered""",
    "pred": """SELECT book, 'p' || turn AS key, start_cp + (turn % 3) AS start_cp,
        CASE WHEN k % 11 = 5 THEN start_cp + (turn % 3) + 1 + CAST(floor((end_cp - start_cp) / 3) AS BIGINT) ELSE end_cp END AS end_cp,
        's' || CAST(floor((turn + CASE WHEN k % 13 = 12 THEN 3 ELSE 0 END) / 3) AS BIGINT) AS scene,
        CASE WHEN k % 10 = 9 THEN NULL WHEN k % 7 = 0 THEN 'q-user' ELSE 'q-' || role END AS grp,
        CASE k % 5 WHEN 0 THEN 'PROVISIONAL' WHEN 1 THEN 'USER_CONFIRMED' WHEN 2 THEN '' ELSE 'accepted' END AS status,
        CASE WHEN k % 19 = 18 THEN true WHEN k % 19 = 17 THEN false END AS flag FROM numbered WHERE k % 9 <> 8
      UNION ALL SELECT book, 'x' || turn, start_cp, start_cp + CAST(floor((end_cp - start_cp) * 2 / 3) AS BIGINT), 's0', 'q-x', 'ACCEPTED', NULL FROM numbered WHERE k % 6 = 2""",
    "items": """SELECT book, 'i' || substring(quote_id, 2, 12) AS item, quote_id, CAST(NULL AS STRING) AS gap_id,
        CASE k % 5 WHEN 1 THEN 'UNKNOWN_SPEAKER' WHEN 2 THEN 'STALE_DEPENDENCY' WHEN 3 THEN 'USER_FLAGGED' ELSE 'LOW_CONFIDENCE' END AS reason,
        CASE k % 4 WHEN 0 THEN 'RESOLVED' WHEN 1 THEN 'DEFERRED' ELSE 'PENDING' END AS status,
        CASE k % 7 WHEN 0 THEN '{bad' WHEN 1 THEN '{"reason": "unknown_quote_kind"}' WHEN 2 THEN '{"reason": "unapproved_expression_owner"}'
          WHEN 3 THEN '{}' ELSE '{"reason": "insufficient_evidence"}' END AS candidates, k % 23 AS created FROM numbered WHERE k % 3 <> 1
      UNION ALL SELECT book, 'j' || substring(gap_id, 2, 12), CAST(NULL AS STRING), gap_id, 'SCENE_BOUNDARY',
        CASE turn % 3 WHEN 0 THEN 'RESOLVED' ELSE 'PENDING' END, '{}', turn % 5 FROM gaps""",
    "runs": """SELECT event_id AS run, user_id AS job, user_id % 10 AS book, event_id % 7 AS win, ts AS created_at,
        CASE event_id % 6 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'DISPATCHED' WHEN 2 THEN 'UNKNOWN_OUTCOME' ELSE 'SUCCEEDED' END AS state,
        CASE WHEN event_id % 6 = 0 THEN CASE event_id % 5 WHEN 0 THEN 'RATE_LIMITED' WHEN 1 THEN 'INVALID_MODEL_OUTPUT' WHEN 2 THEN 'PROVIDER_QUOTA_EXHAUSTED'
          WHEN 3 THEN 'PROVIDER_UNAVAILABLE' ELSE 'PROVIDER_CONNECTION_FAILED' END END AS error_code,
        CASE event_id % 11 WHEN 0 THEN NULL WHEN 1 THEN '{bad' WHEN 2 THEN '{"unknown": true, "input_tokens": 4}' WHEN 3 THEN '{"input_tokens": null}'
          WHEN 4 THEN '{"input_tokens": ' || regexp_extract(props, '[0-9]+', 0) || ', "output_tokens": 5}'
          ELSE '{"input_tokens": ' || regexp_extract(props, '[0-9]+', 0) || ', "output_tokens": 3, "total_tokens": 99}' END AS usage,
        CASE event_id % 4 WHEN 0 THEN '{"model": "m1"}' WHEN 1 THEN '{oops' WHEN 2 THEN NULL ELSE '{"model": ""}' END AS own_profile,
        CASE WHEN user_id % 3 <> 0 THEN '{"model": "job-' || (user_id % 2) || '"}' END AS job_profile FROM events""",
    "v_targets": """SELECT book AS win, 'quote' AS kind, quote_id AS ref, turn AS position FROM outputs WHERE turn <> 5 UNION ALL SELECT book, 'gap', gap_id, turn FROM gaps WHERE turn <> 3
      UNION ALL SELECT DISTINCT book, 'scene', 's0', CAST(0 AS BIGINT) FROM outputs UNION ALL SELECT DISTINCT book, 'speaker', 'user', CAST(0 AS BIGINT) FROM outputs UNION ALL SELECT DISTINCT book, x.kind, 'c1', CAST(0 AS BIGINT) FROM outputs CROSS JOIN (SELECT 'character' AS kind UNION ALL SELECT 'declared') x
      UNION ALL SELECT book, 'evidence', e_prev, turn FROM outputs WHERE e_prev IS NOT NULL AND turn <> 2 AND book % 2 = 0""",
    "v_updates": """SELECT book AS win, turn AS i, CASE WHEN turn = 3 AND book % 4 = 0 THEN 'n1' WHEN turn = 4 THEN 's0' ELSE 'n' || turn END AS temp_ref, CASE WHEN turn = 4 THEN min(gap_id) OVER (PARTITION BY book) ELSE gap_id END AS after_gap,
        CASE WHEN turn = 3 AND book % 3 = 0 THEN min(right_id) OVER (PARTITION BY book) WHEN turn = 4 THEN 'q-none' ELSE right_id END AS starts_at FROM gaps WHERE turn IN (1, 3, 4)""",
    "v_decisions": """SELECT book AS win, turn AS i, gap_id AS gap, CASE WHEN turn IN (1, 2) THEN 'BREAK' ELSE 'CONTINUE' END AS decision FROM gaps UNION ALL SELECT book, turn + 100, gap_id, 'BREAK' FROM gaps WHERE turn = 0 AND book % 5 = 0""",
    "v_speakers": """SELECT book AS win, min(turn) AS i, CASE WHEN book % 7 = 0 THEN 'same' ELSE speaker END AS temp_ref, CASE book % 3 WHEN 0 THEN 's0' WHEN 1 THEN 'n1' ELSE 'n9' END AS scene, CASE WHEN book % 5 = 4 THEN 'q-none' ELSE min(CASE WHEN assignment = 'NEW' THEN quote_id END) END AS first_quote,
        CASE book % 4 WHEN 0 THEN 'c1' WHEN 1 THEN 'c9' ELSE '' END AS character, CASE book % 6 WHEN 0 THEN 'Anna' WHEN 1 THEN 'new1' WHEN 2 THEN 'S3' WHEN 3 THEN '悠太' WHEN 4 THEN CAST(NULL AS STRING) ELSE 'a，b' END AS name, CASE WHEN book % 5 = 1 THEN '悠太' WHEN book % 5 = 2 THEN 'S3' END AS real_name, book % 2 AS evidence
      FROM outputs GROUP BY book, speaker""",
    "v_labels": """SELECT book AS win, turn AS i, CASE WHEN k % 11 = 0 THEN 'q-none' ELSE quote_id END AS quote, CASE WHEN turn < 2 OR book % 3 = 0 THEN 's0' WHEN turn = 6 THEN 's-none' ELSE 'n1' END AS scene, CASE WHEN book % 7 = 0 AND turn = 2 THEN 'same' ELSE speaker END AS speaker, assignment, kind = 'speech' AS owned, e_prev AS cited FROM outputs WHERE turn <> 3
      UNION ALL SELECT book, turn + 50, quote_id, 's0', speaker, assignment, true, e_prev FROM outputs WHERE turn = 2""",
    "r_books": """SELECT book, CASE WHEN book % 6 <> 5 THEN max(end_cp) - CASE WHEN book % 4 = 1 THEN 20 ELSE 0 END END AS length_cp FROM segments GROUP BY book""",
    "r_scenes": """SELECT book, scene AS i, CASE WHEN scene = 2 AND book % 3 = 0 THEN 's1' ELSE 's' || scene END AS scene_id, CASE WHEN scene = 1 AND book % 8 = 2 THEN NULL ELSE start_cp END AS start_cp, end_cp FROM scenes""",
    "r_people": """SELECT DISTINCT book, CAST(floor(turn / 3) AS BIGINT) AS i, 'g-' || role AS label FROM segments WHERE turn % 7 <> 6""",
    "r_quotes": """SELECT book, turn AS i, CASE WHEN turn = 3 AND book % 2 = 0 THEN min(quote_id) OVER (PARTITION BY book) ELSE quote_id END AS quote_id, CASE WHEN turn = 4 AND book % 3 = 1 THEN end_cp ELSE start_cp END AS start_cp, end_cp,
        CASE k % 17 WHEN 16 THEN NULL WHEN 15 THEN 's99' ELSE 's' || CAST(floor(turn / 3) AS BIGINT) END AS scene_id, CASE WHEN k % 12 <> 11 THEN 'g-' || role END AS group_id, CASE WHEN k % 8 = 7 THEN false WHEN k % 8 < 6 THEN true END AS resolvable,
        CASE k % 5 WHEN 0 THEN 'thought' WHEN 1 THEN 'other' ELSE 'speech' END AS kind, start_cp + 1 AS f_start, end_cp + CASE WHEN k % 10 = 3 THEN 1 ELSE 0 END AS f_end, CASE WHEN k % 9 = 4 THEN -1 ELSE start_cp END AS e_start, end_cp AS e_end,
        CASE WHEN k % 7 <> 6 THEN start_cp - CASE WHEN k % 7 = 5 THEN 1 ELSE 0 END END AS visible_from_cp, CASE WHEN k % 13 = 12 THEN substring(quoted, 2) WHEN k % 13 <> 11 THEN quoted END AS body FROM numbered""",
    "r_gaps": """SELECT book, turn AS i, CASE WHEN turn = 2 AND book % 2 = 1 THEN min(gap_id) OVER (PARTITION BY book) ELSE gap_id END AS gap_id, CASE WHEN turn = 1 AND book % 3 = 2 THEN 'q-none' WHEN turn <> 0 THEN left_id END AS left_id, CASE WHEN turn = 1 AND book % 5 = 2 THEN 'q-none' ELSE right_id END AS right_id,
        start_cp AS m_start, end_cp + CASE WHEN turn % 5 = 4 THEN 3 ELSE 0 END AS m_end FROM gaps""",
    "k_targets": """SELECT book AS win, start_cp AS i, quote_id FROM outputs""",
    "k_labels": """SELECT book AS win, quote_id, kind, assignment, basis, CASE WHEN assignment <> 'UNKNOWN' THEN speaker END AS speaker, e_self, e_prev FROM outputs WHERE k % 14 <> 13""",
    "k_context": """SELECT o.book AS win, o.quote_id AS ref, t.seg AS text FROM outputs o JOIN told t ON t.book = o.book AND t.turn = o.turn WHERE o.k % 10 <> 9""",
    "k_people": """SELECT DISTINCT book AS win, 'c-' || speaker AS character_id, speaker AS existing_ref, speaker AS name, substring(speaker, 1, 4) || '忽' AS alias FROM outputs WHERE speaker <> 'system'""",
    "k_declared": """SELECT DISTINCT book AS win, speaker AS temp_ref, CASE WHEN book % 3 = 0 THEN 'c-' || speaker END AS character_id FROM outputs WHERE assignment = 'NEW' AND book % 2 = 0""",
    "k_requested": """SELECT book AS win, quote_id FROM outputs WHERE k % 15 = 4""",
    "c_annotations": """SELECT book, 'a' || substring(quote_id, 2, 12) AS id, quote_id, 1 + k % 3 AS version, k % 5 < 3 AS stale, k % 13 = 0 AS user_locked, CASE WHEN k % 7 = 6 THEN 'USER' ELSE 'MODEL' END AS source, speaker FROM outputs WHERE k % 19 <> 18""",
    "c_corrections": """SELECT book, 'c' || substring(quote_id, 2, 12) AS id, CASE k % 6 WHEN 0 THEN 'SCENE' WHEN 2 THEN 'ANNOTATION' ELSE 'QUOTE' END AS target_type,
        CASE k % 6 WHEN 0 THEN 's' || book || '-' || CAST(floor(turn / 3) AS BIGINT) WHEN 2 THEN CASE WHEN turn % 4 = 0 THEN 'a' || substring(quote_id, 2, 12) ELSE quote_id END ELSE quote_id END AS target_id,
        CASE WHEN k % 9 <> 8 THEN 1 + k % 4 END AS applied_version, CASE WHEN k % 10 = 3 THEN 'u' || k END AS undone_by, 'was-' || speaker AS speaker, start_cp AS at FROM outputs
      UNION ALL SELECT book, 'e' || substring(quote_id, 2, 12), 'QUOTE', quote_id, 2 + k % 3, NULL, 'then-' || speaker, end_cp FROM outputs WHERE k % 2 = 0
      UNION ALL SELECT book, 'd' || substring(gap_id, 2, 12), 'GAP', gap_id, 1, NULL, NULL, start_cp FROM gaps WHERE turn % 2 = 0""",
    "c_histories": """SELECT 'a' || substring(quote_id, 2, 12) AS annotation_id, CASE WHEN k % 2 = 0 THEN 1 + k % 3 ELSE k % 3 END AS revision, CASE WHEN k % 5 < 2 THEN 'c' || substring(quote_id, 2, 12) END AS correction_id FROM outputs WHERE k % 4 <> 3""",
    "c_items": """SELECT 'i' || substring(quote_id, 2, 12) AS item, quote_id, CASE WHEN k % 8 = 7 THEN 'LOW_CONFIDENCE' ELSE 'STALE_DEPENDENCY' END AS reason, CASE k % 10 WHEN 8 THEN 'RESOLVED' WHEN 9 THEN 'DEFERRED' ELSE 'PENDING' END AS status,
        1 + CASE WHEN k % 11 = 0 THEN k + 1 ELSE k END % 3 AS annotation_version, CASE k % 12 WHEN 0 THEN '{bad' WHEN 1 THEN '{"correction_id": 5}' WHEN 2 THEN NULL WHEN 3 THEN '{"correction_id": "c' || substring(quote_id, 2, 12) || '"}' ELSE '{"correction_id": "c' || substring(e_prev, 2, 12) || '"}' END AS candidates FROM outputs
      UNION ALL SELECT 'j' || substring(quote_id, 2, 12), quote_id, 'STALE_DEPENDENCY', 'PENDING', 1 + k % 3 + turn % 2, '{"correction_id": "e' || substring(e_prev, 2, 12) || '"}' FROM outputs WHERE k % 4 = 0""",
    "c_jobs": """SELECT DISTINCT book, CASE WHEN book % 9 = 8 THEN 'RUNNING' WHEN book % 9 = 4 THEN 'QUEUED' ELSE 'DONE' END AS state FROM outputs""",
    "o_jobs": """SELECT book, scene, 'j' || book || '-' || scene AS job, CASE scene % 4 WHEN 3 THEN 'CHARACTER_ROSTER' WHEN 2 THEN 'RECHECK' ELSE 'INFERENCE' END AS kind, CASE (book + scene) % 5 WHEN 0 THEN 'DONE' WHEN 1 THEN 'PAUSING' ELSE 'RUNNING' END AS state,
        CASE WHEN book % 7 = 6 THEN end_cp + 1 ELSE start_cp END AS start_cp, end_cp, CASE (book + scene) % 3 WHEN 0 THEN 'w' || scene || ',w' || (scene + 1) WHEN 1 THEN CASE WHEN book % 2 = 0 THEN 'w' || scene END END AS selected, scene % 2 AS chapter FROM scenes""",
    "o_windows": """SELECT 'j' || book || '-' || CAST(floor(turn / 3) AS BIGINT) AS job, 'w' || CAST(floor(turn / 3) AS BIGINT) AS win, quote_id FROM numbered WHERE k % 11 <> 5""",
    "o_plan": """SELECT j.job, 'w' || CAST(floor(q.turn / 3) AS BIGINT) AS win, q.quote_id FROM o_jobs j JOIN quotes q ON q.book = j.book WHERE j.book % 4 = 1 AND q.turn < 3 * j.scene + 6 AND q.turn >= 3 * j.scene""",
    "people": """SELECT c_custkey AS person, CAST(c_nationkey AS BIGINT) AS book,
        CASE c_custkey % 7 WHEN 0 THEN 'Anna' || (c_custkey % 20) WHEN 1 THEN ' anna' || (c_custkey % 20) || ' ' WHEN 2 THEN 'ANNA' || (c_custkey % 20) || '（旧）'
          WHEN 3 THEN 'S' || (c_custkey % 90) WHEN 4 THEN '女生' WHEN 5 THEN 'Anna' || (c_custkey % 20) || '老师' ELSE 'Bo, ' || (c_custkey % 9) END AS name,
        CASE WHEN c_custkey % 5 <> 0 THEN 'anna' || (c_custkey % 31) END AS alias, c_custkey * 37 % 1000 AS first_cp,
        CASE WHEN c_custkey % 4 = 0 THEN 'speaker' ELSE 'book' END AS kind,
        CASE WHEN c_custkey % 6 = 5 THEN NULL ELSE c_custkey % 12 END AS color, c_custkey % 11 = 0 AS locked FROM customer""",
    "facts": """SELECT person, book, first_cp * (v + 1) % 1000 AS visible_from_cp, v AS idx, CASE v % 3 WHEN 0 THEN trim(name) WHEN 1 THEN coalesce(alias, '') ELSE 'x' || (person % 3) END AS value,
        (person + v) % 4 <> 3 AS accepted, CASE WHEN v > 0 THEN first_cp * v % 700 END AS link_cp
      FROM people CROSS JOIN (SELECT 0 AS v UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) x""",
}


def _needs(name: str) -> list[str]:
    """name and what it is built from, the latter first."""
    out: list[str] = []
    for other in SQL:
        if other == name:
            break
        if re.search(rf"\b(FROM|JOIN) {other}\b", SQL[name]):
            out += [x for x in _needs(other) if x not in out]
    return [*out, name]


def with_sql(*names: str) -> str:
    """WITH these tables and what they are built from."""
    order: list[str] = []
    for name in names:
        order += [x for x in _needs(name) if x not in order]
    return "WITH " + ", ".join(f"{x} AS ({SQL[x]})" for x in order) + " "


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table of this name, over the given tables in sf_dir."""
    sql = f"{with_sql(name)} SELECT * FROM {name}"
    sql = sql.replace("{", "{{").replace("}", "}}")
    used = [t for t in GIVEN if re.search(rf"\b(FROM|JOIN) {t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})
