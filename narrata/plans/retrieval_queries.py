"""Attribution by rule and retrieval of evidence, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from narrata.operators import attribution, evidence
from narrata.plans.dialogue_queries import query
from narrata.sources.model import frame, with_sql

_VERBS = ", ".join(f"'{v}'" for v in attribution.VERBS)
_STOP = "'" + attribution.BOUNDARY.replace("'", "''") + "'"

#: Who says what: for each place of a verb, the name before it, by code points rather than by a pattern.
SAID = with_sql("told") + f""", q AS (SELECT book, turn, start_cp, start_cp + length(quoted) AS end_cp FROM told), whole AS (SELECT book, string_agg(seg, '' ORDER BY turn) AS body FROM told GROUP BY 1),
t AS (SELECT q.*, substring(body, CAST(end_cp AS BIGINT) + 1, 40) AS tail FROM q JOIN whole USING (book)),
v AS (SELECT book, turn, i, verb, tail, substring(tail, 1, CAST(i AS BIGINT)) AS before FROM t, range(1, 40) r(i), (SELECT unnest([{_VERBS}]) AS verb) WHERE i < length(tail) AND substring(tail, CAST(i AS BIGINT) + 1, length(verb)) = verb),
b AS (SELECT *, rtrim(before, {_STOP}) AS bare FROM v),
c AS (SELECT *, CASE WHEN length(bare) >= 6 THEN length(bare) - 6 ELSE greatest(0, length(before) + length(bare) - 6) END AS skip FROM b),
m AS (SELECT *, substring(bare, CAST(skip AS BIGINT) + 1, 6) AS name FROM c),
ok AS (SELECT * FROM m WHERE name <> '' AND length(translate(name, {_STOP}, '')) = length(name)),
won AS (SELECT book, turn, first(name ORDER BY i, verb) AS name, first(verb ORDER BY i, verb) AS verb FROM ok GROUP BY 1, 2),
g AS (SELECT *, CASE WHEN start_cp - max(end_cp) OVER (PARTITION BY book ORDER BY start_cp, end_cp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 200 THEN 1 ELSE 0 END AS new FROM q)
SELECT g.book, g.turn, 'b0-scene-' || CAST(sum(new) OVER (PARTITION BY g.book ORDER BY start_cp, end_cp) AS BIGINT) AS scene_key, name AS group_key, CASE WHEN name IS NULL THEN 'UNKNOWN' ELSE 'ACCEPTED' END AS status, verb AS evidence
FROM g LEFT JOIN won ON won.book = g.book AND won.turn = g.turn"""


@query(SAID)
def t16_attribution(s, d):
    """Scene, group, status and evidence of every quote by the rule baseline."""
    told = frame(s, d, "told")
    q = told.select("book", "turn", "start_cp", (F.col("start_cp") + F.length("quoted")).alias("end_cp"))
    return attribution.baseline(attribution.tails(told, q)).drop("start_cp", "end_cp")


#: Two tasks a book, of which one may see a part only; lines, and what is known of people.
CANDIDATES = with_sql("segments", "naming") + """, n AS (SELECT book, max(end_cp) AS n FROM segments GROUP BY 1),
tasks AS (SELECT book, 1 AS task, 1000 AS first, 1200 AS last, CAST(2200 AS BIGINT) AS horizon, ['system'] AS pinned FROM n UNION ALL SELECT book, 2, 300, 400, NULL, [] FROM n),
t AS (SELECT tasks.*, least(coalesce(horizon, n), n) AS lim, greatest(0, first - 500) AS a, least(least(coalesce(horizon, n), n), last + 500) AS b, n FROM tasks JOIN n USING (book)),
hit AS (SELECT DISTINCT t.book, t.task, f.person, s.start_cp, abs(s.start_cp - first) AS far, s.start_cp >= a AND s.start_cp < b AS inside FROM t JOIN naming f ON f.book = t.book AND f.visible_from_cp <= lim AND f.kind IN ('name', 'alias', 'designation')
  JOIN segments s ON s.book = t.book AND s.end_cp <= lim AND contains(s.seg, f.value)),
who AS (SELECT t.book, t.task, f.person, coalesce(arg_max(value, visible_from_cp) FILTER (kind = 'name'), arg_max(value, visible_from_cp)) AS name, any_value(n) AS n, bool_or(list_contains(pinned, f.person)) AS pinned
  FROM t JOIN naming f ON f.book = t.book AND f.visible_from_cp <= lim AND f.kind IN ('name', 'designation') GROUP BY 1, 2, 3),
r AS (SELECT w.book, w.task, w.person, w.name, w.pinned, coalesce(count(h.start_cp) FILTER (inside), 0) AS local, coalesce(min(far), any_value(w.n)) AS distance FROM who w LEFT JOIN hit h ON h.book = w.book AND h.task = w.task AND h.person = w.person GROUP BY 1, 2, 3, 4, 5),
k AS (SELECT *, row_number() OVER (PARTITION BY book, task ORDER BY pinned DESC, local DESC, distance, person) AS rank FROM r)
SELECT book, task, rank, person, name, pinned, local, distance FROM k WHERE pinned OR rank <= 8"""


@query(CANDIDATES)
def d44_candidates(s, d):
    """The people that tasks offer, by an index of names instead of a comparison of all people with all lines."""
    seg = frame(s, d, "segments")
    lines = seg.select("book", "start_cp", "end_cp", F.col("seg").alias("line"))
    books = seg.select("book").distinct()
    one = books.select("book", F.lit(1).alias("task"), F.lit(1000).cast("long").alias("first"), F.lit(1200).cast("long").alias("last"), F.lit(2200).cast("long").alias("horizon"), F.array(F.lit("system")).alias("pinned"))
    two = books.select("book", F.lit(2).alias("task"), F.lit(300).cast("long").alias("first"), F.lit(400).cast("long").alias("last"), F.lit(None).cast("long").alias("horizon"), F.array().cast("array<string>").alias("pinned"))
    return evidence.candidates(one.unionByName(two), frame(s, d, "naming"), lines)
