"""What becomes of stored corrections, annotations and review items, over derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from narrata.operators import corrections, occupancy
from narrata.operators.graph import settled
from narrata.plans.dialogue_queries import query
from narrata.sources.model import frame, with_sql

_BUSY = "EXISTS (SELECT 1 FROM c_jobs j WHERE j.book = {} AND j.state IN ('QUEUED', 'RUNNING', 'PAUSING'))"


def _of(s, d, name):
    return settled(frame(s, d, f"c_{name}"))


CLEANED = with_sql("c_annotations", "c_corrections", "c_histories", "c_items", "c_jobs") + f""", x AS (SELECT a.book, i.item, a.id AS annotation_id, a.version, a.stale, i.annotation_version AS v, {_BUSY.format("a.book")} AS busy,
  i.status = 'PENDING' AND NOT a.user_locked AND a.source = 'MODEL' AND NOT {_BUSY.format("a.book")}
  AND EXISTS (SELECT 1 FROM c_corrections c JOIN c_annotations t ON t.quote_id = c.target_id WHERE i.candidates LIKE '{{"correction_id": "%' AND c.id = substring(i.candidates, 20, length(i.candidates) - 21) AND c.target_type IN ('QUOTE', 'ANNOTATION') AND t.book = a.book AND c.target_id <> a.quote_id)
  AND NOT EXISTS (SELECT 1 FROM c_histories h JOIN c_corrections c ON c.id = h.correction_id WHERE h.annotation_id = a.id AND c.target_type IN ('SCENE', 'GAP')) AS fit
  FROM c_items i JOIN c_annotations a ON a.quote_id = i.quote_id WHERE i.reason = 'STALE_DEPENDENCY' AND i.status <> 'RESOLVED'),
y AS (SELECT *, min(item) FILTER (fit AND stale AND v = version) OVER (PARTITION BY annotation_id) AS first FROM x),
z AS (SELECT *, coalesce(item = first, false) AS restored, fit AND CASE WHEN stale THEN coalesce(item = first OR (item > first AND v = version + 1), false) ELSE v = version END AS done FROM y) """


@query(CLEANED + """SELECT book, item, annotation_id, CASE WHEN busy THEN 'refused' WHEN done THEN 'resolved' ELSE 'preserved' END AS verdict, restored, version + CASE WHEN restored THEN 1 ELSE 0 END AS version,
  restored AND NOT EXISTS (SELECT 1 FROM c_histories h WHERE h.annotation_id = z.annotation_id AND h.revision = z.version) AS written FROM z""")
def d33_cleanup(s, d):
    """Open items about stale annotations: which are resolved, what is restored, what the histories lack."""
    return corrections.cleaned(*[_of(s, d, n) for n in ("items", "annotations", "corrections", "histories", "jobs")])


@query(CLEANED + "SELECT book, max(busy) AS refused, count(*) FILTER (done) AS resolved_records, count(*) FILTER (NOT busy AND NOT done) AS preserved_records, count(*) FILTER (restored) AS restored_quotes FROM z GROUP BY 1")
def d33_cleanup_summary(s, d):
    return corrections.cleanup_summary(corrections.cleaned(*[_of(s, d, n) for n in ("items", "annotations", "corrections", "histories", "jobs")]))


@query("WITH RECURSIVE " + with_sql("c_annotations", "c_corrections").removeprefix("WITH ") + """, x AS (SELECT c.id, CASE WHEN target_type NOT IN ('QUOTE', 'ANNOTATION') THEN 'not_local' WHEN undone_by IS NOT NULL THEN 'already_undone' WHEN a.id IS NULL THEN 'no_annotation' END AS wrong, a.id AS annotation_id, a.version, c.applied_version, c.speaker, c."at" AS place
  FROM c_corrections c LEFT JOIN c_annotations a ON a.quote_id = c.target_id),
o AS (SELECT *, row_number() OVER (PARTITION BY annotation_id ORDER BY place, id) AS n FROM x WHERE wrong IS NULL),
f AS (SELECT id, annotation_id, n, coalesce(applied_version = version, true) AS ok, version + CASE WHEN coalesce(applied_version = version, true) THEN 1 ELSE 0 END AS now, speaker FROM o WHERE n = 1
  UNION ALL SELECT o.id, o.annotation_id, o.n, coalesce(o.applied_version = f.now, true), f.now + CASE WHEN coalesce(o.applied_version = f.now, true) THEN 1 ELSE 0 END, o.speaker FROM f JOIN o ON o.annotation_id = f.annotation_id AND o.n = f.n + 1)
SELECT id, CASE WHEN ok THEN 'undone' ELSE 'changed_since' END AS verdict, annotation_id, CASE WHEN ok THEN now END AS version, CASE WHEN ok THEN speaker END AS speaker FROM f UNION ALL SELECT id, wrong, annotation_id, NULL, NULL FROM x WHERE wrong IS NOT NULL""")
def x10_undone(s, d):
    """All corrections asked to be taken back: which can be, and what their annotations are then."""
    c = _of(s, d, "corrections")
    return corrections.undone(c, c, _of(s, d, "annotations"))


@query(with_sql("c_annotations", "c_corrections", "c_jobs", "quotes", "gaps", "scenes") + f""", gone AS (SELECT DISTINCT book FROM quotes q WHERE book % 3 <> 1 AND NOT {_BUSY.format("q.book")}),
t AS (SELECT book, quote_id AS id FROM quotes UNION ALL SELECT book, gap_id FROM gaps UNION ALL SELECT book, 's' || book || '-' || scene FROM scenes UNION ALL SELECT book, id FROM c_annotations)
SELECT c.id, min(t.book) AS book FROM c_corrections c JOIN t ON t.id = c.target_id JOIN gone ON gone.book = t.book GROUP BY 1""")
def x30_deleted_corrections(s, d):
    """The corrections that go with two books of three: of their quotes, gaps, scenes and annotations."""
    quotes = settled(frame(s, d, "quotes")).select("book", F.col("quote_id").alias("id"))
    scenes = frame(s, d, "scenes").select("book", F.concat(F.lit("s"), F.col("book").cast("string"), F.lit("-"), F.col("scene").cast("string")).alias("id"))
    held = {"quotes": quotes, "gaps": frame(s, d, "gaps").select("book", F.col("gap_id").alias("id")), "scenes": scenes, "annotations": _of(s, d, "annotations").select("book", "id")}
    return corrections.deleted(quotes.filter("book % 3 <> 1"), _of(s, d, "jobs"), _of(s, d, "corrections"), **held)[1]


@query(with_sql("o_jobs", "o_windows", "o_plan", "segments", "quotes") + """, n AS (SELECT book, max(end_cp) AS length_cp FROM segments GROUP BY 1), c AS (SELECT job, book, unnest(string_split(selected, ',')) AS win FROM o_jobs),
k AS (SELECT c.*, EXISTS (SELECT 1 FROM o_windows w WHERE w.job = c.job AND w.win = c.win) AS stored, EXISTS (SELECT 1 FROM o_plan p WHERE p.job = c.job AND p.win = c.win) AS planned FROM c),
l AS (SELECT job, min(CASE WHEN stored OR planned THEN 1 ELSE 0 END) = 0 AS lost FROM k GROUP BY 1),
b AS (SELECT j.*, CASE WHEN start_cp <= end_cp THEN start_cp ELSE 0 END AS a, CASE WHEN start_cp <= end_cp THEN end_cp ELSE length_cp END AS z FROM o_jobs j JOIN n ON n.book = j.book),
r AS (SELECT k.job, book, quote_id FROM k JOIN o_windows w ON w.job = k.job AND w.win = k.win UNION SELECT k.job, book, quote_id FROM k JOIN l ON l.job = k.job AND NOT l.lost JOIN o_plan p ON p.job = k.job AND p.win = k.win WHERE NOT stored
  UNION SELECT b.job, b.book, q.quote_id FROM b LEFT JOIN l ON l.job = b.job JOIN quotes q ON q.book = b.book AND q.start_cp >= a AND q.start_cp < z WHERE selected IS NULL OR l.lost)
SELECT x.job AS request, min(y.job) AS met FROM o_jobs x LEFT JOIN o_jobs y ON y.book = x.book AND y.job <> x.job AND y.state <> 'DONE' AND ((x.kind = 'CHARACTER_ROSTER' AND y.kind = 'CHARACTER_ROSTER' AND x.chapter = y.chapter)
  OR (x.kind <> 'CHARACTER_ROSTER' AND y.kind <> 'CHARACTER_ROSTER' AND EXISTS (SELECT 1 FROM r p JOIN r q ON q.quote_id = p.quote_id AND q.book = p.book WHERE p.job = x.job AND q.job = y.job))) GROUP BY 1""")
def j15_admitted(s, d):
    """Every job asked to go on: the least other job under way on one of its quotes, or on its chapter's people."""
    of = lambda n: settled(frame(s, d, n))
    jobs = of("o_jobs").withColumn("selected", F.split("selected", ","))
    asked = jobs.select(F.concat(F.lit("r"), "job").alias("request"), F.col("job").alias("own"), *[c for c in jobs.columns if c != "job"])
    quotes = of("quotes").select("book", "quote_id", "start_cp", F.lit(0).alias("depth"))
    lengths = frame(s, d, "segments").groupBy("book").agg(F.max("end_cp").alias("length_cp"))
    return occupancy.admitted(asked, jobs, of("o_windows"), of("o_plan"), quotes, lengths).select(F.substring("request", F.lit(2), F.length("request")).alias("request"), "met")
