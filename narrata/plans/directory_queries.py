"""Rosters, merges, repairs and restores, each with the SQL that says the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrata.functions import digests, names
from narrata.operators import decisions, evidence, graph, intervals, markup, text
from narrata.plans.dialogue_queries import n, query
from narrata.plans.identity_queries import KEY, MERGE
from narrata.plans.text_queries import MADE
from narrata.sources import archives
from narrata.sources.dialogue import table
from narrata.sources.model import frame, with_sql

REVERTS = with_sql("facts").replace("WITH ", "WITH RECURSIVE ", 1) + ", rv AS (SELECT person, idx, 'g' || person || '-' || (idx + 1) AS new, 'g' || person || '-' || idx AS old FROM facts WHERE visible_from_cp > 250), ch AS (SELECT new AS node, old AS fin FROM rv UNION ALL SELECT ch.node, rv.old FROM ch JOIN rv ON rv.new = ch.fin) "


@query(REVERTS + "SELECT node, min_by(fin, length(fin) * 0 + CAST(string_split(fin, '-')[2] AS INT)) AS fin FROM ch GROUP BY 1")
def d17_horizon_reverts(s, d):
    """Groups as they were before the revisions that a position doesn't see yet."""
    name = lambda i: F.concat(F.lit("g"), F.col("person").cast("string"), F.lit("-"), i.cast("string"))
    rv = frame(s, d, "facts").filter("visible_from_cp > 250").select(name(F.col("idx") + 1).alias("node"), name(F.col("idx")).alias("target"))
    return graph.resolved(rv).withColumnRenamed("end", "fin")


@query(MERGE + "SELECT p.person, m.target, p.locked, CASE WHEN NOT p.locked AND m.target <> p.person THEN m.target ELSE p.person END AS owner, CASE WHEN NOT p.locked AND m.target <> p.person THEN p.person END AS revert FROM people p JOIN m ON m.person = p.person")
def x16_merge_apply(s, d):
    """Merged identities own what was not locked; what they had is kept for going back."""
    p = frame(s, d, "people")
    target = F.min("person").over(Window.partitionBy("book", names.key(names.undecorated(F.col("name")))))
    p = p.withColumn("target", target)
    moves = ~F.col("locked") & (F.col("target") != F.col("person"))
    return p.select("person", "target", "locked", F.when(moves, F.col("target")).otherwise(F.col("person")).alias("owner"), F.when(moves, F.col("person")).alias("revert"))


@query(MERGE + """SELECT book, target, array_to_string(list_sort(list(DISTINCT trim(name))), '|') AS aliases, count(*) AS merged, bool_or(locked) AS locked FROM (SELECT p.*, m.target FROM people p JOIN m ON m.person = p.person) GROUP BY 1, 2""")
def d24_merged_directory(s, d):
    """The directory after a merge: a row for each that is left, with all names that it had."""
    p = frame(s, d, "people")
    p = p.withColumn("target", F.min("person").over(Window.partitionBy("book", names.key(names.undecorated(F.col("name"))))))
    return p.groupBy("book", "target").agg(F.array_join(F.sort_array(F.collect_set(F.trim("name"))), "|").alias("aliases"), n("merged"), F.max("locked").alias("locked"))


ROSTER = with_sql("people") + f""", c AS (SELECT book, lower('anna' || (person % 40)) AS key, person % 9 = 0 AS pov, person AS evidence FROM people), h AS (SELECT DISTINCT book, person, {KEY.format('name')} AS key FROM people),
m AS (SELECT book, key, count(DISTINCT person) AS c, min(person) AS person FROM h GROUP BY 1, 2) """


@query(ROSTER + """SELECT c.book, c.key, CASE WHEN max(m.c) = 1 THEN max(m.person) END AS person, bool_or(c.pov) AS pov, string_agg(CAST(c.evidence AS STRING), ',' ORDER BY c.evidence) AS evidence, count(*) AS candidates, coalesce(max(m.c), 0) > 1 AS ambiguous
FROM c LEFT JOIN m ON m.book = c.book AND m.key = c.key GROUP BY 1, 2""")
def d25_roster_candidates(s, d):
    """Candidates that are the same are one: its person if just one has the name, any point of view, all evidence."""
    p = frame(s, d, "people")
    c = p.select("book", F.concat(F.lit("anna"), (F.col("person") % 40).cast("string")).alias("key"), (F.col("person") % 9 == 0).alias("pov"), F.col("person").alias("evidence"))
    have = p.select("book", names.key(names.undecorated(F.col("name"))).alias("key"), F.col("person").alias("owner")).groupBy("book", "key").agg(F.count_distinct("owner").alias("c"), F.min("owner").alias("owner"))
    proof = F.array_join(F.transform(F.sort_array(F.collect_list("evidence")), lambda x: x.cast("string")), ",")
    merged = c.groupBy("book", "key").agg(F.max("pov").alias("pov"), proof.alias("evidence"), n("candidates"))
    return merged.join(have, ["book", "key"], "left").select("book", "key", F.when(F.col("c") == 1, F.col("owner")).alias("person"), "pov", "evidence", "candidates", (F.coalesce("c", F.lit(0)) > 1).alias("ambiguous"))


@query(with_sql("segments") + """, f AS (SELECT book, turn, CASE WHEN turn % 4 = 3 THEN 'no such words' ELSE substring(quoted, 2, 12) END AS value, CASE WHEN turn % 5 = 4 THEN turn - 1 ELSE turn END AS cited FROM segments)
SELECT f.book, f.turn, l.turn IS NOT NULL AND contains(l.seg, f.value) AND length(trim(f.value)) > 0 AS proven, CASE WHEN l.turn IS NOT NULL AND contains(l.seg, f.value) AND length(trim(f.value)) > 0 THEN l.end_cp END AS visible_from_cp FROM f LEFT JOIN segments l ON l.book = f.book AND l.turn = f.cited""")
def d26_sourced_facts(s, d):
    """A fact counts only if it stands in the lines that it cites, and from their end on."""
    t = F.col("turn")
    seg = frame(s, d, "segments")
    f = seg.select("book", "turn", F.when(t % 4 == 3, "no such words").otherwise(F.substring("quoted", 2, 12)).alias("value"), F.when(t % 5 == 4, t - 1).otherwise(t).alias("cited"))
    both = f.join(seg.select("book", F.col("turn").alias("cited"), "seg", "end_cp"), ["book", "cited"], "left")
    ok = F.coalesce(F.contains("seg", F.col("value")), F.lit(False)) & (F.trim("value") != "")
    return both.select("book", "turn", ok.alias("proven"), F.when(ok, F.col("end_cp")).alias("visible_from_cp"))


@query(with_sql("segments") + """, p AS (SELECT DISTINCT book, role AS name FROM segments), m AS (SELECT p.book, p.name, s.start_cp, s.end_cp FROM p JOIN segments s ON s.book = p.book AND s.end_cp <= 2200 AND contains(s.seg, p.name)),
r AS (SELECT p.book, p.name, count(m.start_cp) FILTER (m.start_cp >= 500 AND m.start_cp < 1700) AS local, coalesce(min(abs(m.start_cp - 1000)), 99999) AS distance FROM p LEFT JOIN m ON m.book = p.book AND m.name = p.name GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY book ORDER BY local DESC, distance, name) AS rank FROM r""")
def d44_mention_ranking(s, d):
    """Candidates for a range by how often its surroundings name them, and how near, up to a position."""
    seg = frame(s, d, "segments")
    people = seg.select("book", F.col("role").alias("name")).distinct()
    facts = people.select("book", F.col("name").alias("person"), F.lit("name").alias("kind"), F.col("name").alias("value"), F.lit(0).cast("long").alias("visible_from_cp"))
    met = evidence.postings(facts, seg.filter("end_cp <= 2200").select("book", "start_cp", "end_cp", F.col("seg").alias("line"))).withColumnRenamed("person", "name")
    got = met.groupBy("book", "name").agg(F.count_if(F.col("start_cp").between(500, 1699)).alias("local"), F.min(F.abs(F.col("start_cp") - 1000)).alias("distance"))
    r = people.join(got, ["book", "name"], "left").select("book", "name", F.coalesce("local", F.lit(0)).alias("local"), F.coalesce("distance", F.lit(99999)).alias("distance"))
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("book").orderBy(F.desc("local"), "distance", "name")))


@query(with_sql("outputs") + """, t AS (SELECT quote_id, 'retry' AS speaker FROM outputs WHERE k % 6 <> 5) SELECT o.quote_id, CASE WHEN o.k % 4 = 1 THEN t.speaker ELSE o.speaker END AS speaker, CASE WHEN o.k % 4 <> 1 THEN 'kept' WHEN t.quote_id IS NULL THEN 'failed' ELSE 'retried' END AS origin FROM outputs o LEFT JOIN t ON t.quote_id = o.quote_id""")
def d50_partial_retry(s, d):
    """Valid rows stay; only rows that failed take the second answer, if there is one."""
    o = frame(s, d, "outputs")
    again = o.filter("k % 6 <> 5").select("quote_id", F.lit("retry").alias("second"))
    failed = F.col("k") % 4 == 1
    origin = F.when(~failed, "kept").when(F.col("second").isNull(), "failed").otherwise("retried")
    return o.join(again, "quote_id", "left").select("quote_id", F.when(failed, F.col("second")).otherwise(F.col("speaker")).alias("speaker"), origin.alias("origin"))


@query(with_sql("outputs") + """, c AS (SELECT book, quote_id, speaker, k, start_cp, k % 7 = 2 AS undeclared FROM outputs), o AS (SELECT book, count(DISTINCT speaker) AS many, min(speaker) AS only FROM outputs WHERE k % 7 <> 2 GROUP BY 1)
SELECT c.quote_id, CASE WHEN NOT undeclared THEN c.speaker WHEN o.many = 1 THEN o.only END AS speaker, undeclared AND coalesce(o.many = 1, false) AS repaired FROM c LEFT JOIN o ON o.book = c.book""")
def d14_undeclared_speakers(s, d):
    """A reference that nothing declares becomes the only declared speaker, or unknown where there are more."""
    o = frame(s, d, "outputs")
    declared = o.filter("k % 7 <> 2").groupBy("book").agg(F.count_distinct("speaker").alias("many"), F.min("speaker").alias("only"))
    missing, sure = F.col("k") % 7 == 2, F.coalesce(F.col("many") == 1, F.lit(False))
    return o.join(declared, "book", "left").select("quote_id", F.when(~missing, F.col("speaker")).when(sure, F.col("only")).alias("speaker"), (missing & sure).alias("repaired"))


@query(with_sql("outputs") + """, r AS (SELECT book, CAST(floor(turn / 3) AS BIGINT) AS response, 'new' || (k % 2) AS ref, CASE WHEN k % 4 < 2 THEN 'c' || (k % 3) END AS person, start_cp FROM outputs WHERE assignment <> 'UNKNOWN'),
g AS (SELECT book, response, ref, min(person) AS person, min(start_cp) AS first FROM r GROUP BY 1, 2, 3), k AS (SELECT *, min(first) OVER (PARTITION BY book, coalesce(person, response || ':' || ref)) AS lead FROM g)
SELECT book, response, ref, 'S' || dense_rank() OVER (PARTITION BY book ORDER BY lead) AS label FROM k""")
def d15_speaker_registry(s, d):
    """References hold within one response; those of one person share a slot, and slots are labelled by who came first."""
    k = F.col("k")
    r = frame(s, d, "outputs").filter("assignment <> 'UNKNOWN'").select("book", F.floor(F.col("turn") / 3).alias("response"), F.concat(F.lit("new"), (k % 2).cast("string")).alias("ref"), F.when(k % 4 < 2, F.concat(F.lit("c"), (k % 3).cast("string"))).alias("person"), "start_cp")
    g = r.groupBy("book", "response", "ref").agg(F.min("person").alias("person"), F.min("start_cp").alias("first"))
    slot = F.coalesce("person", F.concat_ws(":", F.col("response").cast("string"), "ref"))
    g = g.withColumn("lead", F.min("first").over(Window.partitionBy("book", slot)))
    return g.select("book", "response", "ref", F.concat(F.lit("S"), F.dense_rank().over(Window.partitionBy("book").orderBy("lead")).cast("string")).alias("label"))


@query(with_sql("segments") + """, f AS (SELECT book, turn, CASE WHEN turn = 3 THEN start_cp - 5 ELSE start_cp END AS a, CASE WHEN turn = 4 THEN end_cp - 2 ELSE end_cp END AS b FROM segments), w AS (SELECT book, max(end_cp) AS len FROM segments GROUP BY 1), o AS (SELECT *, lag(b) OVER (PARTITION BY book ORDER BY turn) AS was, lead(turn) OVER (PARTITION BY book ORDER BY turn) AS nxt FROM f)
SELECT o.book, o.turn, CASE WHEN a < coalesce(was, 0) THEN 'overlap' WHEN a > coalesce(was, 0) THEN 'hole' WHEN nxt IS NULL AND b <> len THEN 'short' ELSE 'fits' END AS verdict FROM o JOIN w ON w.book = o.book""")
def d6_partition_checks(s, d):
    """Whether fragments in order make up a range without holes or overlaps."""
    t = F.col("turn")
    f = frame(s, d, "segments").select("book", "turn", F.when(t == 3, F.col("start_cp") - 5).otherwise(F.col("start_cp")).alias("a"), F.when(t == 4, F.col("end_cp") - 2).otherwise(F.col("end_cp")).alias("b"), F.max("end_cp").over(Window.partitionBy("book")).alias("len"))
    w = Window.partitionBy("book").orderBy("turn")
    was = F.coalesce(F.lag("b").over(w), F.lit(0))
    f = f.withColumns({"was": was, "nxt": F.lead("turn").over(w)})
    verdict = F.when(F.col("a") < F.col("was"), "overlap").when(F.col("a") > F.col("was"), "hole").when(F.col("nxt").isNull() & (F.col("b") != F.col("len")), "short").otherwise("fits")
    return f.select("book", "turn", verdict.alias("verdict"))


@query(with_sql("outputs", "annotations") + """, o AS (SELECT quote_id, speaker, kind FROM outputs WHERE k % 5 <> 1) SELECT coalesce(a.quote_id, o.quote_id) AS quote_id, coalesce(o.kind, a.kind) AS kind, coalesce(a.turn % 3, 0) + CASE WHEN o.quote_id IS NOT NULL THEN 1 ELSE 0 END AS version, a.quote_id IS NOT NULL AND o.quote_id IS NOT NULL AS history, coalesce(a.stale, false) AND o.quote_id IS NULL AS stale
FROM (SELECT * FROM annotations WHERE turn <> 2) a FULL JOIN o ON o.quote_id = a.quote_id""")
def x15_annotation_upsert(s, d):
    """New labels replace stored ones, which go to the history; versions count up and nothing new is stale."""
    o = frame(s, d, "outputs").filter("k % 5 <> 1").select("quote_id", F.col("kind").alias("k2"), F.lit(1).alias("new"))
    a = frame(s, d, "annotations").filter("turn <> 2").select("quote_id", "kind", "stale", (F.col("turn") % 3).alias("v"), F.lit(1).alias("old"))
    both = a.join(o, "quote_id", "full")
    new = F.col("new").isNotNull()
    return both.select("quote_id", F.coalesce("k2", "kind").alias("kind"), (F.coalesce("v", F.lit(0)) + new.cast("int")).alias("version"), (new & F.col("old").isNotNull()).alias("history"), (F.coalesce("stale", F.lit(False)) & ~new).alias("stale"))


@query(with_sql("outputs", "runs") + """, u AS (SELECT quote_id, k, speaker FROM outputs WHERE assignment = 'UNKNOWN' OR basis = 'STYLE_ONLY'), r AS (SELECT run, created_at, run % 97 AS k FROM runs WHERE state = 'SUCCEEDED'), l AS (SELECT u.quote_id, u.speaker, max_by(r.run, (r.created_at, r.run)) AS run FROM u JOIN r ON r.k = u.k % 97 GROUP BY 1, 2)
SELECT quote_id, speaker, run, run % 2 = 0 AS accepted FROM l""")
def x17_offline_repair(s, d):
    """Unknown quotes take the latest answer that was stored for them, if its evidence is still the same."""
    u = frame(s, d, "outputs").filter("assignment = 'UNKNOWN' OR basis = 'STYLE_ONLY'").select("quote_id", "speaker", (F.col("k") % 97).alias("j"))
    r = frame(s, d, "runs").filter("state = 'SUCCEEDED'").select("run", "created_at", (F.col("run") % 97).alias("j"))
    latest = r.groupBy("j").agg(F.max_by("run", F.struct("created_at", "run")).alias("run"))
    return u.join(latest, "j").select("quote_id", "speaker", "run", (F.col("run") % 2 == 0).alias("accepted"))


@query(with_sql("outputs") + """, g AS (SELECT book, CAST(floor(turn / 3) AS BIGINT) AS scene, speaker, min((start_cp, quote_id)) AS f, count(*) AS quotes, max(end_cp) AS last FROM outputs GROUP BY 1, 2, 3)
SELECT book, scene, string_agg(speaker, ',' ORDER BY f) AS participants, CAST(sum(quotes) AS BIGINT) AS quotes, max(greatest(last, 400)) AS history_cp FROM g GROUP BY 1, 2""")
def x19_scene_states(s, d):
    """The participants of every scene, as they came, and where its history stands."""
    g = frame(s, d, "outputs").groupBy("book", F.floor(F.col("turn") / 3).alias("scene"), "speaker").agg(F.min(F.struct("start_cp", "quote_id")).alias("f"), n("quotes"), F.max("end_cp").alias("last"))
    order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "speaker"))), lambda x: x["speaker"]), ",")
    return g.groupBy("book", "scene").agg(order.alias("participants"), F.sum("quotes").alias("quotes"), F.max(F.greatest("last", F.lit(400))).alias("history_cp"))


CATALOG = with_sql("facts").replace("WITH ", "WITH RECURSIVE ", 1) + """, f AS (SELECT DISTINCT person, idx % 2 AS kind, value, length(value) + 3 * idx AS cost, visible_from_cp AS at_cp FROM facts WHERE value <> ''), o AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY kind DESC, at_cp DESC, value, cost) AS i FROM f),
r AS (SELECT person, i, cost <= 14 AS taken, CASE WHEN cost <= 14 THEN cost ELSE 0 END AS used, CASE WHEN cost <= 14 THEN 1 ELSE 0 END AS c FROM o WHERE i = 1 UNION ALL SELECT o.person, o.i, r.used + o.cost <= 14 AND r.c < 2, r.used + CASE WHEN r.used + o.cost <= 14 AND r.c < 2 THEN o.cost ELSE 0 END, r.c + CASE WHEN r.used + o.cost <= 14 AND r.c < 2 THEN 1 ELSE 0 END FROM r JOIN o ON o.person = r.person AND o.i = r.i + 1) """


@query(CATALOG + "SELECT o.person, o.value, o.cost FROM o JOIN r ON r.person = o.person AND r.i = o.i WHERE r.taken")
def x21_catalog_compaction(s, d):
    """Facts in order of weight while they fit a budget of tokens and a count; one that is too big is passed over."""
    f = frame(s, d, "facts").filter("value <> ''").select("person", (F.col("idx") % 2).alias("kind"), "value", (F.length("value") + 3 * F.col("idx")).alias("cost"), "visible_from_cp").distinct()
    order = F.array_sort(F.collect_list(F.struct((-F.col("kind")).alias("a"), (-F.col("visible_from_cp")).alias("b"), "value", "cost")))
    none = F.array().cast("array<struct<value:string,cost:int>>")

    def take(held, x):
        fits = (held["used"] + x["cost"] <= 14) & (F.size(held["kept"]) < 2)
        more = F.array(F.struct(x["value"].alias("value"), x["cost"].cast("int").alias("cost")))
        return F.struct(F.when(fits, held["used"] + x["cost"]).otherwise(held["used"]).cast("int").alias("used"), F.when(fits, F.concat(held["kept"], more)).otherwise(held["kept"]).alias("kept"))

    g = f.groupBy("person").agg(order.alias("rows"))
    kept = F.aggregate("rows", F.struct(F.lit(0).alias("used"), none.alias("kept")), take)["kept"]
    return g.select("person", F.explode(kept).alias("x")).select("person", "x.value", "x.cost")


@query(with_sql("facts") + """, f AS (SELECT *, sha256(person || '|' || idx || '|' || value) AS digest, (person + idx) % 8 = 7 AS tampered FROM facts), h AS (SELECT DISTINCT person, idx FROM facts WHERE idx = 0)
SELECT person, idx, CASE WHEN tampered THEN 'bad_digest' WHEN visible_from_cp > 900 THEN 'out_of_range' WHEN idx = 0 THEN 'known' ELSE 'appended' END AS outcome FROM f""")
def x22_identity_ledger(s, d):
    """Records are only ever appended: what is known stays, and what fails its digest or the text's bounds is refused."""
    f = frame(s, d, "facts")
    own = F.sha2(F.concat_ws("|", F.col("person").cast("string"), F.col("idx").cast("string"), "value").cast("binary"), 256)
    told = F.when((F.col("person") + F.col("idx")) % 8 == 7, "tampered").otherwise(own)
    known = f.filter("idx = 0").select("person", "idx", F.lit(True).alias("known"))
    outcome = F.when(told != own, "bad_digest").when(F.col("visible_from_cp") > 900, "out_of_range").when(F.col("known"), "known").otherwise("appended")
    return f.join(known, ["person", "idx"], "left").select("person", "idx", outcome.alias("outcome"))


@query(with_sql("people", "facts") + """, b AS (SELECT person, bool_and(visible_from_cp <= 800 AND value IS NOT NULL) AS good, count(*) AS c FROM facts GROUP BY 1), k AS (SELECT p.person, p.book, 'id' || (person % 60) AS ident FROM people p), d AS (SELECT book, ident FROM k GROUP BY 1, 2 HAVING count(*) > 1)
SELECT k.person, NOT EXISTS (SELECT 1 FROM d WHERE d.book = k.book AND d.ident = k.ident) AND b.good AS restored, CASE WHEN NOT EXISTS (SELECT 1 FROM d WHERE d.book = k.book AND d.ident = k.ident) AND b.good THEN b.c ELSE 0 END AS records FROM k JOIN b ON b.person = k.person""")
def x24_identity_restore(s, d):
    """People are restored whole or not at all, and not where two of a book have one identity."""
    b = frame(s, d, "facts").groupBy("person").agg(F.min((F.col("visible_from_cp") <= 800) & F.col("value").isNotNull()).alias("good"), n("c"))
    k = frame(s, d, "people").select("person", "book", F.concat(F.lit("id"), (F.col("person") % 60).cast("string")).alias("ident"))
    k = k.withColumn("alone", F.count(F.lit(1)).over(Window.partitionBy("book", "ident")) == 1).join(b, "person")
    ok = F.col("alone") & F.col("good")
    return k.select("person", ok.alias("restored"), F.when(ok, F.col("c")).otherwise(0).alias("records"))


@query(with_sql("people") + """, l AS (SELECT person, person % 50 AS chapter, 'S' || (person % 3) AS label FROM people) SELECT person, label || CASE WHEN row_number() OVER w > 1 THEN '·' || row_number() OVER w ELSE '' END AS label, true AS user_locked, 0 AS visible_from_cp FROM l WINDOW w AS (PARTITION BY chapter, label ORDER BY person)""")
def x25_restored_labels(s, d):
    """Labels of a chapter that occur again get a number; what is imported is locked and visible from the start."""
    l = frame(s, d, "people").select("person", (F.col("person") % 50).alias("chapter"), F.concat(F.lit("S"), (F.col("person") % 3).cast("string")).alias("label"))  # noqa: E741
    k = F.row_number().over(Window.partitionBy("chapter", "label").orderBy("person"))
    return l.withColumn("k", k).select("person", F.when(F.col("k") > 1, F.concat_ws("·", "label", F.col("k").cast("string"))).otherwise(F.col("label")).alias("label"), F.lit(True).alias("user_locked"), F.lit(0).alias("visible_from_cp"))


@query("""WITH r AS (SELECT page_id, page_id % 4 = 0 AS has_property, page_id % 3 = 0 AS has_meta, regexp_extract(html, 'src="([^"]+)"', 1) AS guide FROM pages) SELECT page_id, CASE WHEN has_property THEN 'property' WHEN has_meta THEN 'meta' WHEN guide <> '' THEN 'guide:' || guide END AS cover FROM r""")
def x29_cover(s, d):
    """A cover by its property, else by the metadata, else the first image that is referred to."""
    guide = F.regexp_extract("html", 'src="([^"]+)"', 1)
    return table(s, d, "pages").select("page_id", F.coalesce(F.when(F.col("page_id") % 4 == 0, "property"), F.when(F.col("page_id") % 3 == 0, "meta"), F.when(guide != "", F.concat(F.lit("guide:"), guide))).alias("cover"))


@query(with_sql("runs") + """, a AS (SELECT DISTINCT job, run % 50 AS target FROM runs WHERE state = 'DISPATCHED'), p AS (SELECT DISTINCT job FROM runs WHERE state = 'UNKNOWN_OUTCOME'), t AS (SELECT DISTINCT job, run % 50 AS target FROM runs WHERE state = 'UNKNOWN_OUTCOME' AND run % 10 = 2)
SELECT p.job, NOT EXISTS (SELECT 1 FROM t JOIN a ON a.target = t.target AND a.job <> t.job WHERE t.job = p.job) AS admitted FROM p""")
def x33_resume_admission(s, d):
    """A job may go on if none of its targets is another job's, its own aside."""
    r = frame(s, d, "runs")
    active = r.filter("state = 'DISPATCHED'").select(F.col("job").alias("other"), (F.col("run") % 50).alias("target")).distinct()
    paused = r.filter("state = 'UNKNOWN_OUTCOME'")
    mine = paused.filter("run % 10 = 2").select("job", (F.col("run") % 50).alias("target")).distinct()
    # Another job than one's own is there if the first or the last of a target's jobs is another.
    held = active.groupBy("target").agg(F.min("other").alias("first"), F.max("other").alias("last"))
    taken = mine.join(held, "target").filter("first <> job OR last <> job").select("job").distinct().withColumn("taken", F.lit(True))
    return paused.select("job").distinct().join(taken, "job", "left").select("job", F.col("taken").isNull().alias("admitted"))


@query(MADE + """SELECT book, 'quote' AS kind, quote_id AS id, start_cp, end_cp, depth FROM kept UNION ALL SELECT book, 'gap', 'g' || substring(sha1(book || '|' || end_cp || '|' || next_cp || '|scanner-1'), 1, 31), end_cp, next_cp, NULL FROM tops WHERE next_cp > end_cp AND NOT (turn % 4 = 3 AND next_turn = turn + 1)""")
def x36_gold_template(s, d):
    """What a scan finds, laid out to be labelled: quotes and the gaps between them."""
    whole = text.whole_texts(frame(s, d, "story"))
    q = text.scan_quotes(whole)
    g = text.narration_gaps(whole, q)
    quotes = q.select("book", F.lit("quote").alias("kind"), F.col("quote_id").alias("id"), "start_cp", "end_cp", "depth")
    return quotes.unionByName(g.select("book", F.lit("gap").alias("kind"), F.col("gap_id").alias("id"), "start_cp", "end_cp", F.lit(None).cast("int").alias("depth")))


@query(with_sql("outputs") + """, w AS (SELECT book, CAST(floor(turn / 3) AS BIGINT) AS win, max_by(speaker, start_cp) AS last, max(start_cp) AS at_cp, count(DISTINCT speaker) AS slots FROM outputs GROUP BY 1, 2) SELECT book, win, lag(last) OVER o AS carried, lag(slots) OVER o AS slots, coalesce(lag(last) OVER o <> last, false) AS changed FROM w WINDOW o AS (PARTITION BY book ORDER BY win)""")
def x40_scene_continuation(s, d):
    """What a window carries from the one before: its last speaker and how many slots it had."""
    w = frame(s, d, "outputs").groupBy("book", F.floor(F.col("turn") / 3).alias("win")).agg(F.max_by("speaker", "start_cp").alias("last"), F.count_distinct("speaker").alias("s"))
    o = Window.partitionBy("book").orderBy("win")
    carried = F.lag("last").over(o)
    return w.select("book", "win", carried.alias("carried"), F.lag("s").over(o).alias("slots"), F.coalesce(carried != F.col("last"), F.lit(False)).alias("changed"))


@query(with_sql("outputs", "quotes") + """, w AS (SELECT book, CAST(floor(turn / 3) AS BIGINT) AS win, min(start_cp) AS a, max(end_cp) AS b FROM outputs GROUP BY 1, 2) SELECT w.book, w.win, count(DISTINCT q.quote_id) AS refs, min(q.start_cp) AS start_cp, max(q.end_cp) AS end_cp FROM w JOIN quotes q ON q.book = w.book AND q.start_cp < w.b + 1000 AND q.end_cp > w.a - 1000 GROUP BY 1, 2""")
def x41_expanded_context(s, d):
    """A window's review sees a thousand code points more on each side; each quote once."""
    w = frame(s, d, "outputs").groupBy("book", F.floor(F.col("turn") / 3).alias("win")).agg(F.greatest(F.min("start_cp") - 1000, F.lit(0)).alias("l_start"), (F.max("end_cp") + 1000).alias("l_end"))
    q = frame(s, d, "quotes").select("book", "quote_id", F.col("start_cp").alias("r_start"), F.col("end_cp").alias("r_end"))
    return intervals.overlapping(w, q).groupBy("book", "win").agg(F.count_distinct("quote_id").alias("refs"), F.min("r_start").alias("start_cp"), F.max("r_end").alias("end_cp"))


@query(with_sql("outputs") + """, p AS (SELECT quote_id, k, kind, speaker, CASE WHEN k % 6 = 0 THEN 'other' ELSE kind END AS to_kind, k % 13 = 0 AS locked, k % 5 <> 2 AS external, count(*) OVER (PARTITION BY book, k % 31) AS same FROM outputs WHERE k % 3 <> 2)
SELECT quote_id, CASE WHEN locked THEN 'locked' WHEN to_kind <> kind THEN 'kind_is_fixed' WHEN same > 1 THEN 'targets_overlap' WHEN NOT external THEN 'no_external_evidence' ELSE 'applied' END AS outcome FROM p""")
def x47_identity_feedback(s, d):
    """Feedback on identities may change owners only, of unlocked quotes, each once, with evidence from outside."""
    k = F.col("k")
    p = frame(s, d, "outputs").filter("k % 3 <> 2").withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("book", F.col("k") % 31)))
    changed = F.when(k % 6 == 0, "other").otherwise(F.col("kind")) != F.col("kind")
    outcome = F.when(k % 13 == 0, "locked").when(changed, "kind_is_fixed").when(F.col("same") > 1, "targets_overlap").when(k % 5 == 2, "no_external_evidence").otherwise("applied")
    return p.select("quote_id", outcome.alias("outcome"))


@query(with_sql("outputs") + """, a AS (SELECT *, coalesce(basis, 'INSUFFICIENT') AS b, kind IN ('speech', 'thought', 'quotation') AS owned, k % 4 <> 1 AS approved FROM outputs),
s AS (SELECT *, CASE WHEN kind = 'unknown' THEN 0 WHEN NOT owned THEN 2 WHEN assignment = 'UNKNOWN' OR b = 'INSUFFICIENT' THEN 0 WHEN b = 'STYLE_ONLY' THEN 1 WHEN b = 'DIRECT' THEN CASE WHEN e_prev IS NULL THEN 1 ELSE 2 END WHEN e_prev IS NOT NULL OR e_self IS NOT NULL THEN 2 ELSE 1 END AS rank FROM a)
SELECT quote_id, kind, CASE WHEN NOT approved AND rank = 2 AND owned THEN 'PROVISIONAL' ELSE ['UNKNOWN', 'PROVISIONAL', 'ACCEPTED'][rank + 1] END AS status FROM s""")
def x48_expression_compile(s, d):
    """Thoughts and quotations are judged as speech is, and keep their kind; an approval that is missing lowers, none raises."""
    o = decisions.with_evidence(frame(s, d, "outputs")).withColumn("versioned", F.lit(True))
    a = decisions.accepted(o)
    lower = (F.col("k") % 4 == 1) & (F.col("status") == "ACCEPTED") & F.col("kind").isin(*decisions.OWNED)
    return a.select("quote_id", "kind", F.when(lower, "PROVISIONAL").otherwise(F.col("status")).alias("status"))


@query(MERGE + """, g AS (SELECT m.target, min(p.name) AS any_name, bool_and(p.kind = 'speaker') AS speakers, count(*) AS members, max(CASE WHEN p.person = m.target THEN p.kind END) AS kind, max(CASE WHEN p.person = m.target THEN trim(p.name) END) AS name, bool_or(p.locked) AS changed FROM people p JOIN m ON m.person = p.person GROUP BY 1 HAVING count(*) > 1)
SELECT target, members, ((kind = 'book' AND name <> '' AND NOT regexp_matches(name, '^S\\d+$')) OR speakers) AND NOT changed AS applied FROM g""")
def x51_auto_merge_apply(s, d):
    """A merge is applied if its target is a named person of the book, or all are mere speakers, and nothing changed since."""
    p = frame(s, d, "people")
    p = p.withColumn("target", F.min("person").over(Window.partitionBy("book", names.key(names.undecorated(F.col("name"))))))
    own = F.col("person") == F.col("target")
    g = p.groupBy("target").agg(n("members"), F.min(F.col("kind") == "speaker").alias("speakers"), F.max(F.when(own, F.col("kind"))).alias("kind"), F.max(F.when(own, F.trim("name"))).alias("name"), F.max("locked").alias("changed"))
    named = (F.col("kind") == "book") & (F.col("name") != "") & ~F.col("name").rlike("^S\\d+$")
    return g.filter("members > 1").select("target", "members", ((named | F.col("speakers")) & ~F.col("changed")).alias("applied"))


@query("SELECT doc_id, 'x' || text || ' y' AS text, CAST(1 AS BIGINT) AS start_cp, CAST(1 + length(text) AS BIGINT) AS end_cp, 'rt' || doc_id AS rt FROM documents")
def s11_ruby(s, d):
    """Ruby: the base text stays, what is said of it is kept with its range, brackets for old readers go."""
    base = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit({"&": "&amp;", "<": "&lt;", ">": "&gt;"}[x])), "&<>", F.col("text"))
    ruby = F.concat(F.lit("x<ruby>"), base, F.lit("<rp>(</rp><rt>rt"), F.col("doc_id").cast("string"), F.lit("</rt><rp>)</rp></ruby> y"))
    r = table(s, d, "documents").select("doc_id", ruby.alias("h"))
    parts = "(?s)^(.*?)<ruby>(.*?)<rp>.*?</rp><rt>(.*?)</rt><rp>.*?</rp></ruby>(.*)$"
    g = lambda k: markup.unescaped(F.regexp_extract("h", parts, k))
    start = F.length(g(1)).cast("long")
    return r.select("doc_id", F.concat(g(1), g(2), g(4)).alias("text"), start.alias("start_cp"), (start + F.length(g(2))).alias("end_cp"), g(3).alias("rt"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 <> 3 AND doc_id % 9 <> 8 THEN source END AS source FROM documents")
def s19_manifests(s, d):
    """Manifests of a known version and shape; any other is null."""
    i = F.col("doc_id")
    good = F.to_json(F.struct(F.when(i % 4 == 3, 9).otherwise(1).alias("version"), "source"))
    m = F.from_json(F.when(i % 9 == 8, F.lit("[1")).otherwise(good), "version int, source string")
    return table(s, d, "documents").select("doc_id", F.when(m["version"] == 1, m["source"]).alias("source"))


@query("SELECT page_id, page_id % 7 <> 6 AS verified, CASE WHEN page_id % 7 <> 6 THEN octet_length(encode(html)) END AS bytes FROM pages")
def s22_resources(s, d):
    """Resources by id; one whose digest isn't what was stored is not given out."""
    p = table(s, d, "pages")
    digest = F.sha2(F.encode("html", "UTF-8"), 256)
    stored = p.select("page_id", F.when(F.col("page_id") % 7 == 6, "else").otherwise(digest).alias("sha"))
    ok = F.col("sha") == digest
    return p.join(stored, "page_id").select("page_id", ok.alias("verified"), F.when(ok, F.octet_length(F.encode("html", "UTF-8")).cast("long")).alias("bytes"))


@query("""SELECT event_id, '{"event": ' || event_id || ', "api_key": "***", "note": "' || event_type || '"}' AS text FROM events""")
def k5_call_archive(s, d):
    """Calls as archived and read again: secrets are gone, the rest is as it was."""
    body = F.concat(F.lit('{"event": '), F.col("event_id").cast("string"), F.lit(', "api_key": "sk-'), F.col("user_id").cast("string"), F.lit('", "note": "'), "event_type", F.lit('"}'))
    return archives.unpacked(archives.packed(table(s, d, "events").withColumn("body", body), "event_id", "body"), "event_id")


@query("SELECT count(*) AS n, CAST(sum(CAST('0x' || substring(sha256(o_orderkey || '|' || o_custkey), 1, 12) AS BIGINT)) AS BIGINT) AS digest, CAST(1 AS BIGINT) AS layouts FROM orders")
def x55_layout_equality(s, d):
    """A table's digest is the same however its rows are laid out."""
    row = F.concat(F.col("o_orderkey").cast("string"), F.lit("|"), F.col("o_custkey").cast("string"))
    digest = lambda df: df.agg(n(), digests.summed(row).alias("digest"))
    o = table(s, d, "orders")
    both = reduce(DataFrame.unionByName, [digest(o), digest(o.repartition(7, "o_custkey"))])
    return both.groupBy("n", "digest").agg((F.count(F.lit(1)) - 1).alias("layouts"))


@query(MADE + """, len AS (SELECT book, max(start_cp + length(seg)) AS n FROM story GROUP BY 1), c AS (SELECT book, start_cp, end_cp, coalesce(lag(end_cp) OVER (PARTITION BY book ORDER BY start_cp), 0) AS cur FROM kept WHERE depth = 0)
SELECT book, 'target_quote' AS kind, start_cp, end_cp FROM c UNION ALL SELECT book, CASE WHEN cur = 0 THEN 'outer_gap' ELSE 'inner_gap' END, cur, start_cp FROM c WHERE cur < start_cp
UNION ALL SELECT l.book, 'outer_gap', coalesce(m.e, 0), l.n FROM len l LEFT JOIN (SELECT book, max(end_cp) AS e FROM c GROUP BY 1) m ON m.book = l.book WHERE coalesce(m.e, 0) < l.n""")
def d6_fragments(s, d):
    """A whole text as quotes and what lies around them, without holes."""
    whole = text.whole_texts(frame(s, d, "story"))
    return text.fragments(text.scan_quotes(whole), whole.select("book", F.length("text").cast("long").alias("length")))


PARTED = with_sql("segments") + """, sg AS (SELECT book, turn, quoted, CASE WHEN turn % 4 = 1 THEN '「' || chr(10) || '***' || chr(10) || substring(quoted, 2) ELSE quoted END || chr(10) || CASE WHEN turn % 3 = 2 THEN ' * * * ' || chr(10) ELSE '' END AS s FROM segments),
ps AS (SELECT *, sum(length(s)) OVER (PARTITION BY book ORDER BY turn) AS e FROM sg), tt AS (SELECT book, sum(length(s)) AS n, string_agg(s, '' ORDER BY turn) AS text FROM sg GROUP BY 1) """


@query(PARTED + """, cut AS (SELECT book, 0 AS pos FROM tt UNION SELECT book, n FROM tt UNION SELECT ps.book, ps.e FROM ps JOIN tt ON tt.book = ps.book WHERE turn % 3 = 2 AND e < n AND (length(text) + 3) // 4 > 300)
SELECT * FROM (SELECT book, CAST(pos AS BIGINT) AS start_cp, CAST(lead(pos) OVER (PARTITION BY book ORDER BY pos) AS BIGINT) AS end_cp FROM cut) WHERE end_cp IS NOT NULL""")
def t18_source_units(s, d):
    """Texts over budget, cut after lines that separate scenes; such lines within a quote cut nothing."""
    turn = F.col("turn")
    body = F.when(turn % 4 == 1, F.concat(F.lit("「\n***\n"), F.substring("quoted", F.lit(2), F.length("quoted")))).otherwise(F.col("quoted"))
    seg = frame(s, d, "segments").withColumn("seg", F.concat(body, F.lit("\n"), F.when(turn % 3 == 2, " * * * \n").otherwise("")))
    whole = text.whole_texts(seg).withColumn("text", F.translate("text", "「」", "[]"))  # of one byte a code point, for the estimate
    end = F.sum(F.length("seg").cast("long")).over(Window.partitionBy("book").orderBy("turn"))
    q = seg.withColumn("a", end - F.length("seg")).select("book", F.col("a").alias("start_cp"), (F.col("a") + F.length(body)).alias("end_cp"))
    return text.source_units(whole, q, 300)


@query(with_sql("quotes", "chapters") + """, q AS (SELECT q.book, q.quote_id, c.ordinal AS chapter, q.turn, regexp_replace(q.quoted, '\\s+', '', 'g') AS t FROM quotes q JOIN chapters c ON c.book = q.book AND q.start_cp >= c.start_cp AND q.start_cp < c.end_cp), e AS (SELECT book, chapter, turn AS entry, CASE WHEN turn % 5 = 3 THEN 'changed' ELSE t END AS t FROM q WHERE turn % 7 <> 6)
SELECT e.book, e.chapter, e.entry, q.quote_id FROM e LEFT JOIN q ON q.book = e.book AND q.chapter = e.chapter AND q.t = e.t AND q.turn = e.entry""")
def j17_restored_by_text(s, d):
    """Labels of a manifest find their quotes by text, in order, within each chapter."""
    from narrata.operators import evaluation

    c = frame(s, d, "chapters").select("book", F.col("ordinal").alias("chapter"), F.col("start_cp").alias("r_start"), F.col("end_cp").alias("r_end"))
    q = intervals.containing(frame(s, d, "quotes").withColumn("at", F.col("start_cp")), c)
    q = q.select("book", "chapter", "start_cp", "quote_id", "turn", F.regexp_replace("quoted", "\\s+", "").alias("text"))
    e = q.filter("turn % 7 <> 6").select("book", "chapter", F.col("turn").alias("entry"), F.when(F.col("turn") % 5 == 3, "changed").otherwise(F.col("text")).alias("text"))
    return evaluation.restored_by_text(q.drop("turn"), e)


@query(with_sql("chapters") + """, c AS (SELECT book, ordinal, 'T' || ordinal AS title FROM chapters), m AS (SELECT book, ordinal + book % 2 AS "index", CASE WHEN ordinal % 2 = 0 THEN ' T' || ordinal || ' ' ELSE 'gone' END AS title FROM chapters),
n AS (SELECT m.book, m."index", c.ordinal FROM m JOIN c ON c.book = m.book AND c.title = trim(m.title)) SELECT * FROM n UNION ALL SELECT m.book, m."index", c.ordinal FROM m JOIN c ON c.book = m.book AND c.ordinal = m."index" WHERE m.title = 'gone' AND NOT EXISTS (SELECT 1 FROM n WHERE n.book = m.book AND n.ordinal = m."index" AND n."index" < m."index")""")
def j16_bound_chapters(s, d):
    """Chapters of a manifest and of an import, by title and nearness, else by index."""
    from narrata.operators import evaluation

    ch = frame(s, d, "chapters")
    c = ch.select("book", "ordinal", F.concat(F.lit("T"), F.col("ordinal").cast("string")).alias("title"))
    m = ch.select("book", (F.col("ordinal") + F.col("book") % 2).alias("index"), F.when(F.col("ordinal") % 2 == 0, F.concat(F.lit(" T"), F.col("ordinal").cast("string"), F.lit(" "))).otherwise("gone").alias("title"))
    return evaluation.bound_chapters(c, m)


@query(with_sql("segments") + """, sg AS (SELECT book, turn, '“' || replace(replace(replace(quoted, '(', '['), ')', ']'), '「', '') || chr(10) AS s FROM segments), o AS (SELECT book, turn, sum(length(s)) OVER (PARTITION BY book ORDER BY turn) - length(s) AS a, length(s) AS n FROM (SELECT book, turn, replace(s, '」', '') AS s FROM sg))
SELECT book, CAST(a AS BIGINT) AS start_cp, CAST(a + n - 1 AS BIGINT) AS end_cp, true AS normalized FROM o WHERE n - 1 <= 1200""")
def t5_virtual_closes(s, d):
    """Openings that nothing closes end where a suggestion says, without a character of their own."""
    bare = F.replace(F.replace(F.translate("quoted", "()", "[]"), F.lit("「"), F.lit("")), F.lit("」"), F.lit(""))
    seg = frame(s, d, "segments").select("book", "turn", F.concat(F.lit("“"), bare, F.lit("\n")).alias("seg"))
    end = F.sum(F.length("seg").cast("long")).over(Window.partitionBy("book").orderBy("turn"))
    points = seg.select("book", (end - F.length("seg")).alias("opening_cp"), (end - 1).alias("close_cp"))
    closes = points.groupBy("book").agg(F.collect_list(F.struct("opening_cp", "close_cp")).alias("closes"))
    return text.scan_quotes(text.whole_texts(seg).join(closes, "book")).select("book", "start_cp", "end_cp", "normalized")


@query(with_sql("outputs") + """, w AS (SELECT book, speaker, CAST(floor(turn / 3) AS BIGINT) AS win, min(start_cp) AS cp, min((start_cp, quote_id)) AS f, count(*) AS c FROM outputs GROUP BY 1, 2, 3) SELECT book, speaker, win, max(cp) OVER o AS history_cp, min(cp) OVER o AS first_cp, CAST(sum(c) OVER o AS BIGINT) AS quotes, row_number() OVER o = 1 AS created FROM w WINDOW o AS (PARTITION BY book, speaker ORDER BY win)""")
def x13_group_histories(s, d):
    """Groups as windows make and change them; a history never goes back in the text."""
    w = frame(s, d, "outputs").groupBy("book", "speaker", F.floor(F.col("turn") / 3).alias("win")).agg(F.min("start_cp").alias("cp"), n("c"))
    o = Window.partitionBy("book", "speaker").orderBy("win")
    return w.select("book", "speaker", "win", F.max("cp").over(o).alias("history_cp"), F.min("cp").over(o).alias("first_cp"), F.sum("c").over(o).alias("quotes"), (F.row_number().over(o) == 1).alias("created"))


@query(with_sql("people") + f""", c AS (SELECT person, book, CASE person % 5 WHEN 0 THEN 'S7' ELSE 'anna' || (person % 45) END AS name, person % 6 <> 1 AS proven, CASE WHEN person % 8 = 0 THEN person END AS given FROM people), h AS (SELECT book, {KEY.format('name')} AS key, count(DISTINCT person) AS c, min(person) AS owner FROM people GROUP BY 1, 2)
SELECT c.person, CASE WHEN given IS NOT NULL THEN 'id:' || given WHEN h.c = 1 THEN 'id:' || h.owner WHEN h.c > 1 THEN NULL WHEN proven AND c.name <> 'S7' THEN 'new:' || substring(sha256(c.book || '|' || c.name), 1, 12) END AS found FROM c LEFT JOIN h ON h.book = c.book AND h.key = c.name""")
def x14_discovered_people(s, d):
    """A given id decides; else the one person of that name; else a new one, if proven and a name at all."""
    p = frame(s, d, "people")
    i = F.col("person")
    c = p.select("person", "book", F.when(i % 5 == 0, "S7").otherwise(F.concat(F.lit("anna"), (i % 45).cast("string"))).alias("name"), (i % 6 != 1).alias("proven"), F.when(i % 8 == 0, i).alias("given"))
    h = p.groupBy("book", names.key(names.undecorated(F.col("name"))).alias("name")).agg(F.count_distinct("person").alias("c"), F.min("person").alias("owner"))
    new = F.concat(F.lit("new:"), F.substring(F.sha2(F.concat_ws("|", F.col("book").cast("string"), "name").cast("binary"), 256), 1, 12))
    of = lambda x: F.concat(F.lit("id:"), F.col(x).cast("string"))
    found = F.when(F.col("given").isNotNull(), of("given")).when(F.col("c") == 1, of("owner")).when(F.col("c") > 1, None).when(F.col("proven") & names.can_be_shown(F.col("name")), new)
    return c.join(h, ["book", "name"], "left").select("person", found.alias("found"))


@query(with_sql("outputs") + """, t AS (SELECT *, k % 7 = 3 AS missing, CASE WHEN k % 7 = 3 OR assignment = 'UNKNOWN' THEN NULL ELSE speaker END AS who, CAST(floor(turn / 3) AS BIGINT) AS scene FROM outputs), f AS (SELECT book, scene, who, min(start_cp) AS f FROM t WHERE who IS NOT NULL GROUP BY 1, 2, 3), l AS (SELECT *, row_number() OVER (PARTITION BY book, scene ORDER BY f, who) AS n FROM f)
SELECT t.quote_id, NOT missing AS covered, CASE WHEN l.n IS NOT NULL THEN 'P' || l.n END AS slot FROM t LEFT JOIN l ON l.book = t.book AND l.scene = t.scene AND l.who = t.who""")
def d49_compact_rows(s, d):
    """Every target has a row: what the answer left out is told, and owners are numbered within their scene."""
    o = frame(s, d, "outputs").withColumns({"missing": F.col("k") % 7 == 3, "scene": F.floor(F.col("turn") / 3)})
    o = o.withColumn("who", F.when(~F.col("missing") & (F.col("assignment") != "UNKNOWN"), F.col("speaker")))
    first = o.filter("who IS NOT NULL").groupBy("book", "scene", "who").agg(F.min("start_cp").alias("f"))
    slot = F.concat(F.lit("P"), F.row_number().over(Window.partitionBy("book", "scene").orderBy("f", "who")).cast("string"))
    return o.join(first.withColumn("slot", slot), ["book", "scene", "who"], "left").select("quote_id", (~F.col("missing")).alias("covered"), "slot")


@query(with_sql("outputs") + """, c AS (SELECT quote_id, k, 1 + k % 3 AS applied, 1 + k % 4 AS now FROM outputs), u AS (SELECT quote_id FROM outputs WHERE k % 5 = 2)
SELECT c.quote_id, CASE WHEN u.quote_id IS NOT NULL THEN 'already_undone' WHEN now <> applied THEN 'changed_since' ELSE 'allowed' END AS verdict FROM c LEFT JOIN u ON u.quote_id = c.quote_id""")
def x10_undo_guards(s, d):
    """A correction can be undone once, and only while its target is as it left it."""
    k = F.col("k")
    o = frame(s, d, "outputs")
    undone = o.filter("k % 5 = 2").select("quote_id", F.lit(True).alias("undone"))
    verdict = F.when(F.col("undone"), "already_undone").when(1 + k % 4 != 1 + k % 3, "changed_since").otherwise("allowed")
    return o.join(undone, "quote_id", "left").select("quote_id", verdict.alias("verdict"))


@query(with_sql("segments", "chapters") + """, p AS (SELECT s.book, c.ordinal AS chapter, s.turn, trim(regexp_replace(s.quoted, '\\s+', ' ', 'g')) AS text FROM segments s JOIN chapters c ON c.book = s.book AND s.start_cp >= c.start_cp AND s.start_cp < c.end_cp)
SELECT book, chapter, 'Ch <' || chapter || '>' AS title, row_number() OVER (PARTITION BY book, chapter ORDER BY turn) AS block, 'p' AS tag, text FROM p UNION ALL SELECT DISTINCT book, chapter, 'Ch <' || chapter || '>', 0, 'h1', 'Ch <' || chapter || '>' FROM p""")
def k2_epub_round_trip(s, d):
    """Books written as EPUB files and read again: table of contents, spine, headings and paragraphs."""
    from narrata.sources import epub

    c = frame(s, d, "chapters").select("book", F.col("ordinal").alias("chapter"), F.col("start_cp").alias("r_start"), F.col("end_cp").alias("r_end"))
    p = intervals.containing(frame(s, d, "segments").withColumn("at", F.col("start_cp")), c)
    p = p.select("book", "chapter", F.concat(F.lit("Ch <"), F.col("chapter").cast("string"), F.lit(">")).alias("title"), F.col("turn").alias("position"), F.col("quoted").alias("text"))
    return epub.blocks(epub.built(p)).select("book", "chapter", "title", "block", "tag", "text")
