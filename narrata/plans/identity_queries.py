"""People, scenes, corrections and histories, each with the SQL that says the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrata.functions import colors, names
from narrata.operators import graph, intervals
from narrata.plans.dialogue_queries import n, query
from narrata.sources.dialogue import table
from narrata.sources.model import frame, with_sql

KEY = "lower(trim(regexp_replace(trim({0}), '[（(].*$', '')))"
ROLE = "('" + "', '".join(names.ROLES) + "')"
GENERIC = "('" + "', '".join(names.GENERIC) + "')"
SHOWN = "length(trim({0})) BETWEEN 1 AND 32 AND NOT regexp_matches(trim({0}), '[（）(),，。；;\\n]|本章|第一人称|叙述者|向.+搭讪|的打工前辈') AND NOT regexp_matches(trim({0}), '^(?i:S\\d+|new\\d+|未知人物|未知|不确定)$')"
IS_ROLE = "({0} IN " + ROLE + " OR regexp_matches({0}, '" + names.LOOKS + "'))"


@query(with_sql("people") + f"SELECT person, lower(trim(name)) AS key, trim(regexp_replace(trim(name), '[（(].*$', '')) AS plain, {IS_ROLE.format('trim(name)')} AS role, {SHOWN.format('name')} AS shown FROM people")
def fn_names(s, d):
    p = frame(s, d, "people")
    return p.select("person", names.key(F.col("name")).alias("key"), names.undecorated(F.col("name")).alias("plain"), names.is_role(F.col("name")).alias("role"), names.can_be_shown(F.col("name")).alias("shown"))


@query(with_sql("people") + f"""SELECT person, CASE WHEN ok AND (cur = '' OR {IS_ROLE.format('cur')} OR (length(cur) >= 2 AND length(new) > length(cur) AND (starts_with(new, cur) OR suffix(new, cur)))) THEN new ELSE cur END AS name FROM (
  SELECT person, new, cur, {SHOWN.format('new')} AND NOT {IS_ROLE.format('new')} AND NOT regexp_matches(new, '(?:同学|老师|先生|小姐|大人|前辈|哥哥|姐姐|师傅)$') AS ok FROM (
  SELECT person, trim(name) AS new, CASE person % 4 WHEN 0 THEN '' WHEN 1 THEN 'Anna' WHEN 2 THEN '女生' ELSE 'zed' END AS cur FROM people))""")
def fn_fuller_names(s, d):
    k = F.col("person") % 4
    current = F.when(k == 0, "").when(k == 1, "Anna").when(k == 2, "女生").otherwise("zed")
    return frame(s, d, "people").select("person", names.fuller(current, F.col("name")).alias("name"))


@query("SELECT CAST(i AS BIGINT) AS i, CAST(floor((i - 16 + 1) * CAST(137.508 AS DOUBLE) % 360 * 1000) AS BIGINT) AS hue, least(60.0, 1.0 * pow(2.0, i % 9)) AS wait FROM (SELECT c_custkey + 15 AS i FROM customer)")
def fn_colors_and_waits(s, d):
    c = table(s, d, "customer").select((F.col("c_custkey") + 15).alias("i"))  # the first sixteen colours are given
    return c.select("i", colors.hue(F.col("i")).alias("hue"), colors.backoff(F.col("i") % 9).alias("wait"))


def name_rows(s, d):
    p = frame(s, d, "people")
    return p.select("book", "person", "name").unionByName(p.filter("alias IS NOT NULL").select("book", "person", F.col("alias").alias("name")))


@query(with_sql("people") + f""", b AS (SELECT book, key, list_sort(list(DISTINCT person)) AS ids FROM (SELECT book, person, {KEY.format('name')} AS key FROM (SELECT book, person, name FROM people UNION ALL SELECT book, person, alias FROM people WHERE alias IS NOT NULL)) WHERE key <> '' AND key NOT IN {GENERIC} GROUP BY 1, 2)
SELECT book, min(key) AS key, array_to_string(ids, ',') AS ids FROM b WHERE len(ids) >= 2 GROUP BY book, ids""")
def d22_duplicate_names(s, d):
    """People of a book who share a name, each set of them once."""
    rows = name_rows(s, d).select("book", "person", names.key(names.undecorated(F.col("name"))).alias("key")).filter((F.col("key") != "") & ~F.col("key").isin(names.GENERIC))
    sets = rows.groupBy("book", "key").agg(F.sort_array(F.collect_set("person")).alias("ids")).filter("size(ids) >= 2")
    return sets.groupBy("book", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids")).agg(F.min("key").alias("key"))


@query(with_sql("people") + f""", t AS (SELECT DISTINCT book, person, {KEY.format('name')} AS key FROM (SELECT book, person, name FROM people UNION ALL SELECT book, person, alias FROM people WHERE alias IS NOT NULL)),
m AS (SELECT p.person, p.book, count(DISTINCT t.person) AS c, min(t.person) AS other FROM people p LEFT JOIN t ON t.book = p.book AND t.key = 'anna' || (p.person % 25) AND t.person <> p.person GROUP BY 1, 2)
SELECT person, CASE WHEN c = 1 THEN other END AS matched FROM m""")
def j18_unique_name_match(s, d):
    """A wanted name is matched only where one person alone has it."""
    have = name_rows(s, d).select("book", "person", names.key(names.undecorated(F.col("name"))).alias("key")).distinct()
    want = frame(s, d, "people").select("book", "person", F.concat(F.lit("anna"), (F.col("person") % 25).cast("string")).alias("key")).distinct()
    # Of a name, how many have it and two of them are enough: no one meets all who share the name.
    held = have.groupBy("book", "key").agg(F.count("person").alias("c"), F.min("person").alias("least"), F.max("person").alias("most"))
    own = have.filter("person IS NOT NULL").withColumn("own", F.lit(1))
    met = want.join(own, ["book", "key", "person"], "left").join(held, ["book", "key"], "left").filter("person IS NOT NULL AND c - coalesce(own, 0) = 1")
    other = F.when(F.col("least") == F.col("person"), F.col("most")).otherwise(F.col("least"))
    return want.select("book", "person").join(met.select("book", "person", other.alias("matched")), ["book", "person"], "left").select("person", "matched")


@query(with_sql("people") + f""", new AS (SELECT book, person, 'Anna' || (person % 33) AS value FROM people), t AS (SELECT DISTINCT book, person, {KEY.format('name')} AS key FROM (SELECT book, person, name FROM people UNION ALL SELECT book, person, alias FROM people WHERE alias IS NOT NULL))
SELECT n.person, n.value FROM new n JOIN people p ON p.person = n.person WHERE n.value <> trim(p.name) AND n.value <> coalesce(p.alias, '') AND NOT EXISTS (SELECT 1 FROM t WHERE t.book = n.book AND t.person <> n.person AND t.key = lower(n.value))""")
def d21_alias_supplement(s, d):
    """New aliases, but none that is another person's name already."""
    p = frame(s, d, "people")
    new = p.select("book", "person", F.concat(F.lit("Anna"), (F.col("person") % 33).cast("string")).alias("value"), "name", "alias")
    new = new.filter(names.can_be_shown(F.col("value")) & (F.col("value") != names.stripped(F.col("name"))) & (F.col("value") != F.coalesce("alias", F.lit("")))).withColumn("key", names.key(F.col("value")))
    have = name_rows(s, d).select("book", F.col("person").alias("other"), names.key(names.undecorated(F.col("name"))).alias("key")).distinct()
    return new.join(have, (new["book"] == have["book"]) & (new["key"] == have["key"]) & (new["person"] != have["other"]), "left_anti").select("person", "value")


VISIBLE = with_sql("facts") + ", vis AS (SELECT *, greatest(visible_from_cp, coalesce(link_cp, 0)) AS pos FROM facts WHERE accepted AND visible_from_cp <= 500 AND coalesce(link_cp, 0) <= 500) "


def visible_facts(s, d, horizon):
    f = frame(s, d, "facts").filter("accepted").filter((F.col("visible_from_cp") <= horizon) & (F.coalesce("link_cp", F.lit(0)) <= horizon))
    return f.withColumn("at", F.greatest("visible_from_cp", F.coalesce("link_cp", F.lit(0))))


@query(VISIBLE + """SELECT person, max_by(value, (pos, idx)) FILTER (idx % 3 = 0) AS name, max_by(value, (pos, idx)) FILTER (idx % 3 = 2) AS description, array_to_string(list_sort(list(DISTINCT value) FILTER (idx % 3 = 1 AND value <> '')), ',') AS aliases, count(*) AS facts FROM vis GROUP BY 1""")
def d19_profiles(s, d):
    """What is known of a person up to a position: the latest of each kind, and all aliases."""
    kind, at = F.col("idx") % 3, F.struct("at", "idx")
    latest = lambda k: F.max_by("value", F.when(kind == k, at))
    aliases = F.sort_array(F.collect_set(F.when((kind == 1) & (F.col("value") != ""), F.col("value"))))
    out = visible_facts(s, d, 500).groupBy("person").agg(latest(0).alias("name"), latest(2).alias("description"), aliases.alias("a"), n("facts"))
    return out.select("person", "name", "description", F.when(F.size("a") > 0, F.array_join("a", ",")).alias("aliases"), "facts")


@query(with_sql("facts") + """, f AS (SELECT person, idx, value, greatest(visible_from_cp, coalesce(link_cp, 0)) AS pos FROM facts WHERE accepted), p AS (SELECT DISTINCT person, pos FROM f),
v AS (SELECT p.person, p.pos, max_by(f.value, (f.pos, f.idx)) AS value FROM p JOIN f ON f.person = p.person AND f.pos <= p.pos GROUP BY 1, 2)
SELECT person, pos AS "at", value FROM (SELECT *, lag(value) OVER (PARTITION BY person ORDER BY pos) AS was, row_number() OVER (PARTITION BY person ORDER BY pos) AS k FROM v) WHERE k = 1 OR value IS DISTINCT FROM was""")
def d20_presentation_timeline(s, d):
    """The positions at which what a person is shown as changes."""
    f = frame(s, d, "facts").filter("accepted").select("person", "idx", "value", F.greatest("visible_from_cp", F.coalesce("link_cp", F.lit(0))).alias("at"))
    shown = f.groupBy("person", "at").agg(F.max_by("value", "idx").alias("value"))
    w = Window.partitionBy("person").orderBy("at")
    return shown.withColumns({"was": F.lag("value").over(w), "k": F.row_number().over(w)}).filter("k = 1 OR NOT value <=> was").select("person", "at", "value")


@query(with_sql("people", "facts") + """, v AS (SELECT person, max_by(value, (visible_from_cp, idx)) AS value, count(*) AS c FROM facts WHERE visible_from_cp <= 300 GROUP BY 1)
SELECT p.person, CASE WHEN p.person % 5 = 0 THEN trim(p.name) WHEN v.value IS NULL THEN 'private:' || p.person ELSE v.value END AS shown FROM people p LEFT JOIN v ON v.person = p.person""")
def j9_visible_value(s, d):
    """As of a position; without one (every fifth person) the current value; without a row so far, the private identity."""
    v = frame(s, d, "facts").filter("visible_from_cp <= 300").groupBy("person").agg(F.max_by("value", F.struct("visible_from_cp", "idx")).alias("value"))
    private = F.concat(F.lit("private:"), F.col("person").cast("string"))
    return frame(s, d, "people").join(v, "person", "left").select("person", F.when(F.col("person") % 5 == 0, F.trim("name")).otherwise(F.coalesce("value", private)).alias("shown"))


@query(with_sql("people", "facts") + """, v AS (SELECT person, max_by(value, (visible_from_cp, idx)) AS value FROM facts WHERE accepted AND visible_from_cp <= 400 GROUP BY 1)
SELECT p.book, v.value AS name, min(p.person) AS person FROM people p JOIN v ON v.person = p.person WHERE v.value <> '' GROUP BY 1, 2 HAVING count(DISTINCT p.person) = 1""")
def x20_input_names(s, d):
    """Names as visible, of which only those that one person has are given to a model."""
    v = frame(s, d, "facts").filter("accepted AND visible_from_cp <= 400").groupBy("person").agg(F.max_by("value", F.struct("visible_from_cp", "idx")).alias("name"))
    return frame(s, d, "people").select("book", "person").join(v, "person").filter("name <> ''").groupBy("book", "name").agg(F.count_distinct("person").alias("c"), F.min("person").alias("person")).filter("c = 1").drop("c")


@query(VISIBLE + "SELECT p.person, CASE WHEN v.person IS NOT NULL THEN c END AS records, CASE WHEN v.person IS NOT NULL THEN last END AS last_cp FROM (SELECT DISTINCT person FROM facts) p LEFT JOIN (SELECT person, count(*) AS c, max(pos) AS last FROM vis GROUP BY 1) v ON v.person = p.person")
def x23_frozen_identities(s, d):
    """Records up to a position; none is null, not the final state."""
    v = visible_facts(s, d, 500).groupBy("person").agg(n("records"), F.max("at").alias("last_cp"))
    return frame(s, d, "facts").select("person").distinct().join(v, "person", "left")


@query(with_sql("people") + """, e AS (SELECT book, person, color, row_number() OVER (PARTITION BY book ORDER BY first_cp, person) AS k FROM people), w AS (SELECT *, color IS NOT NULL AND row_number() OVER (PARTITION BY book, color ORDER BY k) = 1 AS own FROM e),
l AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY k) AS j FROM w WHERE NOT own), r AS (SELECT book, list(DISTINCT color) AS taken, count(*) AS many FROM people GROUP BY 1),
f AS (SELECT book, c, row_number() OVER (PARTITION BY book ORDER BY c) AS j FROM (SELECT book, taken, unnest(range(many + 12)) AS c FROM r) WHERE taken IS NULL OR NOT list_contains(taken, c))
SELECT book, person, color FROM w WHERE own UNION ALL SELECT l.book, l.person, f.c FROM l JOIN f ON f.book = l.book AND f.j = l.j""")
def d18_colors(s, d):
    """People in order of appearance: a free preferred colour, else the lowest that nobody prefers or has."""
    w = Window.partitionBy("book").orderBy("first_cp", "person")
    p = frame(s, d, "people").select("book", "person", "color", "first_cp")
    p = p.withColumn("own", F.col("color").isNotNull() & (F.row_number().over(Window.partitionBy("book", "color").orderBy("first_cp", "person")) == 1))
    lost = p.filter("NOT own").withColumn("j", F.row_number().over(w))
    free = p.groupBy("book").agg(F.collect_set("color").alias("taken"), n("many"))
    free = free.select("book", F.array_except(F.sequence(F.lit(0).cast("long"), F.col("many") + F.size("taken")), "taken").alias("free"))
    return p.filter("own").select("book", "person", "color").unionByName(lost.join(free, "book").select("book", "person", F.element_at("free", F.col("j")).alias("color")))


@query(with_sql("people") + """, g AS (SELECT person % 40 AS grp, book, person FROM people UNION ALL SELECT 40 + person % 7, book, person FROM people WHERE person % 13 = 0), bad AS (SELECT DISTINCT grp FROM g WHERE person IN (SELECT person FROM g GROUP BY 1 HAVING count(*) > 1))
SELECT grp, count(DISTINCT person) AS members, grp IN (SELECT grp FROM bad) AS conflict, count(DISTINCT person) < 2 AS too_small FROM g GROUP BY 1""")
def d23_merge_plan(s, d):
    """Groups of a merge plan; all that share a member are in conflict."""
    p = frame(s, d, "people").select("person")
    g = p.select((F.col("person") % 40).alias("grp"), "person").unionByName(p.filter("person % 13 = 0").select((40 + F.col("person") % 7).alias("grp"), "person"))
    twice = g.groupBy("person").count().filter("count > 1")
    marked = g.join(twice, "person", "left").groupBy("grp").agg(F.count_distinct("person").alias("members"), F.max(F.col("count").isNotNull()).alias("conflict"))
    return marked.withColumn("too_small", F.col("members") < 2)


MERGE = with_sql("people") + f", m AS (SELECT person, min(person) OVER (PARTITION BY book, {KEY.format('name')}) AS target FROM people) "


@query(MERGE + """SELECT r.chapter, array_to_string(list_sort(list(DISTINCT m.target)), ',') AS people, bool_or(r.pov) AS pov FROM (SELECT person % 50 AS chapter, person, person % 9 = 0 AS pov FROM people) r JOIN m ON m.person = r.person GROUP BY 1""")
def x52_directory_rewrite(s, d):
    """Rosters after people are merged: each person once, the point of view kept."""
    p = frame(s, d, "people")
    target = F.min("person").over(Window.partitionBy("book", names.key(names.undecorated(F.col("name")))))
    merged = p.withColumn("target", target).select((F.col("person") % 50).alias("chapter"), "target", (F.col("person") % 9 == 0).alias("pov"))
    ids = F.transform(F.sort_array(F.collect_set("target")), lambda x: x.cast("string"))
    return merged.groupBy("chapter").agg(F.array_join(ids, ",").alias("people"), F.max("pov").alias("pov"))


@query(with_sql("outputs") + """, g AS (SELECT book, CAST(floor(turn / 3) AS BIGINT) AS scene, speaker, min(start_cp) AS first FROM outputs GROUP BY 1, 2, 3) SELECT book, scene, speaker, 'S' || row_number() OVER (PARTITION BY book, scene ORDER BY first, speaker) AS label FROM g""")
def w8_scene_labels(s, d):
    """Labels of a scene's speakers, by who speaks first."""
    g = frame(s, d, "outputs").groupBy("book", F.floor(F.col("turn") / 3).alias("scene"), "speaker").agg(F.min("start_cp").alias("first"))
    k = F.row_number().over(Window.partitionBy("book", "scene").orderBy("first", "speaker"))
    return g.select("book", "scene", "speaker", F.concat(F.lit("S"), k.cast("string")).alias("label"))


@query(with_sql("gaps", "outputs") + """, e AS (SELECT o.book, o.quote_id, o.start_cp, o.speaker, CASE g.turn % 4 WHEN 0 THEN 'BREAK' WHEN 1 THEN 'UNCERTAIN' ELSE 'CONTINUE' END AS decision FROM outputs o LEFT JOIN gaps g ON g.right_id = o.quote_id),
s AS (SELECT *, sum(CASE WHEN decision = 'BREAK' THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY start_cp) AS scene FROM e)
SELECT book, quote_id, CAST(scene AS BIGINT) AS scene, coalesce(decision = 'UNCERTAIN', false) AS pending, 'S' || dense_rank() OVER (PARTITION BY book, scene ORDER BY f) AS label FROM (SELECT *, min(start_cp) OVER (PARTITION BY book, scene, speaker) AS f FROM s)""")
def d11_scene_fold(s, d):
    """Scenes open anew at breaks, with labels from S1 on; uncertain gaps are pending."""
    t = F.col("turn") % 4
    g = frame(s, d, "gaps").select(F.col("right_id").alias("quote_id"), F.when(t == 0, "BREAK").when(t == 1, "UNCERTAIN").otherwise("CONTINUE").alias("decision"))
    e = frame(s, d, "outputs").select("book", "quote_id", "start_cp", "speaker").join(g, "quote_id", "left")
    broken = F.when(F.col("decision") == "BREAK", 1).otherwise(0)
    e = e.withColumn("scene", F.sum(broken).over(Window.partitionBy("book").orderBy("start_cp")))
    e = e.withColumn("first", F.min("start_cp").over(Window.partitionBy("book", "scene", "speaker")))
    k = F.dense_rank().over(Window.partitionBy("book", "scene").orderBy("first"))
    return e.select("book", "quote_id", "scene", F.coalesce(F.col("decision") == "UNCERTAIN", F.lit(False)).alias("pending"), F.concat(F.lit("S"), k.cast("string")).alias("label"))


ACTIONS = with_sql("outputs") + """, a AS (SELECT *, CASE k % 4 WHEN 0 THEN 'assign_existing' WHEN 1 THEN 'create_speaker' WHEN 2 THEN 'set_kind' ELSE 'mark_unknown' END AS action, CASE k % 5 WHEN 0 THEN 'other' WHEN 1 THEN 'thought' ELSE 'speech' END AS to_kind,
  CASE WHEN k % 3 = 0 THEN NULL ELSE speaker END AS had, CASE WHEN k % 7 = 0 THEN 'S9' END AS ref, min(quote_id) OVER (PARTITION BY book) AS head FROM outputs) """


@query(ACTIONS + """SELECT quote_id, CASE WHEN action IN ('assign_existing', 'create_speaker', 'set_kind') THEN to_kind ELSE kind END AS new_kind,
  CASE action WHEN 'assign_existing' THEN 'EXISTING' WHEN 'create_speaker' THEN 'NEW' WHEN 'set_kind' THEN CASE WHEN to_kind = 'other' THEN NULL WHEN coalesce(ref, had) IS NOT NULL THEN 'EXISTING' ELSE 'UNKNOWN' END ELSE CASE WHEN kind IN ('speech', 'thought', 'quotation') THEN 'UNKNOWN' END END AS new_assignment,
  CASE action WHEN 'assign_existing' THEN 'S1' WHEN 'create_speaker' THEN 'new:' || head WHEN 'set_kind' THEN CASE WHEN to_kind <> 'other' THEN coalesce(ref, had) END END AS new_speaker,
  CASE WHEN action IN ('assign_existing', 'create_speaker') OR (action = 'set_kind' AND (to_kind = 'other' OR coalesce(ref, had) IS NOT NULL)) THEN 'USER_CONFIRMED' ELSE 'UNKNOWN' END AS new_status FROM a""")
def x9_quote_actions(s, d):
    """What each kind of correction makes of a label. A batch that creates a speaker creates one."""
    k = F.col("k")
    a = frame(s, d, "outputs").withColumns({
        "action": F.when(k % 4 == 0, "assign_existing").when(k % 4 == 1, "create_speaker").when(k % 4 == 2, "set_kind").otherwise("mark_unknown"),
        "to_kind": F.when(k % 5 == 0, "other").when(k % 5 == 1, "thought").otherwise("speech"), "had": F.when(k % 3 != 0, F.col("speaker")),
        "ref": F.when(k % 7 == 0, "S9"), "head": F.min("quote_id").over(Window.partitionBy("book")),
    })
    return corrected(a).select("quote_id", "new_kind", "new_assignment", "new_speaker", "new_status")


def corrected(a: DataFrame) -> DataFrame:
    """new_kind, new_assignment, new_speaker, new_status after actions (action, to_kind, had, ref, head, kind)."""
    does = lambda x: F.col("action") == x
    owner = lambda c: F.col(c).isin("speech", "thought", "quotation")
    who = F.coalesce("ref", "had")
    unknown = F.when(owner("kind"), "UNKNOWN")
    by_kind = F.when(~owner("to_kind"), None).when(who.isNotNull(), "EXISTING").otherwise("UNKNOWN")
    sure = does("assign_existing") | does("create_speaker") | (does("set_kind") & (~owner("to_kind") | who.isNotNull()))
    return a.withColumns({
        "new_kind": F.when(does("mark_unknown"), F.col("kind")).otherwise(F.col("to_kind")),
        "new_assignment": F.when(does("assign_existing"), "EXISTING").when(does("create_speaker"), "NEW").when(does("set_kind"), by_kind).otherwise(unknown),
        "new_speaker": F.when(does("assign_existing"), "S1").when(does("create_speaker"), F.concat(F.lit("new:"), "head")).when(does("set_kind") & owner("to_kind"), who),
        "new_status": F.when(sure, "USER_CONFIRMED").otherwise("UNKNOWN"),
    })


@query(with_sql("outputs", "scenes") + """, b AS (SELECT s.book, s.scene, min(o.start_cp) AS cut FROM scenes s JOIN outputs o ON o.book = s.book AND o.start_cp >= s.start_cp AND o.start_cp < s.end_cp AND o.k % 5 = 2 WHERE s.scene % 2 = 0 GROUP BY 1, 2)
SELECT s.book, s.scene, s.start_cp, coalesce(b.cut, s.end_cp) AS end_cp, false AS new_scene FROM scenes s LEFT JOIN b ON b.book = s.book AND b.scene = s.scene AND b.cut > s.start_cp
UNION ALL SELECT s.book, s.scene, b.cut, s.end_cp, true FROM scenes s JOIN b ON b.book = s.book AND b.scene = s.scene AND b.cut > s.start_cp""")
def d28_gap_breaks(s, d):
    """A break within a scene ends it there; the rest is a new scene."""
    sc = frame(s, d, "scenes")
    cuts = frame(s, d, "outputs").filter("k % 5 = 2").select("book", F.col("start_cp").alias("at"))
    met = intervals.containing(cuts, sc.filter("scene % 2 = 0").select("book", "scene", F.col("start_cp").alias("r_start"), F.col("end_cp").alias("r_end")))
    first = met.groupBy("book", "scene").agg(F.min("at").alias("cut"))
    both = sc.join(first, ["book", "scene"], "left").withColumn("cut", F.when(F.col("cut") > F.col("start_cp"), F.col("cut")))
    rest = both.filter("cut IS NOT NULL").select("book", "scene", F.col("cut").alias("start_cp"), "end_cp", F.lit(True).alias("new_scene"))
    return both.select("book", "scene", "start_cp", F.coalesce("cut", "end_cp").alias("end_cp"), F.lit(False).alias("new_scene")).unionByName(rest)


REVISED = with_sql("outputs") + """, g AS (SELECT book, speaker, min((start_cp, quote_id)) AS first FROM outputs WHERE speaker IN ('user', 'assistant') GROUP BY 1, 2), sv AS (SELECT book, min_by(speaker, first) AS survivor FROM g GROUP BY 1) """


@query(REVISED + "SELECT o.quote_id, sv.survivor AS speaker, CASE WHEN o.speaker <> sv.survivor THEN o.speaker END AS was, o.speaker <> sv.survivor AS touched FROM outputs o JOIN sv ON sv.book = o.book WHERE o.speaker IN ('user', 'assistant')")
def d29_speaker_merge(s, d):
    """Two speakers of a book become the one that speaks first; the others' quotes keep what they were, for undoing."""
    o = frame(s, d, "outputs").filter(F.col("speaker").isin("user", "assistant"))
    survivor = o.groupBy("book").agg(F.min_by("speaker", F.struct("start_cp", "quote_id")).alias("survivor"))
    other = F.col("speaker") != F.col("survivor")
    return o.join(survivor, "book").select("quote_id", F.col("survivor").alias("speaker"), F.when(other, F.col("speaker")).alias("was"), other.alias("touched"))


@query(REVISED + """, m AS (SELECT o.quote_id, o.k, sv.survivor AS speaker, o.speaker AS was, 2 + CASE WHEN o.k % 6 = 5 THEN 1 ELSE 0 END AS version FROM outputs o JOIN sv ON sv.book = o.book WHERE o.speaker IN ('user', 'assistant') AND o.speaker <> sv.survivor)
SELECT quote_id, CASE WHEN version = 2 THEN was ELSE speaker END AS speaker, version = 2 AS undone, version + CASE WHEN version = 2 THEN 1 ELSE 0 END AS version FROM m""")
def d30_undo(s, d):
    """A correction is undone where its target is still at the version that it left."""
    m = d29_speaker_merge(s, d).filter("touched").join(frame(s, d, "outputs").select("quote_id", "k"), "quote_id")
    at = F.lit(2) + F.when(F.col("k") % 6 == 5, 1).otherwise(0)
    can = F.col("at") == 2
    return m.withColumn("at", at).select("quote_id", F.when(can, F.col("was")).otherwise(F.col("speaker")).alias("speaker"), can.alias("undone"), (F.col("at") + can.cast("int")).alias("version"))


@query(with_sql("outputs") + """, mv AS (SELECT book, quote_id, start_cp, speaker, CAST(floor(turn / 3) AS BIGINT) AS scene FROM outputs WHERE turn % 3 = 2), g AS (SELECT book, speaker, min(start_cp) AS f FROM mv GROUP BY 1, 2), l AS (SELECT *, 'S' || row_number() OVER (PARTITION BY book ORDER BY f, speaker) AS label FROM g)
SELECT mv.book, mv.quote_id, mv.scene AS left_scene, l.label FROM mv JOIN l ON l.book = mv.book AND l.speaker = mv.speaker""")
def d31_scene_move(s, d):
    """Quotes that move to a new scene get labels there by who speaks first; what they leave is told."""
    mv = frame(s, d, "outputs").filter("turn % 3 = 2").select("book", "quote_id", "start_cp", "speaker", F.floor(F.col("turn") / 3).alias("left_scene"))
    first = mv.groupBy("book", "speaker").agg(F.min("start_cp").alias("f"))
    label = F.concat(F.lit("S"), F.row_number().over(Window.partitionBy("book").orderBy("f", "speaker")).cast("string"))
    return mv.join(first.withColumn("label", label), ["book", "speaker"]).select("book", "quote_id", "left_scene", "label")


@query(with_sql("items", "outputs") + """, c AS (SELECT i.item, i.status, o.k, o.quote_id, CASE WHEN o.k % 8 <> 1 THEN 'c' || (o.k % 6) END AS cause FROM items i JOIN outputs o ON o.quote_id = i.quote_id WHERE i.reason = 'STALE_DEPENDENCY' AND i.status <> 'RESOLVED'),
k AS (SELECT 'c' || j AS id, CASE j WHEN 0 THEN 'SCENE' WHEN 5 THEN 'GAP' ELSE 'QUOTE' END AS target_type FROM (SELECT unnest([0, 1, 2, 3, 5]) AS j))
SELECT c.item, c.status = 'PENDING' AND coalesce(k.target_type = 'QUOTE', false) AND c.k % 13 <> 0 AND c.k % 5 <> 4 AND c.k % 7 <> 6 AS resolved FROM c LEFT JOIN k ON k.id = c.cause""")
def d33_stale_cleanup(s, d):
    """Stale items that go: pending, caused by a quote's correction, on a model's unlocked label that didn't change since."""
    k = F.col("k")
    c = frame(s, d, "items").filter("reason = 'STALE_DEPENDENCY' AND status <> 'RESOLVED'").join(frame(s, d, "outputs").select("quote_id", "k"), "quote_id")
    c = c.withColumn("id", F.when(k % 8 != 1, F.concat(F.lit("c"), (k % 6).cast("string"))))
    causes = s.createDataFrame([("c0", "SCENE"), ("c1", "QUOTE"), ("c2", "QUOTE"), ("c3", "QUOTE"), ("c5", "GAP")], "id string, target_type string")
    eligible = (F.col("status") == "PENDING") & F.coalesce(F.col("target_type") == "QUOTE", F.lit(False)) & (k % 13 != 0) & (k % 5 != 4) & (k % 7 != 6)
    return c.join(F.broadcast(causes), "id", "left").select("item", eligible.alias("resolved"))


@query(with_sql("annotations") + """, h AS (SELECT quote_id, version FROM (SELECT quote_id, turn % 3 AS version FROM annotations WHERE turn % 2 = 0)), now AS (SELECT quote_id, turn % 3 AS version, status FROM annotations WHERE turn % 5 <> 4)
SELECT n.quote_id, n.version AS revision, n.status FROM now n WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.quote_id = n.quote_id AND h.version = n.version)""")
def x5_history_write_once(s, d):
    """States before a change are written once for each version."""
    a = frame(s, d, "annotations")
    had = a.filter("turn % 2 = 0").select("quote_id", (F.col("turn") % 3).alias("revision"))
    return a.filter("turn % 5 <> 4").select("quote_id", (F.col("turn") % 3).alias("revision"), "status").join(had, ["quote_id", "revision"], "left_anti")


@query(with_sql("outputs", "scenes") + """, a AS (SELECT *, CASE WHEN k % 3 = 0 THEN CAST(floor(turn / 3) AS BIGINT) END AS own FROM outputs), sc AS (SELECT book, scene, start_cp, CASE WHEN scene % 2 = 0 THEN NULL ELSE end_cp END AS end_cp FROM scenes)
SELECT a.quote_id, coalesce(a.own, max_by(sc.scene, sc.start_cp)) AS scene FROM a LEFT JOIN sc ON sc.book = a.book AND sc.start_cp <= a.start_cp AND (sc.end_cp IS NULL OR sc.end_cp > a.start_cp) GROUP BY a.quote_id, a.own""")
def x11_scene_of_quote(s, d):
    """A quote's own scene, else the latest one that began before it and isn't over."""
    a = frame(s, d, "outputs").select("book", "quote_id", F.col("start_cp").alias("at"), F.when(F.col("k") % 3 == 0, F.floor(F.col("turn") / 3)).alias("own"))
    sc = frame(s, d, "scenes").select("book", "scene", F.col("start_cp").alias("s0"), F.when(F.col("scene") % 2 == 1, F.col("end_cp")).alias("e0"))
    # Scenes that have ended hold a quote as ranges; of those that go on, the latest to begin counts.
    ended = intervals.containing(a, sc.filter("e0 IS NOT NULL").select("book", "scene", F.col("s0").alias("r_start"), F.col("e0").alias("r_end")))
    ended = ended.select("quote_id", F.struct(F.col("r_start").alias("s0"), "scene").alias("x"))
    begun = sc.filter("e0 IS NULL").select("book", F.col("s0").alias("at"), F.lit(0).alias("asks"), F.struct("s0", "scene").alias("x"), F.lit(None).cast("string").alias("quote_id"))
    asked = begun.unionByName(a.select("book", "at", F.lit(1).alias("asks"), F.lit(None).cast(begun.schema["x"].dataType).alias("x"), "quote_id"))
    last = F.last("x", True).over(Window.partitionBy("book").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    open_ = asked.withColumn("x", last).filter("asks = 1 AND x IS NOT NULL").select("quote_id", "x")
    met = ended.unionByName(open_).groupBy("quote_id").agg(F.max("x").alias("latest"))
    return a.join(met, "quote_id", "left").select("quote_id", F.coalesce("own", "latest.scene").alias("scene"))


@query(with_sql("outputs", "scenes", "chapters") + """SELECT o.quote_id, CASE WHEN s.scene IS NOT NULL THEN s.start_cp WHEN c.ordinal IS NOT NULL THEN c.start_cp ELSE 0 END AS start_cp,
  CASE WHEN s.scene IS NOT NULL THEN CASE WHEN s.scene % 2 = 0 THEN b.end_cp ELSE s.end_cp END WHEN c.ordinal IS NOT NULL THEN c.end_cp ELSE b.end_cp END AS end_cp
FROM outputs o JOIN (SELECT book, max(end_cp) AS end_cp FROM chapters GROUP BY 1) b ON b.book = o.book LEFT JOIN scenes s ON s.book = o.book AND s.scene = CASE WHEN o.k % 3 = 0 THEN CAST(floor(o.turn / 3) AS BIGINT) END
LEFT JOIN chapters c ON c.book = o.book AND c.ordinal = CASE WHEN o.k % 5 <> 4 THEN CAST(floor(o.turn / 4) AS BIGINT) END""")
def x12_recheck_range(s, d):
    """The scene's range (to the book's end while it is open), else the chapter's, else the whole book."""
    k = F.col("k")
    o = frame(s, d, "outputs").select("book", "quote_id", F.when(k % 3 == 0, F.floor(F.col("turn") / 3)).alias("scene"), F.when(k % 5 != 4, F.floor(F.col("turn") / 4)).alias("ordinal"))
    ch = frame(s, d, "chapters")
    whole = ch.groupBy("book").agg(F.max("end_cp").alias("b1"))
    sc = frame(s, d, "scenes").select("book", "scene", F.col("start_cp").alias("s0"), F.when(F.col("scene") % 2 == 1, F.col("end_cp")).alias("s1"))
    both = o.join(whole, "book").join(sc, ["book", "scene"], "left").join(ch.select("book", "ordinal", F.col("start_cp").alias("c0"), F.col("end_cp").alias("c1")), ["book", "ordinal"], "left")
    end = F.when(F.col("s0").isNotNull(), F.coalesce("s1", "b1")).otherwise(F.coalesce("c1", "b1"))
    return both.select("quote_id", F.coalesce("s0", "c0", F.lit(0).cast("long")).alias("start_cp"), end.alias("end_cp"))


@query(with_sql("outputs") + """, x AS (SELECT book, quote_id, k, speaker, kind, assignment, basis, CASE WHEN k % 11 = 0 THEN 'q-none' ELSE quote_id END AS ref, e_prev, e_self FROM outputs WHERE k % 9 <> 1 UNION ALL SELECT book, quote_id, k, speaker, kind, assignment, basis, quote_id, e_prev, e_self FROM outputs WHERE k % 13 = 0)
SELECT book, ref, 'unknown_quote' AS issue FROM x WHERE ref NOT IN (SELECT quote_id FROM outputs) UNION ALL SELECT book, ref, 'duplicate_label' FROM x WHERE ref <> 'q-none' GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT book, quote_id, 'missing_label' FROM outputs WHERE quote_id NOT IN (SELECT ref FROM x) UNION ALL SELECT DISTINCT book, ref, 'basis_without_assignment' FROM x WHERE kind = 'speech' AND basis IS NULL AND assignment <> 'UNKNOWN'
UNION ALL SELECT DISTINCT book, ref, 'direct_without_evidence' FROM x WHERE basis = 'DIRECT' AND e_prev IS NULL AND e_self IS NULL UNION ALL SELECT DISTINCT book, ref, 'inert_fields' FROM x WHERE kind IN ('group', 'other') AND basis IS NOT NULL""")
def d13_output_issues(s, d):
    """Issues of an output, one a row: labels that refer to nothing, occur twice or are missing, and fields that don't go together."""
    o, k = frame(s, d, "outputs"), F.col("k")
    x = o.filter("k % 9 <> 1").withColumn("ref", F.when(k % 11 == 0, "q-none").otherwise(F.col("quote_id"))).unionByName(o.filter("k % 13 = 0").withColumn("ref", F.col("quote_id")))
    ids = o.select(F.col("quote_id").alias("ref"))
    told = lambda df, issue: df.select("book", "ref", F.lit(issue).alias("issue"))
    found = [
        told(x.join(ids, "ref", "left_anti"), "unknown_quote"),
        told(x.join(ids, "ref", "left_semi").groupBy("book", "ref").count().filter("count > 1"), "duplicate_label"),
        told(o.select("book", F.col("quote_id").alias("ref")).join(x.select("ref"), "ref", "left_anti"), "missing_label"),
        told(x.filter("kind = 'speech' AND basis IS NULL AND assignment <> 'UNKNOWN'").dropDuplicates(["book", "ref"]), "basis_without_assignment"),
        told(x.filter("basis = 'DIRECT' AND e_prev IS NULL AND e_self IS NULL").dropDuplicates(["book", "ref"]), "direct_without_evidence"),
        told(x.filter("kind IN ('group', 'other') AND basis IS NOT NULL").dropDuplicates(["book", "ref"]), "inert_fields"),
    ]
    return reduce(DataFrame.unionByName, found)


@query(with_sql("outputs") + """, e AS (SELECT o.quote_id, o.speaker, e.e_prev FROM outputs o LEFT JOIN (SELECT quote_id, e_prev FROM outputs WHERE e_prev IS NOT NULL) e ON e.quote_id = o.quote_id),
x AS (SELECT quote_id, row_number() OVER (PARTITION BY book ORDER BY start_cp) AS i, book FROM outputs)
SELECT x.quote_id, 'Q' || x.i AS ref, 'E' || y.i AS evidence FROM x LEFT JOIN e ON e.quote_id = x.quote_id LEFT JOIN x y ON y.quote_id = e.e_prev""")
def x53_reference_aliases(s, d):
    """Short references for what a model is shown, and the evidence in their terms."""
    o = frame(s, d, "outputs").withColumn("i", F.row_number().over(Window.partitionBy("book").orderBy("start_cp")).cast("string"))
    other = o.select(F.col("quote_id").alias("e_prev"), F.concat(F.lit("E"), "i").alias("evidence"))
    return o.select("quote_id", F.concat(F.lit("Q"), "i").alias("ref"), "e_prev").join(other, "e_prev", "left").drop("e_prev")


CLOSURE = with_sql("outputs").replace("WITH ", "WITH RECURSIVE ", 1) + """, e AS (SELECT quote_id AS a, e_prev AS b FROM outputs WHERE e_prev IS NOT NULL AND k % 5 <> 3 UNION SELECT e_prev, quote_id FROM outputs WHERE e_prev IS NOT NULL AND k % 5 <> 3), bad AS (SELECT quote_id FROM outputs WHERE k % 7 = 4 UNION SELECT e.b FROM bad JOIN e ON e.a = bad.quote_id) """


@query(CLOSURE + "SELECT o.quote_id, b.quote_id IS NULL AS kept FROM outputs o LEFT JOIN bad b ON b.quote_id = o.quote_id")
def x44_failed_block_closure(s, d):
    """A failed row takes all that depend on it, or it on them, whichever way; the rest is kept."""
    o = frame(s, d, "outputs")
    edges = o.filter("e_prev IS NOT NULL AND k % 5 <> 3").select(F.col("quote_id").alias("a"), F.col("e_prev").alias("b"))
    comp = graph.components(edges)
    own = o.select(F.col("quote_id").alias("node"), (F.col("k") % 7 == 4).alias("failed")).join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    bad = own.groupBy("component").agg(F.max("failed").alias("bad"))
    return own.join(bad, "component").select(F.col("node").alias("quote_id"), (~F.col("bad")).alias("kept"))


@query(with_sql("outputs").replace("WITH ", "WITH RECURSIVE ", 1) + """, d AS (SELECT quote_id FROM outputs WHERE k % 6 = 5 UNION SELECT o.quote_id FROM d JOIN outputs o ON o.e_prev = d.quote_id)
SELECT o.quote_id, CASE WHEN o.k % 6 = 5 THEN 'UNKNOWN' WHEN d.quote_id IS NOT NULL AND o.basis IN ('COREFERENCE', 'RESPONSE_LINK') THEN 'UNKNOWN' ELSE o.assignment END AS assignment, d.quote_id IS NOT NULL AS warned FROM outputs o LEFT JOIN d ON d.quote_id = o.quote_id""")
def x45_dependent_warnings(s, d):
    """Invalid rows become unknown; a warning goes to all that refer to them, and linked owners are lost."""
    o = frame(s, d, "outputs")
    edges = o.filter("e_prev IS NOT NULL").select(F.col("e_prev").alias("source"), F.col("quote_id").alias("target"))
    warned = graph.reached(edges, o.filter("k % 6 = 5").select(F.col("quote_id").alias("node"))).select(F.col("node").alias("quote_id"), F.lit(True).alias("w"))
    lost = (F.col("k") % 6 == 5) | (F.col("w").isNotNull() & F.col("basis").isin("COREFERENCE", "RESPONSE_LINK"))
    return o.join(warned, "quote_id", "left").select("quote_id", F.when(lost, "UNKNOWN").otherwise(F.col("assignment")).alias("assignment"), F.col("w").isNotNull().alias("warned"))


@query(with_sql("people").replace("WITH ", "WITH RECURSIVE ", 1) + """, f AS (SELECT person, 'r' || (person % 37) AS ref, 'c' || (person % 29) AS id, person % 10 IN (3, 7) AS failed FROM people), e AS (SELECT a.person AS a, b.person AS b FROM f a JOIN f b ON (a.ref = b.ref OR a.id = b.id) AND a.failed AND b.failed),
r AS (SELECT a, a AS l FROM e UNION SELECT e.b, r.l FROM r JOIN e ON e.a = r.a) SELECT a AS person, min(l) AS repair_group FROM r GROUP BY 1""")
def x46_repair_groups(s, d):
    """Failed people who share a reference or an id, whoever links them, are repaired together."""
    f = frame(s, d, "people").filter("person % 10 IN (3, 7)").select("person", F.explode(F.array(F.concat(F.lit("r"), (F.col("person") % 37).cast("string")), F.concat(F.lit("c"), (F.col("person") % 29).cast("string")))).alias("key"))
    hub = f.groupBy("key").agg(F.min("person").alias("b"))
    comp = graph.components(f.join(hub, "key").select(F.col("person").alias("a"), "b"))
    return comp.select(F.col("node").alias("person"), F.col("component").alias("repair_group"))
