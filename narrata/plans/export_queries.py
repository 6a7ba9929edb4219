"""Libraries, chapters, pages and exports, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from narrata.operators import export, graph, intervals, text
from narrata.plans.dialogue_queries import n, query
from narrata.plans.text_queries import MADE
from narrata.sources import pages
from narrata.sources.dialogue import table
from narrata.sources.model import frame, with_sql


def _plain(column: str) -> str:
    for entity, char in pages.ENTITIES.items():
        column = f"replace({column}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return column


def _marked(column: str) -> str:
    column = f"regexp_replace({column}, '(?s)<!--.*?-->', '', 'g')"
    for tag in pages.SKIPPED:
        column = f"regexp_replace({column}, '(?is)<{tag}\\b[^>]*>.*?</{tag}>', '', 'g')"
    return f"regexp_replace(replace({column}, chr(10), ' '), '(?i)</?(?:{pages.BLOCKS})\\b[^>]*>', chr(10), 'g')"


BLOCKS = f"""WITH m AS (SELECT page_id, string_split(regexp_replace({_marked('html')}, '<[^>]+>', '', 'g'), chr(10)) AS p FROM pages), l AS (SELECT page_id, unnest(p) AS x, generate_subscripts(p, 1) AS k FROM m),
t AS (SELECT page_id, k, trim(regexp_replace({_plain('x')}, '[ \\t\\r\\n\\f\\v\\x{{a0}}\\x{{3000}}]+', ' ', 'g')) AS text FROM l), b AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS block, text FROM t WHERE text <> '') """


@query(BLOCKS + "SELECT * FROM b")
def s10_page_blocks(s, d):
    return pages.blocks(table(s, d, "pages"))


@query(f"SELECT page_id, sha256({_plain('html')}) AS digest FROM pages")
def s12_entities(s, d):
    return table(s, d, "pages").select("page_id", F.sha2(pages.unescaped(F.col("html")).cast("binary"), 256).alias("digest"))


@query(BLOCKS + """, i AS (SELECT page_id, block, text, length(text) < 40 AS picture FROM b), g AS (SELECT *, sum(CASE WHEN picture THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY block) AS c FROM i)
SELECT page_id, block, CASE WHEN NOT picture THEN c WHEN c > 0 THEN c ELSE 1 END AS chapter FROM g""")
def s13_illustrations(s, d):
    """Short blocks, as pages of pictures, go to the chapter before; those at the start to the next one."""
    picture = F.length("text") < 40
    c = F.sum(F.when(picture, 0).otherwise(1)).over(Window.partitionBy("page_id").orderBy("block"))
    return pages.blocks(table(s, d, "pages")).withColumn("c", c).select("page_id", "block", F.when(F.col("c") > 0, F.col("c")).otherwise(1).alias("chapter"))


@query(BLOCKS + """, e AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY page_id ORDER BY block) AS e FROM b) SELECT page_id, block, CAST(e - length(text) - 1 AS BIGINT) AS start_cp, CAST(e - 1 AS BIGINT) AS end_cp, CAST(e AS BIGINT) AS map_end_cp FROM e""")
def s15_assembly(s, d):
    """Blocks one after another, a line feed after each; a mapping reaches to the next block."""
    e = F.sum(F.length("text").cast("long") + 1).over(Window.partitionBy("page_id").orderBy("block"))
    return pages.blocks(table(s, d, "pages")).withColumn("e", e).select("page_id", "block", (F.col("e") - F.length("text") - 1).alias("start_cp"), (F.col("e") - 1).alias("end_cp"), F.col("e").alias("map_end_cp"))


@query(BLOCKS + """, tc AS (SELECT page_id, block, text, block % 7 = 0 AS toc FROM b), c AS (SELECT *, count(*) FILTER (toc) OVER (PARTITION BY page_id ORDER BY block) AS chapter FROM tc)
SELECT page_id, chapter, max(CASE WHEN toc THEN text END) AS title, min(block) AS first, max(block) AS last FROM c GROUP BY 1, 2""")
def s14_toc_chapters(s, d):
    """Chapters from one target of the table of contents to the next."""
    toc = F.col("block") % 7 == 0
    c = pages.blocks(table(s, d, "pages")).withColumn("chapter", F.count_if(toc).over(Window.partitionBy("page_id").orderBy("block")))
    return c.groupBy("page_id", "chapter").agg(F.max(F.when(toc, F.col("text"))).alias("title"), F.min("block").alias("first"), F.max("block").alias("last"))


@query(MADE + """, seg AS (SELECT book, turn AS node, start_cp AS a, start_cp + length(seg) AS b FROM story), pt AS (SELECT DISTINCT book, node, unnest([greatest(a, k.start_cp), least(b, k.end_cp)]) AS pos FROM seg JOIN kept k USING (book) WHERE k.start_cp < b AND k.end_cp > a
  UNION SELECT book, node, unnest([a, b]) FROM seg), sl AS (SELECT book, node, pos, lead(pos) OVER (PARTITION BY book, node ORDER BY pos) AS "to" FROM pt)
SELECT s.book, s.node, CAST(s.pos AS BIGINT) AS start_cp, CAST(s."to" AS BIGINT) AS end_cp, min_by(k.quote_id, (k.end_cp - k.start_cp, k.start_cp)) AS item FROM sl s LEFT JOIN kept k ON k.book = s.book AND k.start_cp <= s.pos AND k.end_cp >= s."to" WHERE s."to" IS NOT NULL GROUP BY 1, 2, 3, 4""")
def d34_slices(s, d):
    """Segments cut at the bounds of quotes, each part with the innermost quote over it."""
    story = frame(s, d, "story")
    nodes = story.select("book", F.col("turn").alias("node"), F.col("start_cp").alias("l_start"), (F.col("start_cp") + F.length("seg")).alias("l_end"))
    q = text.scan_quotes(text.whole_texts(story)).select("book", F.col("quote_id").alias("item"), F.col("start_cp").alias("ordinal"), F.col("start_cp").alias("r_start"), F.col("end_cp").alias("r_end"))
    return export.slices(nodes, q)


ESC = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(with_sql("segments", "annotations") + f""", r AS (SELECT s.book, s.turn, '<p><span class="' || CASE WHEN a.status IS NOT NULL AND NOT a.stale THEN 'speaker-' || a.speaker ELSE 'plain' END || '">' || {ESC.format('s.quoted')} || '</span></p>' AS h FROM segments s LEFT JOIN annotations a ON a.book = s.book AND a.start_cp = s.start_cp)
SELECT book, '<!DOCTYPE html><meta charset="utf-8">' || string_agg(h, '' ORDER BY turn) AS html FROM r GROUP BY 1""")
def k1_html_pages(s, d):
    """A page a book, its quotes in the colours of their speakers."""
    a = frame(s, d, "annotations").select("book", "start_cp", "status", "stale", "speaker")
    seg = frame(s, d, "segments").select("book", "turn", "quoted", "start_cp").join(a, ["book", "start_cp"], "left")
    css = F.when(F.col("status").isNotNull() & ~F.col("stale"), F.concat(F.lit("speaker-"), "speaker")).otherwise("plain")
    h = F.concat(F.lit('<p><span class="'), css, F.lit('">'), export.escaped(F.col("quoted")), F.lit("</span></p>"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("turn", h.alias("h")))), lambda x: x["h"])
    return seg.groupBy("book").agg(F.concat(F.lit('<!DOCTYPE html><meta charset="utf-8">'), F.array_join(rows, "")).alias("html"))


@query(with_sql("annotations") + """SELECT book, sha256(string_agg(quote_id || '|' || speaker || '|' || status, chr(10) ORDER BY start_cp, quote_id)) AS digest, count(*) AS items FROM annotations WHERE NOT stale AND visible_from_cp <= 2000 GROUP BY 1""")
def d35_frozen_projection(s, d):
    """What an export freezes of each book, and its digest."""
    line = F.concat_ws("|", "quote_id", "speaker", "status").alias("x")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("start_cp", "quote_id", line))), lambda r: r["x"])
    return frame(s, d, "annotations").filter("NOT stale AND visible_from_cp <= 2000").groupBy("book").agg(F.sha2(F.array_join(rows, "\n").cast("binary"), 256).alias("digest"), n("items"))


VISIBLE = "regexp_replace(" + _plain("""regexp_replace(regexp_replace(html, '(?s)<span class="label"(?:\\s[^>]*)?>.*?</span>', '', 'g'), '<[^>]+>', '', 'g')""") + ", '\\s+', '', 'g')"


@query(f"""WITH f AS (SELECT page_id, html, regexp_extract_all(html, '(?s)<h1>(.*?)</h1>', 1) || ['nowhere to be found'] AS fragments, {VISIBLE} AS seen FROM pages)
SELECT page_id, trim(html) <> '' AS non_empty, contains(lower(html), 'charset') AS has_charset, NOT regexp_matches(html, '(?i)<script\\b') AS no_scripts,
  NOT (regexp_matches(html, '(?i)(?:src|href)\\s*=\\s*"\\s*(?:https?://|//|file:|ftp:)') OR regexp_matches(html, '(?i)url\\(\\s*["'']?(?:https?://|//|file:|ftp:)')) AS no_external, NOT regexp_matches(html, '(?i)localhost|127\\.0\\.0\\.1') AS no_localhost,
  CAST(len(list_filter(fragments, lambda x: length(regexp_replace(x, '\\s+', '', 'g')) >= 2 AND NOT contains(seen, regexp_replace(x, '\\s+', '', 'g')))) AS BIGINT) AS missing FROM f""")
def d36_page_checks(s, d):
    """Checks of every page: its heading must be seen, and a text that isn't there must be missed."""
    fragments = F.concat(F.regexp_extract_all("html", F.lit("(?s)<h1>(.*?)</h1>"), F.lit(1)), F.array(F.lit("nowhere to be found")))
    return export.page_checks(table(s, d, "pages").withColumn("fragments", fragments)).drop("html", "url", "fragments")


@query(with_sql("segments", "chapters") + """, b AS (SELECT s.book, c.ordinal, s.turn, sha256(regexp_replace(s.seg, '\\s+', '', 'g')) AS digest, length(regexp_replace(s.seg, '\\s+', '', 'g')) AS len FROM segments s JOIN chapters c ON c.book = s.book AND s.start_cp >= c.start_cp AND s.start_cp < c.end_cp),
m AS (SELECT *, CASE WHEN (book + turn) % 9 = 8 THEN 'changed' ELSE digest END AS was FROM b) SELECT book, ordinal, bool_and(digest = was) AS trusted, count(*) AS blocks, CAST(sum(len) AS BIGINT) AS length FROM m GROUP BY 1, 2""")
def d37_trusted_chapters(s, d):
    """A chapter's anchors count only if all its blocks are as they were."""
    c = frame(s, d, "chapters").select("book", "ordinal", F.col("start_cp").alias("r_start"), F.col("end_cp").alias("r_end"))
    b = intervals.containing(frame(s, d, "segments").withColumn("at", F.col("start_cp")), c)
    bare = F.regexp_replace("seg", "\\s+", "")
    b = b.select("book", "ordinal", "turn", F.sha2(bare.cast("binary"), 256).alias("digest"), F.length(bare).cast("long").alias("len"))
    was = F.when((F.col("book") + F.col("turn")) % 9 == 8, "changed").otherwise(F.col("digest"))
    return b.groupBy("book", "ordinal").agg(F.min(F.col("digest") == was).alias("trusted"), n("blocks"), F.sum("len").alias("length"))


@query(with_sql("segments") + """, a AS (SELECT *, start_cp + least(7 * turn, length(seg) - 1) AS cp FROM segments) SELECT book, turn, CAST(cp AS BIGINT) AS cp, length(regexp_replace(substring(seg, 1, CAST(cp - start_cp AS BIGINT)), '\\s+', '', 'g')) AS bare_offset FROM a""")
def d37_anchors(s, d):
    """Positions as offsets into text without white space, which survive a new layout."""
    a = frame(s, d, "segments").withColumn("cp", F.col("start_cp") + F.least(7 * F.col("turn"), F.length("seg") - 1))
    before = F.substring("seg", F.lit(1), (F.col("cp") - F.col("start_cp")).cast("int"))
    return a.select("book", "turn", "cp", F.length(F.regexp_replace(before, "\\s+", "")).cast("long").alias("bare_offset"))


CH = with_sql("chapters") + ", c AS (SELECT *, (book + ordinal) % 3 = 0 AS processed, 'T' || (ordinal % 2) AS title, end_cp - start_cp < 900 AS small FROM chapters) "


def with_titles(s, d):
    return frame(s, d, "chapters").withColumns({"processed": (F.col("book") + F.col("ordinal")) % 3 == 0, "title": F.concat(F.lit("T"), (F.col("ordinal") % 2).cast("string")), "small": F.col("end_cp") - F.col("start_cp") < 900})


@query(CH + "SELECT book, ordinal, title, start_cp, end_cp, row_number() OVER (PARTITION BY book ORDER BY ordinal) AS position FROM c WHERE processed")
def x2_processed_chapters(s, d):
    return with_titles(s, d).filter("processed").select("book", "ordinal", "title", "start_cp", "end_cp", F.row_number().over(Window.partitionBy("book").orderBy("ordinal")).alias("position"))


@query(CH + """, b AS (SELECT book, max(end_cp) AS length, max(end_cp) // 2 AS at, book % 4 <> 1 AS current FROM c GROUP BY 1)
SELECT b.book, b.length, CASE WHEN b.current THEN c.title END AS reading, CASE WHEN b.current THEN c.ordinal END AS chapter FROM b LEFT JOIN c ON c.book = b.book AND c.start_cp <= b.at AND b.at < c.end_cp""")
def x3_library(s, d):
    """Books with the title of the chapter that is being read, if that position is of the current version."""
    c = with_titles(s, d)
    b = c.groupBy("book").agg(F.max("end_cp").alias("length")).withColumns({"at": F.floor(F.col("length") / 2), "current": F.col("book") % 4 != 1})
    met = intervals.containing(b, c.select("book", "ordinal", "title", F.col("start_cp").alias("r_start"), F.col("end_cp").alias("r_end")))
    now = F.col("current")
    return b.select("book", "length").join(met.select("book", F.when(now, F.col("title")).alias("reading"), F.when(now, F.col("ordinal")).alias("chapter")), "book", "left")


@query(CH + "SELECT book, ordinal, NOT small OR (book + ordinal) % 5 = 0 AS has_body, small AND (book + ordinal) % 5 <> 0 AND NOT processed AS completed FROM c")
def x4_textless_chapters(s, d):
    """Chapters without text beyond their heading are done; here, small ones without a body node."""
    c = with_titles(s, d)
    bodies = c.filter("NOT small OR (book + ordinal) % 5 = 0").select("book", "ordinal", F.lit(True).alias("b"))
    return c.join(bodies, ["book", "ordinal"], "left").select("book", "ordinal", F.col("b").isNotNull().alias("has_body"), (F.col("b").isNull() & ~F.col("processed")).alias("completed"))


@query(CH + """, k AS (SELECT *, CASE WHEN ordinal = 0 OR processed OR NOT small THEN 1 ELSE 0 END AS keep FROM c), g AS (SELECT *, sum(keep) OVER (PARTITION BY book ORDER BY ordinal) AS grp FROM k)
SELECT book, CAST(grp - 1 AS BIGINT) AS ordinal, min(start_cp) AS start_cp, max(end_cp) AS end_cp, count(*) AS merged FROM g GROUP BY book, grp""")
def d57_chapter_repair(s, d):
    """Small chapters join the one before, unless they are processed; the rest is numbered anew."""
    keep = F.when((F.col("ordinal") == 0) | F.col("processed") | ~F.col("small"), 1).otherwise(0)
    g = with_titles(s, d).withColumn("keep", keep).withColumn("grp", F.sum("keep").over(Window.partitionBy("book").orderBy("ordinal")))
    return g.groupBy("book", (F.col("grp") - 1).alias("ordinal")).agg(F.min("start_cp").alias("start_cp"), F.max("end_cp").alias("end_cp"), n("merged"))


@query(CH + "SELECT book, coalesce(min(start_cp) FILTER (ordinal % 2 = 1), min(start_cp)) AS start_cp, coalesce(max(end_cp) FILTER (ordinal % 2 = 1), max(end_cp)) AS end_cp, count(*) FILTER (NOT processed) AS unprocessed FROM c GROUP BY 1")
def x26_snapshot_ranges(s, d):
    """The hull of the selected chapters (here the odd ones); without any, the whole book."""
    odd = F.col("ordinal") % 2 == 1
    return with_titles(s, d).groupBy("book").agg(
        F.coalesce(F.min(F.when(odd, F.col("start_cp"))), F.min("start_cp")).alias("start_cp"), F.coalesce(F.max(F.when(odd, F.col("end_cp"))), F.max("end_cp")).alias("end_cp"), F.count_if(~F.col("processed")).alias("unprocessed"),
    )


@query(BLOCKS + "SELECT page_id, block, text FROM b WHERE block < 12")
def x27_sample_blocks(s, d):
    return pages.blocks(table(s, d, "pages")).filter("block < 12")


@query("""WITH RECURSIVE e AS (SELECT event_id AS id, CASE WHEN event_id > 0 THEN (event_id - 1) // 3 END AS parent, event_type = 'purchase' AS included FROM events), k AS (SELECT id, parent FROM e WHERE included UNION SELECT e.id, e.parent FROM k JOIN e ON e.id = k.parent)
SELECT e.id, e.parent, e.included FROM e JOIN k ON k.id = e.id""")
def x28_navigation(s, d):
    """The entries of a tree that are included, and all above them."""
    i = F.col("event_id")
    e = table(s, d, "events").select(i.alias("id"), F.when(i > 0, F.floor((i - 1) / 3)).alias("parent"), (F.col("event_type") == "purchase").alias("included"))
    up = e.filter("parent IS NOT NULL").select(F.col("id").alias("source"), F.col("parent").alias("target"))
    kept = graph.reached(up, e.filter("included").select(F.col("id").alias("node")))
    return e.join(kept.withColumnRenamed("node", "id"), "id", "left_semi")


@query(with_sql("quotes", "gaps", "items", "scenes") + """, gone AS (SELECT quote_id AS id FROM quotes WHERE book % 3 = 0 UNION ALL SELECT gap_id FROM gaps WHERE book % 3 = 0), x AS (SELECT item, coalesce(quote_id, gap_id) AS target FROM items)
SELECT x.item, x.target IN (SELECT id FROM gone) AS deleted FROM x""")
def x30_deletion_cascade(s, d):
    """What goes with deleted books: all that refers to their quotes or gaps."""
    of = lambda name, key: frame(s, d, name).filter("book % 3 = 0").select(F.col(key).alias("target"), F.lit(True).alias("gone"))
    gone = of("quotes", "quote_id").unionByName(of("gaps", "gap_id"))
    x = frame(s, d, "items").select("item", F.coalesce("quote_id", "gap_id").alias("target"))
    return x.join(gone, "target", "left").select("item", F.coalesce("gone", F.lit(False)).alias("deleted"))


@query(with_sql("outputs") + """, r AS (SELECT book, quote_id, k, kind, start_cp, CASE WHEN k % 4 = 0 THEN '  ' ELSE kind END AS text FROM outputs) SELECT book, quote_id, 'B' || row_number() OVER (PARTITION BY book ORDER BY start_cp) AS ref FROM r WHERE trim(text) <> ''""")
def x37_nonblank_evidence(s, d):
    r = frame(s, d, "outputs").withColumn("text", F.when(F.col("k") % 4 == 0, "  ").otherwise(F.col("kind"))).filter(F.trim("text") != "")
    return r.select("book", "quote_id", F.concat(F.lit("B"), F.row_number().over(Window.partitionBy("book").orderBy("start_cp")).cast("string")).alias("ref"))


@query(with_sql("outputs") + """SELECT quote_id, CASE WHEN kind IN ('group', 'other', 'unknown') THEN CASE WHEN basis IS NULL OR lower(basis) = 'direct' THEN NULL ELSE basis END ELSE basis END AS basis, CASE WHEN kind IN ('group', 'other', 'unknown') AND assignment = 'UNKNOWN' THEN NULL ELSE assignment END AS assignment FROM outputs""")
def x38_normalized_labels(s, d):
    """Fields that mean nothing for a kind are dropped; labels of speech stay as they are."""
    inert = F.col("kind").isin("group", "other", "unknown")
    drop = lambda c, bad: F.when(inert & bad, None).otherwise(F.col(c)).alias(c)
    return frame(s, d, "outputs").select("quote_id", drop("basis", F.lower("basis") == "direct"), drop("assignment", F.col("assignment") == "UNKNOWN"))


@query(with_sql("outputs") + """SELECT quote_id, CASE WHEN e_self IS NULL AND e_prev IS NULL THEN 'blank_evidence' WHEN basis = 'DIRECT' AND e_prev IS NULL THEN 'direct_inside_target' ELSE 'grounded' END AS verdict FROM outputs WHERE kind = 'speech'""")
def x39_grounding(s, d):
    from narrata.operators.decisions import with_evidence

    o = with_evidence(frame(s, d, "outputs")).filter("kind = 'speech'")
    outside = F.exists("evidence", lambda e: e != F.col("quote_id"))
    verdict = F.when(F.size("evidence") == 0, "blank_evidence").when((F.col("basis") == "DIRECT") & ~outside, "direct_inside_target").otherwise("grounded")
    return o.select("quote_id", verdict.alias("verdict"))


@query(CH + """, old AS (SELECT book, ordinal, start_cp, end_cp FROM c WHERE ordinal % 4 <> 3), new AS (SELECT book, ordinal, start_cp, CASE WHEN book % 4 = 2 AND ordinal = 1 THEN end_cp - 1 ELSE end_cp END AS end_cp FROM c UNION ALL SELECT book, 99, max(end_cp), max(end_cp) FROM c GROUP BY 1)
SELECT o.book, count(*) FILTER (n.book IS NULL) AS lost, coalesce(max(x.extra), 0) AS long_extras FROM old o LEFT JOIN new n ON n.book = o.book AND n.start_cp = o.start_cp AND n.end_cp = o.end_cp
LEFT JOIN (SELECT n.book, count(*) AS extra FROM new n WHERE n.end_cp > n.start_cp AND NOT EXISTS (SELECT 1 FROM old o WHERE o.book = n.book AND o.start_cp = n.start_cp AND o.end_cp = n.end_cp) GROUP BY 1) x ON x.book = o.book GROUP BY 1""")
def x54_toc_restore(s, d):
    """Whether all stored chapters are among the parsed ones, and parsed ones beyond them are empty."""
    c = with_titles(s, d)
    old = c.filter("ordinal % 4 <> 3").select("book", "start_cp", "end_cp")
    end = F.when((F.col("book") % 4 == 2) & (F.col("ordinal") == 1), F.col("end_cp") - 1).otherwise(F.col("end_cp"))
    last = c.groupBy("book").agg(F.max("end_cp").alias("start_cp"), F.max("end_cp").alias("end_cp"))
    new = c.select("book", "start_cp", end.alias("end_cp")).unionByName(last)
    keys = ["book", "start_cp", "end_cp"]
    lost = old.join(new, keys, "left_anti").groupBy("book").agg(n("lost"))
    extra = new.join(old, keys, "left_anti").filter("end_cp > start_cp").groupBy("book").agg(n("long_extras"))
    return old.select("book").distinct().join(lost, "book", "left").join(extra, "book", "left").na.fill(0)


@query("SELECT source, to_json({'source': source, 'documents': count(*), 'chars': CAST(sum(n_chars) AS BIGINT)}) AS report FROM documents GROUP BY source")
def k3_reports(s, d):
    g = table(s, d, "documents").groupBy("source").agg(n("documents"), F.sum("n_chars").alias("chars"))
    return g.select("source", F.to_json(F.struct("source", "documents", "chars")).alias("report"))


@query("SELECT doc_id, json_extract_string(j, '$.lang') AS lang, CAST(json_extract_string(j, '$.n') AS BIGINT) AS n FROM (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE to_json({'lang': lang, 'n': n_chars}) END AS j FROM documents)")
def s20_json_rows(s, d):
    """Rows of JSON read by a schema; a malformed one gives nulls."""
    raw = F.when(F.col("doc_id") % 11 == 0, F.lit('{"lang": oops')).otherwise(F.to_json(F.struct("lang", F.col("n_chars").alias("n"))))
    return table(s, d, "documents").select("doc_id", F.from_json(raw, "lang string, n bigint").alias("j")).select("doc_id", "j.lang", "j.n")


@query(CH + ", t AS (SELECT *, CASE WHEN title = 'T1' THEN 'T1' WHEN contains(title, 'T') AND ordinal > 1 THEN 'T' END AS hit FROM c) SELECT book, ordinal, hit FROM t WHERE hit IS NOT NULL")
def f9_chapter_filter(s, d):
    """The first term that a title is, or holds."""
    hit = F.when(F.col("title") == "T1", "T1").when(F.contains("title", F.lit("T")) & (F.col("ordinal") > 1), "T")
    return with_titles(s, d).select("book", "ordinal", hit.alias("hit")).filter("hit IS NOT NULL")


@query(with_sql("pred", "chapters") + "SELECT p.book, p.key, p.start_cp >= 0 AND p.start_cp <= p.end_cp AND p.end_cp <= c.len AS valid FROM pred p JOIN (SELECT book, max(end_cp) - 300 AS len FROM chapters GROUP BY 1) c ON c.book = p.book")
def f10_range_validity(s, d):
    c = frame(s, d, "chapters").groupBy("book").agg((F.max("end_cp") - 300).alias("len"))
    ok = (F.col("start_cp") >= 0) & (F.col("start_cp") <= F.col("end_cp")) & (F.col("end_cp") <= F.col("len"))
    return frame(s, d, "pred").join(c, "book").select("book", "key", ok.alias("valid"))


@query(with_sql("annotations") + "SELECT book, quote_id, least(end_cp, 1500) AS end_cp, end_cp > 1500 AS truncated FROM annotations WHERE (turn % 3 = 0 AND start_cp < 1500) OR (turn % 3 <> 0 AND end_cp <= 1500)")
def f7_fragments_in_horizon(s, d):
    """Optional fragments beyond the horizon go, required ones are cut there."""
    need = F.col("turn") % 3 == 0
    keep = F.when(need, F.col("start_cp") < 1500).otherwise(F.col("end_cp") <= 1500)
    return frame(s, d, "annotations").filter(keep).select("book", "quote_id", F.least("end_cp", F.lit(1500).cast("long")).alias("end_cp"), (F.col("end_cp") > 1500).alias("truncated"))


@query(with_sql("outputs") + "SELECT size, book, CAST(floor((i - 1) / size) AS BIGINT) AS block, count(*) AS targets FROM (SELECT book, row_number() OVER (PARTITION BY book ORDER BY start_cp) AS i FROM outputs) CROSS JOIN (SELECT unnest([8, 16, 32]) AS size) GROUP BY 1, 2, 3")
def w5_blocks_of_sizes(s, d):
    o = frame(s, d, "outputs").select("book", F.row_number().over(Window.partitionBy("book").orderBy("start_cp")).alias("i"))
    o = o.withColumn("size", F.explode(F.array(*map(F.lit, (8, 16, 32)))))
    return o.groupBy("size", "book", F.floor((F.col("i") - 1) / F.col("size")).alias("block")).agg(n("targets"))


@query(with_sql("quotes") + "SELECT book, quote_id, row_number() OVER (PARTITION BY book ORDER BY start_cp) AS position FROM (SELECT *, row_number() OVER w AS back, sum(length(quoted)) OVER w AS spent FROM quotes WINDOW w AS (PARTITION BY book ORDER BY start_cp DESC)) WHERE back <= 8 AND spent <= 1500")
def w7_turns_in_budget(s, d):
    """The last turns that fit a budget, spent from the newest on, in the order of the text."""
    w = Window.partitionBy("book").orderBy(F.desc("start_cp"))
    q = frame(s, d, "quotes").withColumns({"back": F.row_number().over(w), "spent": F.sum(F.length("quoted")).over(w)}).filter("back <= 8 AND spent <= 1500")
    return q.select("book", "quote_id", F.row_number().over(Window.partitionBy("book").orderBy("start_cp")).alias("position"))


@query(with_sql("people") + """, r AS (SELECT book, person, person % 10 = 0 AS pinned, person % 7 AS hits, first_cp FROM people), k AS (SELECT *, row_number() OVER (PARTITION BY book, pinned ORDER BY hits DESC, first_cp, person) AS j, count(*) FILTER (pinned) OVER (PARTITION BY book) AS pins FROM r)
SELECT book, person, pinned FROM k WHERE pinned OR j <= greatest(0, 4 - pins)""")
def o4_pinned_candidates(s, d):
    """All pinned people, and the best others up to the limit."""
    r = frame(s, d, "people").withColumns({"pinned": F.col("person") % 10 == 0, "hits": F.col("person") % 7})
    j = F.row_number().over(Window.partitionBy("book", "pinned").orderBy(F.desc("hits"), "first_cp", "person"))
    pins = F.count_if("pinned").over(Window.partitionBy("book"))
    return r.withColumns({"j": j, "pins": pins}).filter(F.col("pinned") | (F.col("j") <= F.greatest(F.lit(0), 4 - F.col("pins")))).select("book", "person", "pinned")


@query(with_sql("facts") + """, d AS (SELECT person, idx, visible_from_cp, least(abs(visible_from_cp - 200), abs(visible_from_cp - 600)) AS dist FROM facts) SELECT person, idx, dist FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY dist, visible_from_cp, idx) AS k FROM d) WHERE k <= 2""")
def o5_anchors_of_edges(s, d):
    """The two facts of each person that are nearest to either edge of a window."""
    dist = F.least(F.abs(F.col("visible_from_cp") - 200), F.abs(F.col("visible_from_cp") - 600))
    w = Window.partitionBy("person").orderBy("dist", "visible_from_cp", "idx")
    return frame(s, d, "facts").withColumn("dist", dist).withColumn("k", F.row_number().over(w)).filter("k <= 2").select("person", "idx", "dist")


@query("""WITH r AS (SELECT doc_id, CASE WHEN n_chars < 300 THEN '' WHEN n_chars < 600 THEN lang ELSE CAST(n_chars - 800 AS VARCHAR) END AS raw FROM documents), v AS (SELECT *, CASE WHEN raw = '' THEN 50 ELSE TRY_CAST(raw AS INTEGER) END AS number FROM r)
SELECT doc_id, raw, CASE WHEN number BETWEEN 1 AND 200 THEN number END AS value, CASE WHEN number IS NULL THEN 'not_a_number' WHEN number NOT BETWEEN 1 AND 200 THEN 'out_of_range' END AS error FROM v""")
def o7_limits(s, d):
    """Limits of a page as given: 50 if none, 200 at most."""
    size = F.col("n_chars")
    raw = F.when(size < 300, "").when(size < 600, F.col("lang")).otherwise((size - 800).cast("string"))
    t = table(s, d, "documents").select("doc_id", raw.alias("raw"))
    number = F.when(F.col("raw") == "", F.lit(50)).otherwise(F.col("raw").try_cast("int"))
    ok = number.between(1, 200)
    return t.select("doc_id", "raw", F.when(ok, number).alias("value"), F.when(number.isNull(), "not_a_number").when(~ok, "out_of_range").alias("error"))


@query(with_sql("outputs") + "SELECT tag, count(*) AS quotes, count(DISTINCT book) AS books FROM (SELECT book, unnest(list_filter([kind, assignment, basis, CASE WHEN e_prev IS NULL THEN 'alone' END], lambda x: x IS NOT NULL)) AS tag FROM outputs) GROUP BY 1")
def a11_tag_histogram(s, d):
    tags = F.array_compact(F.array("kind", "assignment", "basis", F.when(F.col("e_prev").isNull(), "alone")))
    return frame(s, d, "outputs").select("book", F.explode(tags).alias("tag")).groupBy("tag").agg(n("quotes"), F.count_distinct("book").alias("books"))


@query("SELECT n_nationkey AS nation, coalesce(max(c_custkey), 0) AS last, coalesce(max(c_custkey) + 1, 0) AS next FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal < 500 GROUP BY 1")
def a12_next_ordinals(s, d):
    c = table(s, d, "customer").filter("c_acctbal < 500").groupBy("c_nationkey").agg(F.max("c_custkey").alias("m"))
    t = table(s, d, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    zero = F.lit(0).cast("long")
    return t.select(F.col("n_nationkey").alias("nation"), F.coalesce("m", zero).alias("last"), F.coalesce(F.col("m") + 1, zero).alias("next"))


@query("SELECT l_partkey AS key FROM lineitem WHERE l_quantity > 45 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity < 5")
def u2_rare_parts(s, d):
    t = table(s, d, "lineitem")
    return t.filter("l_quantity > 45").select(F.col("l_partkey").alias("key")).subtract(t.filter("l_quantity < 5").select("l_partkey"))


@query(with_sql("segments", "quotes", "gaps") + """, w AS (SELECT book, string_agg(seg, '' ORDER BY turn) AS text FROM segments GROUP BY 1)
SELECT q.quote_id, substring(w.text, CAST(greatest(q.start_cp - 120, 0) AS BIGINT) + 1, CAST(q.start_cp - greatest(q.start_cp - 120, 0) AS BIGINT)) AS before, substring(w.text, CAST(q.end_cp AS BIGINT) + 1, 120) AS after,
  lag(q.quote_id) OVER o AS prev_id, lead(q.quote_id) OVER o AS next_id, g.gap_id AS gap_before FROM quotes q JOIN w ON w.book = q.book LEFT JOIN gaps g ON g.right_id = q.quote_id WINDOW o AS (PARTITION BY q.book ORDER BY q.start_cp)""")
def x1_quote_detail(s, d):
    """A quote with 120 code points on each side, its neighbours and the gap before it."""
    whole = text.whole_texts(frame(s, d, "segments"))
    w = Window.partitionBy("book").orderBy("start_cp")
    q = frame(s, d, "quotes").select("book", "quote_id", "start_cp", "end_cp", F.lag("quote_id").over(w).alias("prev_id"), F.lead("quote_id").over(w).alias("next_id"))
    g = frame(s, d, "gaps").select(F.col("right_id").alias("quote_id"), F.col("gap_id").alias("gap_before"))
    a = F.greatest(F.col("start_cp") - 120, F.lit(0))
    return q.join(g, "quote_id", "left").join(whole, "book").select(
        "quote_id", F.substring("text", (a + 1).cast("int"), (F.col("start_cp") - a).cast("int")).alias("before"), F.substring("text", (F.col("end_cp") + 1).cast("int"), F.lit(120)).alias("after"), "prev_id", "next_id", "gap_before",
    )


@query(with_sql("quotes") + ", w AS (SELECT DISTINCT book, unnest([0, 1000, 2500]) AS a FROM quotes) SELECT w.book, CAST(w.a AS BIGINT) AS start_cp, string_agg(CAST(q.turn AS STRING), ',' ORDER BY q.turn) AS turns FROM w JOIN quotes q ON q.book = w.book AND q.start_cp < w.a + 900 AND q.end_cp > w.a GROUP BY 1, 2")
def j6_ranges_in_order(s, d):
    """What overlaps each of some ranges, in the items' own order."""
    q = frame(s, d, "quotes").select("book", "turn", F.col("start_cp").alias("r_start"), F.col("end_cp").alias("r_end"))
    w = q.select("book").distinct().select("book", F.explode(F.array(*(F.lit(x).cast("long") for x in (0, 1000, 2500)))).alias("l_start")).withColumn("l_end", F.col("l_start") + 900)
    turns = F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda x: x.cast("string")), ",")
    return intervals.overlapping(w, q).groupBy("book", F.col("l_start").alias("start_cp")).agg(turns.alias("turns"))
