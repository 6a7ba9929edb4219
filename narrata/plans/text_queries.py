"""Ingestion and span extraction over whole texts, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from narrata.operators import text
from narrata.plans.dialogue_queries import n, query
from narrata.sources.dialogue import table
from narrata.sources.model import frame, with_sql

#: The quotes of the story by how it was made: outer ones, and the two that some turns nest in them.
MADE = with_sql("story") + """, made AS (
  SELECT book, turn, role, start_cp, start_cp + length(quoted) AS end_cp, 0 AS depth, CAST(NULL AS BIGINT) AS parent_start, 'corner_bracket' AS delimiter, CAST(NULL AS STRING) AS kind_hint FROM story
  UNION ALL SELECT book, turn, role, start_cp + 1 + length(t), start_cp + 10 + length(t), 1, CASE WHEN length(quoted) <= 1200 THEN start_cp END, 'corner_bracket_double', 'quotation' FROM story WHERE turn % 3 = 1
  UNION ALL SELECT book, turn, role, start_cp + 4 + length(t), start_cp + 9 + length(t), 2, start_cp + 1 + length(t), 'corner_bracket', NULL FROM story WHERE turn % 3 = 1),
kept AS (SELECT *, 'q' || substring(sha1(book || '|' || start_cp || '|' || end_cp || '|scanner-1'), 1, 31) AS quote_id FROM made WHERE end_cp - start_cp <= 1200),
tops AS (SELECT *, lead(start_cp) OVER w AS next_cp, lead(quote_id) OVER w AS next_id, lead(turn) OVER w AS next_turn FROM kept WHERE depth = 0 WINDOW w AS (PARTITION BY book ORDER BY start_cp)) """


def story_quotes(s, d):
    return text.scan_quotes(frame(s, d, "story"))


@query(MADE + """, ch AS (SELECT book, CAST(floor(turn / 4) AS BIGINT) AS ordinal, min(start_cp) AS a, max(start_cp + length(seg)) AS b FROM story GROUP BY 1, 2)
SELECT k.book, k.quote_id, k.start_cp, k.end_cp, coalesce(c.ordinal, l.ordinal) AS chapter, CASE WHEN next_cp > k.end_cp THEN next_cp - k.end_cp END AS gap_after
FROM tops k LEFT JOIN ch c ON c.book = k.book AND k.start_cp >= c.a AND k.start_cp < c.b JOIN (SELECT book, max(ordinal) AS ordinal FROM ch GROUP BY 1) l ON l.book = k.book""")
def t1_quotes(s, d):
    """Outer quotes as scanned, with their chapters (the last one, where none holds them) and the gap after."""
    from narrata.operators import intervals

    story = frame(s, d, "story")
    ch = story.groupBy("book", F.floor(F.col("turn") / 4).alias("chapter")).agg(F.min("start_cp").alias("r_start"), F.max(F.col("start_cp") + F.length("seg")).alias("r_end"))
    w = Window.partitionBy("book").orderBy("start_cp")
    top = text.scan_quotes(story).filter("depth = 0")
    gap = F.lead("start_cp").over(w) - F.col("end_cp")
    top = top.select("book", "quote_id", "start_cp", "end_cp", F.when(gap > 0, gap).alias("gap_after"))
    return intervals.with_range_or_last(top, ch, "start_cp", "chapter")


@query(MADE + "SELECT k.book, k.quote_id, k.start_cp, k.end_cp, k.delimiter, k.depth, p.quote_id AS parent_id, k.kind_hint FROM kept k LEFT JOIN kept p ON p.book = k.book AND p.start_cp = k.parent_start")
def t1_nested_quotes(s, d):
    return story_quotes(s, d).select("book", "quote_id", "start_cp", "end_cp", "delimiter", "depth", "parent_id", "kind_hint")


_PAIRS = ", ".join(f"('{o}', '{c}', '{text.NAMES[o]}', {repr(text.HINTS[o]) if o in text.HINTS else 'NULL'}, {repr(text.HINTS[o]) if o in text.HINTS else chr(39) + 'quotation' + chr(39) if o == '『' else 'NULL'})" for o, c in text.PAIRS.items())


@query(with_sql("story") + f"""SELECT opening, closing, delimiter, hint, nested_hint, (SELECT count(*) FROM (SELECT unnest(string_split(seg, '')) AS c FROM story) WHERE c = opening) AS opened, (SELECT count(*) FROM (SELECT unnest(string_split(seg, '')) AS c FROM story) WHERE c = closing) AS closed
FROM (VALUES {_PAIRS}) t(opening, closing, delimiter, hint, nested_hint)""")
def t2_delimiters(s, d):
    """Every pair of delimiters with the kinds that it hints at, and how often the texts open and close it."""
    rows = [(o, c, text.NAMES[o], text.HINTS.get(o), "quotation" if o == "『" else text.HINTS.get(o)) for o, c in text.PAIRS.items()]
    pairs = s.createDataFrame(rows, "opening string, closing string, delimiter string, hint string, nested_hint string")
    held = lambda c: F.sum(F.length("seg") - F.length(F.replace("seg", F.lit(c), F.lit("")))).cast("long")
    seen = frame(s, d, "story").agg(*[F.struct(F.lit(o).alias("opening"), F.coalesce(held(o), F.lit(0)).alias("opened"), F.coalesce(held(c), F.lit(0)).alias("closed")).alias(f"p{k}") for k, (o, c) in enumerate(text.PAIRS.items())])
    counts = seen.select(F.explode(F.array(*seen.columns)).alias("p")).select("p.*")
    return pairs.join(counts, "opening")


@query(MADE + """SELECT s.book, coalesce(q, 0) AS quotes, coalesce(t, 0) AS top_level_quotes, coalesce(bad, 0) AS warnings, 0 AS abandoned_open_quotes, 0 AS stray_closes, 0 AS unclosed_quotes,
  coalesce(bad, 0) AS dropped_too_long, 0 AS dropped_too_many_paragraphs, 0 AS depth_limit_hits, 0 AS normalized_closes FROM (SELECT DISTINCT book FROM story) s
  LEFT JOIN (SELECT book, count(*) AS q, count(*) FILTER (depth = 0) AS t FROM kept GROUP BY 1) k ON k.book = s.book
  LEFT JOIN (SELECT book, count(*) AS bad FROM made WHERE end_cp - start_cp > 1200 GROUP BY 1) m ON m.book = s.book""")
def t3_scan_stats(s, d):
    return text.scan_stats(frame(s, d, "story"))


@query(None)
def t3_scan_stats_of_marked_texts(s, d):
    """The counters for the documents, with letters turned into delimiters that don't match up."""
    marked = F.translate("text", ".,xzqj'", "」「『』“”‘")
    return text.scan_stats(table(s, d, "documents").select(F.col("doc_id").alias("book"), F.coalesce(marked, F.lit("")).alias("text")))


@query(MADE + """SELECT book, 'g' || substring(sha1(book || '|' || end_cp || '|' || next_cp || '|scanner-1'), 1, 31) AS gap_id, quote_id AS left_id, next_id AS right_id, end_cp AS start_cp, next_cp AS end_cp
FROM tops WHERE next_cp > end_cp AND NOT (turn % 4 = 3 AND next_turn = turn + 1)""")
def t8_narration_gaps(s, d):
    """Gaps between adjacent outer quotes that hold more than white space."""
    return text.narration_gaps(text.whole_texts(frame(s, d, "story")), story_quotes(s, d)).select("book", "gap_id", "left_id", "right_id", "start_cp", "end_cp")


@query(MADE + """, old AS (SELECT book, 'old-' || turn AS old_id, CASE WHEN turn % 5 = 4 THEN start_cp + 1 ELSE start_cp END AS start_cp, turn % 2 = 0 AS annotated FROM tops WHERE turn % 6 <> 5)
SELECT coalesce(o.book, k.book) AS book, coalesce(o.start_cp, k.start_cp) AS start_cp, coalesce(o.old_id, k.quote_id) AS quote_id,
  CASE WHEN o.old_id IS NULL THEN 'new' WHEN k.quote_id IS NULL THEN 'protected' ELSE 'updated' END AS outcome
FROM old o FULL JOIN kept k ON k.book = o.book AND k.start_cp = o.start_cp WHERE k.quote_id IS NOT NULL OR o.annotated""")
def t10_rescan_merge(s, d):
    """A new scan meets stored quotes by their start: ids stay, vanished quotes go unless annotated."""
    scan = story_quotes(s, d).select("book", "start_cp", "end_cp", "quote_id", "depth")
    turns = frame(s, d, "story").select("book", "turn", "start_cp")
    old = scan.filter("depth = 0").join(turns, ["book", "start_cp"]).filter("turn % 6 <> 5")
    old = old.select("book", F.concat(F.lit("old-"), F.col("turn").cast("string")).alias("old_id"), F.when(F.col("turn") % 5 == 4, F.col("start_cp") + 1).otherwise(F.col("start_cp")).alias("start_cp"), (F.col("turn") % 2 == 0).alias("annotated"))
    return text.rescanned(old, scan)


@query("""SELECT doc_id, count(*) AS sentences, CAST(sum(length(s)) AS BIGINT) AS chars, CAST(sum(CASE WHEN regexp_matches(s, '[「」『』“”"'']') OR regexp_matches(s, '""" + "|".join(text.CUES) + """') THEN 1 ELSE 0 END) AS BIGINT) AS cues
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^。！？!?\\n]*[。！？!?\\n]|[^。！？!?\\n]+$')) AS s FROM documents) WHERE s <> '' GROUP BY 1""")
def t11_sentences(s, d):
    # Counted within each text's array: no row a sentence, no shuffle.
    t = table(s, d, "documents").filter("text <> ''").select("doc_id", text.parts(F.col("text")).alias("p"))
    chars = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return t.select("doc_id", F.size("p").cast("long").alias("sentences"), chars.alias("chars"), F.size(F.filter("p", text.has_cue)).cast("long").alias("cues"))


@query("""SELECT doc_id, CAST(k AS BIGINT) AS sentence, CAST(e - length(s) AS BIGINT) AS start_cp, CAST(e AS BIGINT) AS end_cp FROM (
  SELECT doc_id, k, s, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM (
    SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) - 1 AS k FROM (SELECT doc_id, regexp_extract_all(text, '[^。！？!?\\n]*[。！？!?\\n]+[…」』”’）)\\n]*|[^。！？!?\\n]+$') AS p FROM documents)))""")
def t12_sentence_ranges(s, d):
    parts = F.regexp_extract_all("text", F.lit(r"[^。！？!?\n]*[。！？!?\n]+[…」』”’）)\n]*|[^。！？!?\n]+$"), F.lit(0))
    t = table(s, d, "documents").select("doc_id", F.posexplode(parts).alias("k", "s")).filter("s <> ''")
    w = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("s").cast("long")).over(w)
    return t.select("doc_id", F.col("k").cast("long").alias("sentence"), (end - F.length("s")).alias("start_cp"), end.alias("end_cp"))


@query(MADE + "SELECT k.book, k.quote_id, substring(w.text, CAST(k.start_cp AS BIGINT) + 1, CAST(k.end_cp - k.start_cp AS BIGINT)) AS slice FROM kept k JOIN (SELECT book, string_agg(seg, '' ORDER BY turn) AS text FROM story GROUP BY 1) w ON w.book = k.book")
def t13_slices(s, d):
    whole = text.whole_texts(frame(s, d, "story"))
    return text.scan_quotes(whole).join(whole, "book").select("book", "quote_id", F.substring("text", (F.col("start_cp") + 1).cast("int"), (F.col("end_cp") - F.col("start_cp")).cast("int")).alias("slice"))


@query("SELECT doc_id, regexp_matches(text, '[「」『』“”\"'']') OR regexp_matches(text, '" + "|".join(text.CUES) + "') AS has_cue FROM documents")
def t14_cue_marks(s, d):
    return table(s, d, "documents").select("doc_id", text.has_cue(F.col("text")).alias("has_cue"))


@query("SELECT page_id, sha256(trim(regexp_replace(html, '[ \\t\\r\\n\\f\\v\\x{a0}\\x{3000}]+', ' ', 'g'))) AS digest FROM pages")
def t15_collapsed(s, d):
    return table(s, d, "pages").select("page_id", F.sha2(F.trim(F.regexp_replace("html", "[ \\t\\r\\n\\f\\x0b\\u00a0\\u3000]+", " ")).cast("binary"), 256).alias("digest"))


LINES = with_sql("headed") + """, ls AS (SELECT book, line, body, sep, e, e - CASE WHEN sep = '' THEN 0 ELSE 1 END AS te, se - length(sep) - length(body) AS ss FROM (
  SELECT *, sum(length(body) + CASE WHEN sep = '' THEN 0 ELSE 1 END) OVER w AS e, sum(length(body) + length(sep)) OVER w AS se FROM headed WHERE body <> '' OR sep <> ''
  WINDOW w AS (PARTITION BY book ORDER BY line))),
hs AS (SELECT *, trim(body) AS title, length(trim(body)) BETWEEN 1 AND 30 AND NOT (trim(body) LIKE '第%' AND regexp_matches(trim(body), '[，、。！!；;…]'))
  AND regexp_matches(trim(body), '^(第[0-9一二三四五六七八九十百千万零〇两]+[章节節回卷篇部][^\\n]{0,20}|序章|序言|序|楔子|引子|前言|后记|尾声|终章|终幕|外传|番外)[^\\n]{0,20}$') AS heading FROM ls),
os AS (SELECT *, heading AND NOT coalesce(title = '序章' AND suffix(lt, title) AND lh, false) AS opens FROM (
  SELECT *, last_value(CASE WHEN title <> '' THEN title END IGNORE NULLS) OVER w AS lt, last_value(CASE WHEN title <> '' THEN heading END IGNORE NULLS) OVER w AS lh FROM hs
  WINDOW w AS (PARTITION BY book ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
cs AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY book ORDER BY line) AS c FROM os),
ps AS (SELECT *, CASE WHEN max(CAST(opens AS INT)) OVER b = 0 THEN 0 WHEN c = 0 THEN CASE WHEN max(CASE WHEN c = 0 AND title <> '' THEN 1 ELSE 0 END) OVER b = 1 THEN 0 END
  ELSE c - 1 + max(CASE WHEN c = 0 AND title <> '' THEN 1 ELSE 0 END) OVER b END AS ordinal FROM cs WINDOW b AS (PARTITION BY book)) """


def headed_lines(s, d):
    rows = F.array_sort(F.collect_list(F.struct("line", "body", "sep")))
    texts = frame(s, d, "headed").groupBy("book").agg(F.array_join(F.transform(rows, lambda x: F.concat(x["body"], x["sep"])), "").alias("text"))
    return text.split_lines(texts)


@query(LINES + "SELECT book, line, length(body) AS n, CAST(te - length(body) AS BIGINT) AS start_cp, CAST(te AS BIGINT) AS text_end_cp, CAST(e AS BIGINT) AS end_cp, CAST(ss AS BIGINT) AS source_start_cp, CAST(ss + length(body) AS BIGINT) AS source_end_cp, sep NOT IN ('', chr(10)) AS synthetic FROM ls")
def s5_dual_offsets(s, d):
    return headed_lines(s, d).select("book", "line", F.length("body").cast("long").alias("n"), "start_cp", "text_end_cp", "end_cp", "source_start_cp", "source_end_cp", "synthetic")


@query(LINES + "SELECT book, CAST(ordinal AS BIGINT) AS ordinal, max(CASE WHEN opens THEN title END) AS title, CAST(min(te - length(body)) AS BIGINT) AS start_cp, CAST(max(e) AS BIGINT) AS end_cp FROM ps WHERE ordinal IS NOT NULL GROUP BY 1, 2")
def s6_chapters(s, d):
    t = text.chaptered(headed_lines(s, d)).filter("ordinal IS NOT NULL")
    return t.groupBy("book", "ordinal").agg(F.max(F.when(F.col("opens"), F.col("title"))).alias("title"), F.min("start_cp").alias("start_cp"), F.max("end_cp").alias("end_cp"))


@query(LINES + "SELECT book, line, length(title) > 50 OR regexp_matches(title, '[，、。！!；;…]') AS suspicious, heading, opens FROM ps")
def s7_headings(s, d):
    return text.chaptered(headed_lines(s, d)).select("book", "line", text.suspicious(F.col("title")).alias("suspicious"), "heading", "opens")


@query(LINES + """SELECT book, CAST(ordinal AS BIGINT) AS chapter, 'n' || lpad(CAST(row_number() OVER (PARTITION BY book, ordinal ORDER BY line) - 1 AS STRING), 5, '0') AS node_id,
  CASE WHEN heading THEN 'heading' ELSE 'paragraph' END AS kind, CAST(te - length(body) AS BIGINT) AS start_cp, CAST(te AS BIGINT) AS end_cp FROM ps WHERE title <> '' AND ordinal IS NOT NULL""")
def s4_nodes(s, d):
    """A node for each line with text, numbered within its chapter."""
    t = text.chaptered(headed_lines(s, d)).filter("title <> '' AND ordinal IS NOT NULL")
    k = F.row_number().over(Window.partitionBy("book", "ordinal").orderBy("line")) - 1
    return t.select("book", F.col("ordinal").alias("chapter"), F.format_string("n%05d", k).alias("node_id"), F.when(F.col("heading"), "heading").otherwise("paragraph").alias("kind"), "start_cp", F.col("text_end_cp").alias("end_cp"))


@query(LINES + """, ch AS (SELECT book, CAST(ordinal AS BIGINT) AS ordinal, CAST(min(te - length(body)) AS BIGINT) AS a, CAST(max(e) AS BIGINT) AS b FROM ps WHERE ordinal IS NOT NULL GROUP BY 1, 2),
toc AS (SELECT book, line, CASE WHEN line % 5 = 4 THEN NULL ELSE ordinal + line % 2 END AS ordinal, CASE WHEN line % 7 <> 6 THEN CAST(te AS BIGINT) END AS at FROM ps)
SELECT t.book, t.line, coalesce(c.ordinal, i.ordinal) AS chapter, CASE WHEN coalesce(c.ordinal, i.ordinal) IS NOT NULL THEN t.at END AS target_cp
FROM toc t LEFT JOIN ch c ON c.book = t.book AND c.ordinal = t.ordinal AND t.at BETWEEN c.a AND c.b LEFT JOIN ch i ON i.book = t.book AND t.at >= i.a AND t.at < i.b""")
def s17_toc_binding(s, d):
    """Entries get the chapter of their ordinal if it holds their target, else the one that does."""
    t = text.chaptered(headed_lines(s, d))
    ch = t.filter("ordinal IS NOT NULL").groupBy("book", "ordinal").agg(F.min("start_cp").alias("r_start"), F.max("end_cp").alias("r_end"))
    toc = t.select("book", "line", F.when(F.col("line") % 5 != 4, F.col("ordinal") + F.col("line") % 2).alias("ordinal"), F.when(F.col("line") % 7 != 6, F.col("text_end_cp")).alias("at"))
    return text.bound_toc(toc, ch)


@query("SELECT doc_id, CAST(length(regexp_replace(text, '[^\\x{3400}-\\x{9FFF}\\x{3040}-\\x{30FF}\\x{3000}-\\x{303F}\\x{AC00}-\\x{D7AF}\\x{FF00}-\\x{FFEF}\\x{20000}-\\x{2FA1F}]', '', 'g')) + floor((length(regexp_replace(text, '[\\x{3400}-\\x{9FFF}\\x{3040}-\\x{30FF}\\x{3000}-\\x{303F}\\x{AC00}-\\x{D7AF}\\x{FF00}-\\x{FFEF}\\x{20000}-\\x{2FA1F}]', '', 'g')) + 3) / 4) AS BIGINT) AS tokens FROM documents")
def fn_token_estimate(s, d):
    return table(s, d, "documents").select("doc_id", text.estimated_tokens(F.col("text")).alias("tokens"))


@query("""WITH p AS (SELECT doc_id, p FROM (SELECT doc_id, regexp_extract_all(replace(replace(text, 'th', '“'), 'ed', '”'), '[^“”]*[“”]') AS p FROM documents)),
m AS (SELECT doc_id, k, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos, CASE WHEN x LIKE '%“' THEN 1 ELSE -1 END AS step FROM (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS k FROM p)),
l AS (SELECT doc_id, ln, sum(length(b) + 1) OVER (PARTITION BY doc_id ORDER BY ln) - 1 AS e, length(b) AS n FROM (SELECT doc_id, unnest(b) AS b, generate_subscripts(b, 1) AS ln FROM (SELECT doc_id, string_split(replace(replace(text, 'th', '“'), 'ed', '”'), chr(10)) AS b FROM documents))),
d AS (SELECT *, sum(step) OVER (PARTITION BY doc_id ORDER BY pos) AS depth FROM m),
u AS (SELECT *, min(depth) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS low FROM d)
SELECT u.doc_id, CAST(u.pos AS BIGINT) AS opening_cp, CAST(l.e AS BIGINT) AS close_cp FROM u JOIN l ON l.doc_id = u.doc_id AND u.pos >= l.e - l.n AND u.pos < l.e
JOIN LATERAL (SELECT min_by(step, pos) AS step FROM m WHERE m.doc_id = u.doc_id AND m.pos >= l.e) f ON f.step = 1 WHERE u.step = 1 AND (low IS NULL OR low >= depth) AND l.e > u.pos + 1""")
def t6_auto_close(s, d):
    """Openings of “ that nothing closes, whose paragraph can end them as the next mark opens another."""
    return text.auto_close_suggestions(table(s, d, "documents").select("doc_id", F.replace(F.replace("text", F.lit("th"), F.lit("“")), F.lit("ed"), F.lit("”")).alias("text")), "doc_id")


@query("""WITH had AS (SELECT doc_id, 1 AS opening_cp, 'USER' AS source, CASE WHEN doc_id % 2 = 0 THEN 'ACTIVE' ELSE 'DISABLED' END AS status FROM documents WHERE doc_id % 3 = 0),
told AS (SELECT doc_id, CAST(doc_id % 2 AS INT) AS opening_cp FROM documents UNION SELECT doc_id, 7 FROM documents)
SELECT doc_id, opening_cp, source, status FROM had UNION ALL SELECT doc_id, opening_cp, 'AUTO', 'ACTIVE' FROM told t WHERE NOT EXISTS (SELECT 1 FROM had h WHERE h.doc_id = t.doc_id AND h.opening_cp = t.opening_cp)""")
def t7_suggestion_upsert(s, d):
    """Suggestions are stored where their opening has no row yet; rows that users made stay."""
    ids = table(s, d, "documents").select("doc_id")
    had = ids.filter("doc_id % 3 = 0").select("doc_id", F.lit(1).alias("opening_cp"), F.lit("USER").alias("source"), F.when(F.col("doc_id") % 2 == 0, "ACTIVE").otherwise("DISABLED").alias("status"))
    told = ids.select("doc_id", F.explode(F.array((F.col("doc_id") % 2).cast("int"), F.lit(7))).alias("opening_cp"))
    new = told.join(had, ["doc_id", "opening_cp"], "left_anti").withColumns({"source": F.lit("AUTO"), "status": F.lit("ACTIVE")})
    return had.unionByName(new)


@query("""SELECT doc_id, encoding, CASE WHEN encoding IS NOT NULL THEN sha256(text) END AS digest, CASE WHEN encoding IS NOT NULL THEN length(text) END AS n_chars, CASE WHEN encoding IS NOT NULL THEN true END AS plausible FROM (SELECT doc_id, text,
  CASE doc_id % 3 WHEN 2 THEN 'utf-8-sig' ELSE CASE WHEN text = '' THEN NULL WHEN doc_id % 3 = 0 THEN 'utf-8' ELSE 'utf-16' END END AS encoding FROM documents)""")
def s1_encoding(s, d):
    """Bytes in three encodings, decoded by byte order mark or by the first strict decoder that reads them plausibly."""
    from narrata.sources.files import decoded

    utf8 = F.encode("text", "UTF-8")
    raw = F.when(F.col("doc_id") % 3 == 0, utf8).when(F.col("doc_id") % 3 == 1, F.encode("text", "UTF-16")).otherwise(F.concat(F.lit(bytearray(b"\xef\xbb\xbf")), utf8))
    got = decoded(table(s, d, "documents").select("doc_id", raw.alias("content")), "doc_id")
    return got.select("doc_id", "encoding", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.length("text").cast("long").alias("n_chars"), (F.col("plausibility") >= 0.999).alias("plausible"))


@query("""WITH v AS (SELECT doc_id, source, sha256(text) AS sha, sha256(replace(text, chr(10), '')) AS canon FROM documents),
b AS (SELECT sha, min(doc_id) AS book FROM v GROUP BY 1)
SELECT v.doc_id, b.book, v.doc_id = b.book AS new_book, min(v.doc_id) OVER (PARTITION BY v.canon, coalesce(v.source, '')) AS version, b.book IN (SELECT doc_id FROM v WHERE doc_id % 10 = 0) AS stored FROM v JOIN b ON b.sha = v.sha""")
def s18_import_versions(s, d):
    """Two levels of repeats: a book by its source's digest, a version by canonical digest and parser."""
    v = table(s, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("parser"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.sha2(F.replace("text", F.lit("\n"), F.lit("")).cast("binary"), 256).alias("canon"))
    books = v.groupBy("sha").agg(F.min("doc_id").alias("book"))
    versions = v.groupBy("canon", "parser").agg(F.min("doc_id").alias("version"))
    out = v.join(books, "sha").join(versions, ["canon", "parser"])
    return out.select("doc_id", "book", (F.col("doc_id") == F.col("book")).alias("new_book"), "version", (F.col("book") % 10 == 0).alias("stored"))
