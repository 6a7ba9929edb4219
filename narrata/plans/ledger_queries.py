"""More queries over the text model: joins of ledgers, coverage, positions and orders, cursors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from narrata.operators import intervals
from narrata.plans.dialogue_queries import n, query
from narrata.sources import dialogue as src
from narrata.sources.dialogue import table, with_sql

#: Where pages of content and the nearest quote are looked for, in code points; rows of a page; neighbours and targets of a block.
FROM_CP, TO_CP, MARK_CP, PAGE, AROUND, BLOCK = 200, 6000, 1000, 20, 2, 16


@query("SELECT event_id, replace(replace(rtrim(to_base64(encode(j)), '='), '+', '-'), '/', '_') AS cursor, j AS decoded FROM (SELECT event_id, '[' || user_id || ',' || event_id || ']' AS j FROM events)")
def f3_cursor_codec(s, d):
    listed = F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit(","), F.col("event_id").cast("string"), F.lit("]"))
    e = table(s, d, "events").select("event_id", F.rtrim(F.translate(F.base64(listed.cast("binary")), "+/", "-_"), F.lit("=")).alias("cursor"))
    return e.withColumn("decoded", F.unbase64(F.translate("cursor", "-_", "+/")).cast("string"))


@query(with_sql("segments", "chapters") + f"""SELECT s.book, s.start_cp, c.ordinal, s.turn FROM segments s JOIN chapters c ON s.book = c.book AND s.start_cp >= c.start_cp AND s.end_cp <= c.end_cp
WHERE (s.start_cp, c.ordinal, s.turn) > ({FROM_CP}, 0, 1) AND s.end_cp <= {TO_CP}""")
def f4_content_seek(s, d):
    c = src.chapters(s, d).select("book", "ordinal", F.col("start_cp").alias("r_start"), F.col("end_cp").alias("r_end"))
    seek = F.struct("start_cp", "ordinal", F.col("turn").cast("long").alias("turn")) > F.struct(*[F.lit(v).cast("long").alias(k) for k, v in (("start_cp", FROM_CP), ("ordinal", 0), ("turn", 1))])
    near = src.segments(s, d).filter(F.col("end_cp") <= TO_CP).withColumn("at", F.col("start_cp"))
    return intervals.containing(near, c).filter("end_cp <= r_end").filter(seek).select("book", "start_cp", "ordinal", "turn")


@query(with_sql("annotations") + "SELECT book, quote_id FROM annotations WHERE NOT stale AND (coalesce(CASE WHEN status = 'ACCEPTED' THEN turn END, 0) <> 0 OR coalesce(CASE WHEN kind = 'speech' THEN speaker END, '') <> '')")
def f6_usable_items(s, d):
    color, label = F.when(F.col("status") == "ACCEPTED", F.col("turn")), F.when(F.col("kind") == "speech", F.col("speaker"))
    return src.annotations(s, d).filter(~F.col("stale") & ((F.coalesce(color, F.lit(0)) != 0) | (F.coalesce(label, F.lit("")) != ""))).select("book", "quote_id")


@query(with_sql("quotes", "annotations") + "SELECT q.book, q.quote_id, q.role, a.kind, a.status FROM quotes q JOIN annotations a ON q.book = a.book AND q.quote_id = a.quote_id")
def j1_equi_inner(s, d):
    a = src.annotations(s, d).select("book", "quote_id", "kind", "status")
    return src.quotes(s, d).join(a, ["book", "quote_id"]).select("book", "quote_id", "role", "kind", "status")


@query(with_sql("quotes") + "SELECT s.book, s.turn, coalesce(q.quote_id, 'gap-' || s.start_cp) AS target FROM segments s LEFT JOIN quotes q ON s.book = q.book AND s.start_cp = q.start_cp")
def j2_left_target(s, d):
    q = src.quotes(s, d).select("book", "start_cp", "quote_id")
    target = F.coalesce("quote_id", F.concat(F.lit("gap-"), F.col("start_cp").cast("string"))).alias("target")
    return src.segments(s, d).join(q, ["book", "start_cp"], "left").select("book", "turn", target)


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1")
def j3_left_made_inner(s, d):
    good = table(s, d, "labels").filter("quality = 1").select("doc_id", "quality")
    return table(s, d, "documents").select("doc_id").join(good, "doc_id")


@query(with_sql("quotes", "chapters") + """, g AS (SELECT book, quote_id AS left_id, end_cp AS a, lead(start_cp) OVER (PARTITION BY book ORDER BY start_cp) AS b FROM quotes)
SELECT g.book, g.left_id, c.ordinal FROM g JOIN chapters c ON g.book = c.book AND g.b > g.a AND g.a >= c.start_cp AND g.b <= c.end_cp""")
def j7_inner_gaps(s, d):
    c = src.chapters(s, d).select("book", "ordinal", F.col("start_cp").alias("r_start"), F.col("end_cp").alias("r_end"))
    g = intervals.gaps(src.quotes(s, d)).withColumn("at", F.col("gap_start"))
    return intervals.containing(g, c).filter("gap_end <= r_end").select("book", "left_id", "ordinal")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) OR doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def j11_either_semi(s, d):
    either = table(s, d, "labels").filter("toxic = 1 OR quality = 0").select("doc_id")
    return table(s, d, "documents").join(either, "doc_id", "left_semi").select("doc_id", "source")


@query("""SELECT user_id, CAST(coalesce(sum(k), 0) AS BIGINT) AS tokens, count(*) FILTER (k IS NULL AND event_type IN ('error', 'purchase')) AS unknown_runs
FROM (SELECT user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1""")
def a4_spent_tokens(s, d):
    k = F.get_json_object("props", "$.k").try_cast("long")
    unknown = k.isNull() & F.col("event_type").isin("error", "purchase")
    return table(s, d, "events").groupBy("user_id").agg(F.coalesce(F.sum(k), F.lit(0)).cast("long").alias("tokens"), F.count_if(unknown).alias("unknown_runs"))


@query(with_sql("annotations") + "SELECT book, count(*) AS windows, count(*) FILTER (status = 'ACCEPTED') AS done FROM annotations GROUP BY 1")
def a6_progress(s, d):
    return src.annotations(s, d).groupBy("book").agg(n("windows"), F.count_if(F.col("status") == "ACCEPTED").alias("done"))


@query(with_sql("annotations") + """SELECT book, count(*) AS paragraphs, count(*) FILTER (hit) AS annotated FROM (SELECT s.book, EXISTS (SELECT 1 FROM annotations a
WHERE a.book = s.book AND a.status <> 'UNKNOWN' AND a.start_cp < s.end_cp AND s.start_cp < a.end_cp) AS hit FROM segments s) GROUP BY 1""")
def a10_export_coverage(s, d):
    p = src.segments(s, d).select("book", F.col("start_cp").alias("l_start"), F.col("end_cp").alias("l_end"))
    a = src.annotations(s, d).filter("status <> 'UNKNOWN'").select("book", F.col("start_cp").alias("r_start"), F.col("end_cp").alias("r_end"))
    hit = intervals.overlapping(p, a).select("book", "l_start").distinct().withColumn("hit", F.lit(True))
    return p.join(hit, ["book", "l_start"], "left").groupBy("book").agg(n("paragraphs"), F.count("hit").alias("annotated"))


@query(with_sql("quotes") + "SELECT * FROM (SELECT book, quote_id, lead(quote_id) OVER w AS next_id, lead(start_cp) OVER w - end_cp AS distance FROM quotes WINDOW w AS (PARTITION BY book ORDER BY start_cp)) WHERE next_id IS NOT NULL")
def w2_adjacent_pairs(s, d):
    w = Window.partitionBy("book").orderBy("start_cp")
    pairs = src.quotes(s, d).select("book", "quote_id", F.lead("quote_id").over(w).alias("next_id"), (F.lead("start_cp").over(w) - F.col("end_cp")).alias("distance"))
    return pairs.filter("next_id IS NOT NULL")


@query(with_sql("segments") + "SELECT book, turn, CAST(sum(length(quoted)) OVER (PARTITION BY book ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chars FROM segments")
def w3_prefix_sums(s, d):
    w = Window.partitionBy("book").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return src.segments(s, d).select("book", "turn", F.sum(F.length("quoted").cast("long")).over(w).alias("chars"))


@query(with_sql("annotations") + f""", r AS (SELECT book, row_number() OVER (PARTITION BY book ORDER BY start_cp) AS k,
  max(CASE WHEN status = 'UNKNOWN' THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY start_cp ROWS BETWEEN {AROUND} PRECEDING AND {AROUND} FOLLOWING) AS near FROM annotations),
m AS (SELECT book, k, k - row_number() OVER (PARTITION BY book ORDER BY k) AS run FROM r WHERE near = 1),
b AS (SELECT *, floor((row_number() OVER (PARTITION BY book, run ORDER BY k) - 1) / {BLOCK}) AS block FROM m)
SELECT book, min(k) AS first_quote, count(*) AS quotes FROM b GROUP BY book, run, block""")
def w6_dilated_runs(s, d):
    w = Window.partitionBy("book").orderBy("start_cp")
    near = F.max(F.col("status") == "UNKNOWN").over(w.rowsBetween(-AROUND, AROUND))
    marked = src.annotations(s, d).select("book", F.row_number().over(w).cast("long").alias("k"), near.alias("near")).filter("near")
    runs = marked.withColumn("run", F.col("k") - F.row_number().over(Window.partitionBy("book").orderBy("k")))
    blocks = runs.withColumn("block", F.floor((F.row_number().over(Window.partitionBy("book", "run").orderBy("k")) - 1) / BLOCK))
    return blocks.groupBy("book", "run", "block").agg(F.min("k").alias("first_quote"), n("quotes")).drop("run", "block")


def _speakers(s, d):
    return src.annotations(s, d).groupBy("book", "speaker").agg(
        F.min("start_cp").alias("first_cp"), F.min(F.when(F.col("status") == "ACCEPTED", F.col("start_cp"))).alias("accepted_cp"),
        n("dialogues"), F.sum(F.col("end_cp") - F.col("start_cp")).alias("chars"),
    )


_SPEAKERS = with_sql("annotations") + """, p AS (SELECT book, speaker, min(start_cp) AS first_cp, min(start_cp) FILTER (status = 'ACCEPTED') AS accepted_cp,
count(*) AS dialogues, sum(end_cp - start_cp) AS chars FROM annotations GROUP BY 1, 2) """


def _placed(s, d, *order):
    return _speakers(s, d).select("book", "speaker", F.row_number().over(Window.partitionBy("book").orderBy(*order)).cast("long").alias("place"))


@query(_SPEAKERS + "SELECT book, speaker, dense_rank() OVER (PARTITION BY book ORDER BY first_cp) AS label FROM p")
def w8_first_seen(s, d):
    return _speakers(s, d).select("book", "speaker", F.dense_rank().over(Window.partitionBy("book").orderBy("first_cp")).cast("long").alias("label"))


@query(_SPEAKERS + "SELECT book, speaker, row_number() OVER (PARTITION BY book ORDER BY accepted_cp NULLS LAST, speaker) AS place FROM p")
def o1_nulls_last(s, d):
    return _placed(s, d, F.asc_nulls_last("accepted_cp"), "speaker")


@query(_SPEAKERS + "SELECT book, speaker, row_number() OVER (PARTITION BY book ORDER BY chars DESC, dialogues DESC, lower(speaker), speaker) AS place FROM p")
def o2_mixed_order(s, d):
    return _placed(s, d, F.desc("chars"), F.desc("dialogues"), F.lower("speaker"), "speaker")


@query(f"SELECT page_id, url, more > {PAGE} AS has_more FROM (SELECT page_id, url, count(*) OVER () AS more, row_number() OVER (ORDER BY page_id) AS k FROM (SELECT page_id, url FROM pages ORDER BY page_id LIMIT {PAGE + 1})) WHERE k <= {PAGE}")
def o3_has_more(s, d):
    # The windows see one row more than the page holds.
    one = Window.partitionBy(F.lit(0))
    page = table(s, d, "pages").select("page_id", "url").orderBy("page_id").limit(PAGE + 1)
    seen = page.withColumns({"has_more": F.count(F.lit(1)).over(one) > PAGE, "k": F.row_number().over(one.orderBy("page_id"))})
    return seen.filter(F.col("k") <= PAGE).drop("k")


@query(with_sql("annotations") + f"""SELECT book, speaker, quote_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY book, speaker ORDER BY distance, start_cp) AS k
FROM (SELECT *, greatest(start_cp - {MARK_CP}, {MARK_CP} - end_cp, 0) AS distance FROM annotations)) WHERE k = 1""")
def o5_nearest_anchor(s, d):
    # One row of each speaker is kept, so a partial aggregate does it without sorting.
    away = F.greatest(F.col("start_cp") - MARK_CP, MARK_CP - F.col("end_cp"), F.lit(0).cast("long"))
    best = F.min(F.struct(away.alias("distance"), "start_cp", "quote_id")).alias("best")
    return src.annotations(s, d).groupBy("book", "speaker").agg(best).select("book", "speaker", "best.quote_id", "best.distance")


@query(_SPEAKERS + "SELECT book, string_agg(speaker, ',' ORDER BY first_cp) AS speakers FROM p GROUP BY 1")
def u3_ordered_dedup(s, d):
    listed = F.array_sort(F.collect_list(F.struct("first_cp", "speaker")))
    return _speakers(s, d).groupBy("book").agg(F.array_join(F.transform(listed, lambda x: x["speaker"]), ",").alias("speakers"))
