"""Pages of decorative columns made of the given conversations, and the SQL that says what is left of their paragraphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from narrata.operators import layout, markup
from narrata.operators.graph import settled
from narrata.plans.dialogue_queries import query
from narrata.plans.epub_queries import _escaped
from narrata.sources.dialogue import table

#: A sheet that pages link, and one in the pages of every second book.
LINKED = "@media print { .v { writing-mode: horizontal-tb } } section .v, div.v { -epub-writing-mode: vertical-rl } body > .f { float: right }"
OWN = "div.f { float: left ! important }"


def pages(s, d):
    """book, path, markup: each conversation as a page. A turn is a column of its role's letters or of its text's words, by its number."""
    t, m = table(s, d, "conversations").select(F.col("conv_id").alias("book"), "turn", "role", "text"), F.col("turn") % 5
    put = lambda items: F.array_join(F.transform(items, lambda x: F.concat(F.lit("<p>"), _escaped(x), F.lit("</p>"))), "")
    letters, words = put(F.split("role", "")), put(F.filter(F.split("text", markup.SPACES), lambda x: x != ""))
    around = lambda a, x, z: F.concat(F.lit(a), x, F.lit(z))
    upright = around('<div class="x v">', letters, "</div>")
    body = (
        F.when(m == 0, upright).when(m == 1, around('<div class="f">', words, "</div>")).when(m == 2, around('<section class="f">', letters, "</section>"))
        .when(m == 3, around('<div class="f" style="float: none">', letters, "</div>")).otherwise(around("<div> ", F.concat(upright, upright), "</div>"))
    )
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "b"))), lambda x: x["b"]), "\n")
    own = F.when(F.col("book") % 2 == 0, F.lit(f"<style>{OWN}</style>")).otherwise("")
    text = F.concat(F.lit("<html><head><link rel='stylesheet' href='../css/all.css'/>"), own, F.lit("</head><body>"), rows, F.lit("</body></html>"))
    return t.withColumn("b", body).groupBy("book").agg(text.alias("markup")).select("book", F.lit("text/c.xhtml").alias("path"), "markup")


@query("""WITH t AS (SELECT conv_id AS book, turn, role, turn % 5 AS m, list_filter(string_split_regex(text, '[\\s\\v\\p{Z}\\x{1c}-\\x{1f}\\x{85}]+'), lambda x: x <> '') AS w FROM conversations),
x AS (SELECT *, count(*) FILTER (m = 2 OR (m = 3 AND book % 2 = 0)) OVER (PARTITION BY book) >= 2 AS two FROM t),
y AS (SELECT *, CASE m WHEN 3 THEN book % 2 = 0 WHEN 1 THEN two AND len(w) BETWEEN 3 AND 160 AND length(array_to_string(w, '')) <= 160 AND list_max(list_transform(w, lambda y: length(y))) <= 12 ELSE true END AS won FROM x),
b AS (SELECT book, turn, 0 AS i, CASE m WHEN 2 THEN 'section' ELSE 'div' END AS tag, CASE m WHEN 1 THEN array_to_string(w, '') WHEN 4 THEN role || role ELSE role END AS text FROM y WHERE won
  UNION ALL SELECT book, turn, generate_subscripts(p, 1), 'p', unnest(p) FROM (SELECT book, turn, CASE m WHEN 1 THEN w ELSE string_split(role, '') END AS p FROM y WHERE NOT won)),
c AS (SELECT book, CAST(sum(CASE WHEN NOT won THEN 0 WHEN m = 4 THEN 2 ELSE 1 END) AS BIGINT) AS columns FROM y GROUP BY 1)
SELECT b.book, row_number() OVER (PARTITION BY b.book ORDER BY turn, i) - 1 AS block, tag, text, c.columns FROM b JOIN c ON c.book = b.book""")
def s16_layout(s, d):
    """Blocks of pages whose decorative columns, as their style sheets tell these, were made into running text."""
    p = settled(pages(s, d))
    sheets = p.select("book", F.lit("css/all.css").alias("path"), F.lit(LINKED).alias("css"))
    got = settled(layout.running(p, sheets))
    return markup.page_blocks(got)[0].join(got.select("book", "path", "columns"), ["book", "path"]).select("book", "block", "tag", "text", "columns")
