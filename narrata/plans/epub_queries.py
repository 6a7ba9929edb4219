"""EPUB files made of the given conversations and read back by rows of markup, each with the SQL that says what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.operators import markup
from narrata.operators.graph import settled
from narrata.plans.dialogue_queries import query
from narrata.sources import epub
from narrata.sources.dialogue import table

_HEAD = "<?xml version='1.0' encoding='utf-8'?><!-- a <p> that is none --><html xmlns='http://www.w3.org/1999/xhtml' xmlns:epub='http://www.idpf.org/2007/ops'><head><title>no text</title></head><body>"


def _escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def files(s: SparkSession, d: str) -> DataFrame:
    """book, content: each conversation as an EPUB of four turns a page, with contents in a nav or, for one book in two, an NCX.

    Turns are paragraphs, paragraphs in quotations, divisions with ruby, or paragraphs with a line break; one page in
    five names its characters, as no parser knows them. Even turns are entries below their page's.
    """
    t = table(s, d, "conversations").select(F.col("conv_id").alias("book"), "turn", F.col("role"), _escaped(F.col("text")).alias("t"), F.floor(F.col("turn") / 4).cast("int").alias("c"))
    anchor, m = F.concat(F.lit("t"), F.col("turn").cast("string")), F.col("turn") % 4
    odd = F.when((F.col("book") + F.col("c")) % 5 == 0, F.lit("&nbsp;&eacute;")).otherwise(F.lit("&#160;&#xE9;"))
    body = (
        F.when(m == 0, F.concat(F.lit('<p id="'), anchor, F.lit('">'), "t", odd, F.lit("</p>")))
        .when(m == 1, F.concat(F.lit('<blockquote id="'), anchor, F.lit('"><p>'), "t", F.lit("</p></blockquote>")))
        .when(m == 2, F.concat(F.lit('<div id="'), anchor, F.lit('"> '), "t", F.lit(" <ruby>"), "role", F.lit("<rp>(</rp><rt> rt1</rt><rp>)</rp> two<rt>rt2 </rt></ruby> tail</div><script>var p = '<![CDATA[<p>]]>';</script>")))
        .otherwise(F.concat(F.lit('<p><a name="'), anchor, F.lit('"/>'), "t", F.lit("<br/> x &amp; y <![CDATA[<z>]]></p><img src='i.png' alt='a'/>")))
    )
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "b"))), lambda x: x["b"]), "\n")
    pages = t.withColumn("b", body).groupBy("book", "c").agg(rows.alias("b"), F.array_sort(F.collect_list("turn")).alias("turns"))
    page = pages.select("book", F.concat(F.lit("text/c "), F.col("c").cast("string"), F.lit(".xhtml")).alias("name"), F.concat(F.lit(_HEAD + "<h1>Ch "), F.col("c").cast("string"), F.lit("</h1>"), "b", F.lit("</body></html>")).alias("text"))
    href, named = F.concat(F.lit("c%20"), F.col("c").cast("string"), F.lit(".xhtml")), F.concat(F.lit("Vol "), F.col("c").cast("string"))
    even = F.filter("turns", lambda x: x % 2 == 0)
    leaf = lambda start, mid, end: F.array_join(F.transform(even, lambda x: F.concat(F.lit(start), F.col("href"), F.lit("#t"), x.cast("string"), F.lit(mid), x.cast("string"), F.lit(end))), "")
    e = pages.withColumns({"href": F.concat(F.lit("../text/"), href), "named": named})
    top = F.when(F.col("book") % 3 == 0, F.concat(F.lit("<span>"), "named", F.lit("</span>"))).otherwise(F.concat(F.lit("<a href='"), "href", F.lit("'><b>Vol</b> "), F.col("c").cast("string"), F.lit("</a>")))
    li = F.concat(F.lit("<li>"), top, F.lit("<ol>"), leaf("<li><a href='", "'>T ", "</a></li>"), F.lit("</ol></li>"))
    point = F.concat(F.lit("<navPoint><navLabel><text>"), "named", F.lit("</text></navLabel>"), F.when(F.col("book") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("<content src='"), "href", F.lit("'/>"))), leaf("<navPoint><content src='", "'/><navLabel><text>T ", "</text></navLabel></navPoint>"), F.lit("</navPoint>"))
    listed = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", x.alias("x")))), lambda y: y["x"]), "")
    book = e.groupBy("book").agg(listed(li).alias("li"), listed(point).alias("point"), listed(F.concat(F.lit("<item id='c"), F.col("c").cast("string"), F.lit("' href='../text/"), href, F.lit("' media-type='application/xhtml+xml'/>"))).alias("items"), listed(F.concat(F.lit("<itemref idref='c"), F.col("c").cast("string"), F.lit("'/>"))).alias("refs"))
    nav = F.when(F.col("book") % 2 == 0, F.concat(F.lit(_HEAD + "<nav epub:type='landmarks'><ol><li><a href='x.xhtml'>none</a></li></ol></nav><nav epub:type='toc'><h2>Contents</h2><ol>"), "li", F.lit("</ol></nav></body></html>")))
    ncx = F.when(F.col("book") % 2 == 1, F.concat(F.lit("<ncx xmlns='http://www.daisy.org/z3986/2005/ncx/'><navMap>"), "point", F.lit("</navMap></ncx>")))
    opf = F.concat(F.lit("<package xmlns='http://www.idpf.org/2007/opf' version='3.0'><manifest>"), "items", F.lit("</manifest><spine>"), "refs", F.lit("</spine></package>"))
    fixed = [("mimetype", F.lit(epub.MEDIA)), ("META-INF/container.xml", F.lit("<container xmlns='urn:oasis:names:tc:opendocument:xmlns:container'><rootfiles><rootfile full-path='toc/b.opf'/></rootfiles></container>")), ("toc/b.opf", opf), ("toc/nav.xhtml", nav), ("toc/toc.ncx", ncx)]
    rest = book.select("book", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), x.alias("text")) for n, x in fixed])).alias("f")).select("book", "f.*").filter("text IS NOT NULL")
    return epub.zipped(page.unionByName(rest))


def read(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(blocks, anchors, entries of contents, spine) of the files."""
    got = settled(markup.repaired(epub.members(files(s, d)).filter("name LIKE '%.xhtml' OR name LIKE '%.opf' OR name LIKE '%.ncx'").withColumnRenamed("name", "path")))
    text = got.filter("path LIKE 'text/%'")
    blocks, anchors = markup.page_blocks(text)
    entries = markup.contents(got.filter("path LIKE '%nav.xhtml'")).unionByName(markup.contents(got.filter("path LIKE '%.ncx'"), ncx=True))
    tags = markup.tokens(got.filter("path LIKE '%.opf'"))
    items = tags.filter("name = 'item'").select("book", markup.attribute(F.col("x"), "id").alias("id"), markup.resolved(F.col("path"), markup.attribute(F.col("x"), "href"))["path"].alias("path"))
    refs = tags.filter("name = 'itemref'").select("book", markup.attribute(F.col("x"), "idref").alias("id"), F.col("k").alias("position"))
    return blocks, anchors, entries, refs.join(items, ["book", "id"]).drop("id")


_W = "'[ \\t\\r\\n\\f\\v\\x{a0}\\x{3000}]+'"
#: What each turn's block says, and where its ruby stands: nodes of text lose the white space at their ends.
MADE = f"""WITH t AS (SELECT conv_id AS book, turn, role, CAST(floor(turn / 4) AS BIGINT) AS c, trim(regexp_replace(text, {_W}, ' ', 'g')) AS t FROM conversations),
x AS (SELECT *, CASE turn % 4 WHEN 0 THEN trim(t || ' é') WHEN 1 THEN t WHEN 2 THEN t || role || ' twotail' ELSE t || 'x & y <z>' END AS text FROM t),
b AS (SELECT book, c, turn, CASE turn % 4 WHEN 2 THEN 'div' ELSE 'p' END AS tag, text, 0 AS o FROM x WHERE text <> '' UNION ALL SELECT DISTINCT book, c, -1, 'h1', 'Ch ' || c, 0 FROM x UNION ALL SELECT book, c, turn, 'img', '', 1 FROM x WHERE turn % 4 = 3),
n AS (SELECT *, row_number() OVER (PARTITION BY book, c ORDER BY turn, o) - 1 AS block, row_number() OVER (PARTITION BY book ORDER BY c, turn, o) - 1 AS g FROM b) """


@query(MADE + "SELECT book, 'text/c ' || c || '.xhtml' AS path, block, tag, text FROM n")
def s10_epub_blocks(s, d):
    """Blocks of the pages in EPUB files: nested ones, bare text, line breaks, literal text, skipped elements, images."""
    return read(s, d)[0].select("book", "path", "block", "tag", "text")


@query(MADE + "SELECT n.book, 'text/c ' || n.c || '.xhtml' AS path, block, CAST(length(x.t) AS BIGINT) AS start, CAST(length(x.t || role || ' two') AS BIGINT) AS \"end\", role || ' two' AS base, 'rt1 rt2' AS rt FROM n JOIN x ON x.book = n.book AND x.turn = n.turn WHERE n.turn % 4 = 2")
def s11_epub_ruby(s, d):
    """Ruby of any number and at any place: ranges in the block's text, and what is said of them."""
    return read(s, d)[0].select("book", "path", "block", F.explode("ruby").alias("r")).select("book", "path", "block", "r.*")


@query("SELECT DISTINCT conv_id AS book, 'text/c ' || CAST(floor(turn / 4) AS BIGINT) || '.xhtml' AS path, (conv_id + CAST(floor(turn / 4) AS BIGINT)) % 5 = 0 AND min(turn % 4) OVER (PARTITION BY conv_id, floor(turn / 4)) = 0 AS mended, true AS accepted FROM conversations")
def s12_epub_repairs(s, d):
    """Pages that no parser takes are mended by the names of their characters; the others are left as they are."""
    got = markup.repaired(epub.members(files(s, d)).filter("name LIKE 'text/%'").withColumnRenamed("name", "path"))
    return got.select("book", "path", "mended", F.col("error").isNull().alias("accepted"))


ENTRIES = """WITH t AS (SELECT conv_id AS book, turn, CAST(floor(turn / 4) AS BIGINT) AS c FROM conversations), e AS (SELECT DISTINCT book, c, -1 AS turn FROM t UNION ALL SELECT book, c, turn FROM t WHERE turn % 2 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY c, turn) - 1 AS entry FROM e), p AS (SELECT book, c, entry AS parent FROM n WHERE turn = -1) """


@query(ENTRIES + """SELECT n.book, n.entry, CASE WHEN turn >= 0 THEN p.parent END AS parent, CASE WHEN turn >= 0 THEN 'T ' || turn ELSE 'Vol ' || n.c END AS title, CASE WHEN turn >= 0 THEN 'Vol ' || n.c ELSE '' END AS volume, turn = -1 AND EXISTS (SELECT 1 FROM n k WHERE k.book = n.book AND k.c = n.c AND k.turn >= 0) AS is_parent,
  CASE WHEN turn >= 0 OR n.book % 3 <> 0 THEN '../text/c%20' || n.c || '.xhtml' || CASE WHEN turn >= 0 THEN '#t' || turn ELSE '' END ELSE '' END AS href FROM n JOIN p ON p.book = n.book AND p.c = n.c""")
def s9_nested_contents(s, d):
    """Entries of nested contents, from nav lists and from navPoints, with what stands above each."""
    return read(s, d)[2].select("book", "entry", "parent", "title", "volume", "is_parent", "href")


@query(MADE + """, s AS (SELECT *, CASE WHEN turn = -1 AND book % 3 <> 0 THEN 'Vol ' || c WHEN turn >= 0 AND turn % 2 = 0 AND o = 0 THEN 'Vol ' || c || ' · T ' || turn WHEN g = 0 THEN '卷首' END AS starts FROM n),
k AS (SELECT *, count(starts) OVER (PARTITION BY book ORDER BY g) - 1 AS chapter FROM s)
SELECT book, chapter, max(starts) OVER (PARTITION BY book, chapter) AS title, g AS block, text FROM k""")
def s14_epub_chapters(s, d):
    """All blocks of a book in the chapters that its contents make, by files and by places in them."""
    return markup.chapters(*read(s, d)).select("book", "chapter", "title", "block", "text")
