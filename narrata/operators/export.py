"""Rendering of texts with their annotations, and checks of what was rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.operators import intervals
from narrata.sources.pages import visible

OUTSIDE = "https?://|//|file:|ftp:"


def slices(nodes: DataFrame, items: DataFrame) -> DataFrame:
    """book, node, start_cp, end_cp, item: nodes cut at the bounds of items; each slice has the shortest item over it.

    nodes: book, node, l_start, l_end; items: book, item, ordinal, r_start, r_end. Of equally short ones, the first.
    """
    met = intervals.overlapping(nodes, items)
    inner = met.select("book", "node", F.explode(F.array(F.greatest("l_start", "r_start"), F.least("l_end", "r_end"))).alias("at"))
    points = inner.unionByName(nodes.select("book", "node", F.explode(F.array("l_start", "l_end")).alias("at"))).distinct()
    w = Window.partitionBy("book", "node").orderBy("at")
    cut = points.withColumn("to", F.lead("at").over(w)).filter("to IS NOT NULL")
    over = cut.join(met.select("book", "node", "item", "ordinal", "r_start", "r_end"), ["book", "node"], "left")
    covers = (F.col("r_start") <= F.col("at")) & (F.col("r_end") >= F.col("to"))
    best = F.min_by("item", F.when(covers, F.struct(F.col("r_end") - F.col("r_start"), F.col("ordinal"))))
    return over.groupBy("book", "node", F.col("at").alias("start_cp"), F.col("to").alias("end_cp")).agg(best.alias("item"))


def escaped(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def page_checks(pages: DataFrame) -> DataFrame:
    """Adds the checks of a rendered page (html, fragments: texts that must be there)."""
    h = F.col("html")
    seen = F.regexp_replace(visible(h), "\\s+", "")
    plain = lambda x: F.regexp_replace(x, "\\s+", "")
    missing = F.filter("fragments", lambda x: (F.length(plain(x)) >= 2) & ~F.contains(F.col("_seen"), plain(x)))
    return pages.withColumn("_seen", seen).withColumns({
        "non_empty": F.trim("html") != "", "has_charset": F.contains(F.lower("html"), F.lit("charset")), "no_scripts": ~h.rlike("(?i)<script\\b"),
        "no_external": ~(h.rlike(f'(?i)(?:src|href)\\s*=\\s*"\\s*(?:{OUTSIDE})') | h.rlike(f"(?i)url\\(\\s*[\"']?(?:{OUTSIDE})")),
        "no_localhost": ~h.rlike("(?i)localhost|127\\.0\\.0\\.1"), "missing": F.size(missing).cast("long"),
    }).drop("_seen")
