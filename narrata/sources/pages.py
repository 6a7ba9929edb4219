"""HTML pages to blocks of text, tolerant of pages that aren't well-formed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags whose contents are never read, and tags that start a block (fixed values).
SKIPPED = ["script", "style", "head", "noscript", "template"]
BLOCKS = "p|h1|h2|h3|h4|h5|h6|li|ul|ol|div|article|section|nav|table|tr|td|th|blockquote|pre|br|hr|body|html|header|footer|main|figure"
#: Entities that are turned into characters; & comes last (fixed values).
ENTITIES = {"&nbsp;": "\u00a0", "&mdash;": "—", "&hellip;": "…", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&amp;": "&"}
SPACE = "[ \\t\\r\\n\\f\\x0b\\u00a0\\u3000]+"


def unescaped(text: Column) -> Column:
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def marked(html: Column) -> Column:
    """The page without comments and contents that aren't read; each block tag is a line feed."""
    out = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    for tag in SKIPPED:
        out = F.regexp_replace(out, f"(?is)<{tag}\\b[^>]*>.*?</{tag}>", "")
    return F.regexp_replace(F.regexp_replace(out, "\\n", " "), f"(?i)</?(?:{BLOCKS})\\b[^>]*>", "\n")


def blocks(pages: DataFrame) -> DataFrame:
    """page_id, block, text: the blocks with text, spaces collapsed, numbered from 0."""
    lines = F.split(F.regexp_replace(marked(F.col("html")), "<[^>]+>", ""), "\n")
    clean = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(unescaped(x), SPACE, " "))), lambda x: x != "")
    return pages.select("page_id", F.posexplode(clean).alias("block", "text")).withColumn("block", F.col("block").cast("long"))


def visible(html: Column) -> Column:
    """What is left of a page when tags go, labels too, and entities are read."""
    return unescaped(F.regexp_replace(F.regexp_replace(html, '(?s)<span class="label"(?:\\s[^>]*)?>.*?</span>', ""), "<[^>]+>", ""))
