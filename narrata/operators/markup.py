"""Pages of markup as rows: tags and texts in order, blocks of text with ruby and anchors, nested contents, chapters.

A page's markup is cut by a pattern; what a parser keeps on its stack are running sums here. Pages are well formed
(`repaired` tells those that aren't), so every element that opens is closed.
"""

from __future__ import annotations

import re
from functools import reduce
from html.entities import html5
from urllib.parse import unquote, urlsplit
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.functions.slices import mapped
from narrata.operators.graph import settled

#: What markup is cut into: comments, literal text, instructions, declarations, tags, text.
INNER = r"(?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+"
ASIDE = r"<!--[\s\S]*?-->|<!\[CDATA\[[\s\S]*?\]\]>|<\?[\s\S]*?\?>|<![^>]*>"
TOKEN = rf"{ASIDE}|</?[^\s<>/!?]{INNER}>|[^<]+"
SPACES = r"[\s\p{Z}\x1c-\x1f\x85]+"
#: Elements that begin a block, and elements that are left out with all they hold (fixed values).
BLOCKS = ["p", "div", "section", "article", "aside", "blockquote", "pre", "figure", "figcaption", "li", "dd", "dt", "td", "th", "caption", "hr", "h1", "h2", "h3", "h4", "h5", "h6"]
SKIPPED = ["script", "style", "head", "title", "meta", "link", "base", "object", "embed", "iframe", "audio", "video", "template", "map"]
IMAGES = ["img", "image"]
#: Titles of what comes before the first chapter, and of a chapter without a title (fixed values).
FRONT, UNTITLED = "卷首", "正文"
PAGE = ["book", "path"]

_literal = re.compile(rb"(<!--[\s\S]*?-->|<!\[CDATA\[[\s\S]*?\]\]>|<\?[\s\S]*?\?>)")
_named = re.compile(rb"&([A-Za-z]\w*);", re.ASCII)
_PREDEFINED = (b"amp", b"lt", b"gt", b"quot", b"apos")


def _mended(data: bytes) -> bytes:
    """Names of characters as numbers, but in comments, literal text and instructions, and where a page defines names itself."""
    if b"<!entity" in data.lower():
        return data
    # Every second part is one that stays as it is.
    parts = _literal.split(data)
    parts[::2] = [_named.sub(_numbered, p) for p in parts[::2]]
    return b"".join(parts)


def _numbered(m: re.Match[bytes]) -> bytes:
    chars = html5.get(m.group(1).decode() + ";") if m.group(1) not in _PREDEFINED else None
    return m.group() if chars is None else "".join(f"&#{ord(c)};" for c in chars).encode()


def _page(data: bytes | None) -> tuple[str | None, bool, str | None]:
    """(markup, whether names of characters were mended, error) of a page that a parser must accept."""
    data, mended = data or b"", False
    while True:
        try:
            ElementTree.fromstring(data)
            break
        except (ElementTree.ParseError, ValueError, LookupError) as e:
            again = _mended(data)
            if mended or again == data:
                return None, mended, str(e)
            data, mended = again, True
    told = re.match(rb"\s*<\?xml[^>]*encoding\s*=\s*[\"']([A-Za-z0-9._-]+)", data)
    wide = data[:2] in (b"\xff\xfe", b"\xfe\xff")
    try:
        return data.decode("utf-16" if wide else told.group(1).decode() if told else "utf-8-sig").removeprefix("\ufeff"), mended, None
    except (UnicodeDecodeError, LookupError) as e:
        return None, mended, str(e)


def repaired(pages: DataFrame) -> DataFrame:
    """pages (content: bytes) with markup, mended and error. Only pages that a parser refuses are mended; then they must be accepted."""

    keep = [c for c in pages.columns if c not in ("content", "error")]

    def told(f: pd.DataFrame) -> pd.DataFrame:
        made = pd.DataFrame([_page(c) for c in f["content"]], columns=["markup", "mended", "error"])
        return pd.concat([f[keep], made], axis=1)

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return mapped(pages.select(*keep, "content"), told, f"{kinds}, markup string, mended boolean, error string")


def unescaped(text: Column) -> Column:
    """text with its numbered and its five predefined characters in place."""
    code = lambda p, start, base: F.lpad(F.conv(F.substring(p, start, F.length(p) - start), base, 16), 8, "0")
    char = lambda h: F.decode(F.unhex(h), "UTF-32")
    known = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}

    def put(p: Column) -> Column:
        out = F.when(p.startswith("&#x"), char(code(p, F.lit(4), 16))).when(p.startswith("&#"), char(code(p, F.lit(3), 10)))
        return reduce(lambda c, kv: c.when(p == kv[0], F.lit(kv[1])), known.items(), out).otherwise(p)

    parts = F.regexp_extract_all(text, F.lit("&#?[A-Za-z0-9]+;|[^&]+|&"), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(parts, put), "")).otherwise(text)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, whatever its prefix; null where the tag has none."""
    found = F.regexp_extract(tag, rf"\s(?:[A-Za-z]+:)?{name}\s*=\s*(\"[^\"]*\"|'[^']*')", 1)
    return F.when(found != "", unescaped(F.substring(found, F.lit(2), F.length(found) - 2)))


def named(*names: str) -> str:
    """A pattern of the name in a tag, whatever its prefix, if it is one of these."""
    any_ = "|".join(names)
    return rf"(?:[^\s<>/:]+:(?:{any_})|(?:{any_})(?!:[^\s<>/:]))(?![^\s<>/:])"


def said(x: Column) -> Column:
    """What a token of text says; null for a tag."""
    literal = x.startswith("<![CDATA[")
    return F.when(literal, F.substring(x, F.lit(10), F.length(x) - 12)).when(~x.startswith("<"), unescaped(F.regexp_replace(x, "\r\n?", "\n")))


def _cut(pages: DataFrame, leaf: str | None = None) -> DataFrame:
    """tokens() by themselves, without what is counted along the page."""
    t = pages.select(*PAGE, F.posexplode(F.regexp_extract_all("markup", F.lit(f"{leaf}|{TOKEN}" if leaf else TOKEN), F.lit(0))).alias("k", "x"))
    whole = F.lit(False)
    if leaf:
        t = t.withColumn("whole", F.when(F.col("x").rlike(r"(?s)^<[^/!?].*</[^<>\"']*>$"), F.col("x")))
        whole = F.col("whole").isNotNull()
        t = t.withColumn("x", F.when(whole, F.regexp_extract("x", rf"^<{INNER}>", 0)).otherwise(F.col("x")))
    literal = F.col("x").startswith("<![CDATA[")
    t = t.filter(literal | ~F.col("x").rlike("^<[!?]"))
    tag = F.col("x").startswith("<") & ~literal
    return t.withColumns({
        "name": F.when(tag, F.regexp_extract("x", r"^</?(?:[^\s<>/:]+:)?([^\s<>/:]+)", 1)),
        "step": F.when(~tag | F.col("x").endswith("/>") | whole, 0).when(F.col("x").startswith("</"), -1).otherwise(1),
        "body": said(F.col("x")),
    })


def tokens(pages: DataFrame, leaf: str | None = None) -> DataFrame:
    """book, path, k, x, name (of a tag), step (1 opens, -1 closes, else 0), body (of text), depth (after the token), node.

    Texts between the same two tags have the same node. Comments, instructions and declarations are left out. Elements
    that the pattern leaf finds are one token of step 0: x is the tag that opens it, whole (else null) all of it.
    """
    w = Window.partitionBy(*PAGE).orderBy("k")
    return _cut(pages, leaf).withColumns({"depth": F.sum("step").over(w), "node": F.count("name").over(w)})


def _inside(names: list[str], w) -> Column:
    """How many elements of these names are open after a token."""
    return F.sum(F.when(F.col("name").isin(names), F.col("step")).otherwise(0)).over(w)


def walked(pages: DataFrame) -> DataFrame:
    """book, path, k, x (of a tag), name, body, node of tokens() that count, with block (its number, from 0 for what is in none), begins (the token begins it), ruby, rt, alone (a text between two tags)."""
    w = Window.partitionBy(*PAGE).orderBy("k")
    t = _cut(pages).withColumn("x", F.when(F.col("name").isNotNull(), F.col("x")))
    t = t.withColumns({"node": F.count("name").over(w), "_skip": _inside(SKIPPED, w)}).filter(F.coalesce(~F.col("name").isin(SKIPPED), F.lit(True)) & (F.col("_skip") == 0))
    opens = F.col("name").isNotNull() & ~F.col("x").startswith("</")
    count = lambda of: F.count(F.when((F.col("name") == of) & opens, 1)).over(w)
    next_to = lambda side: F.coalesce(side(F.col("name").isNotNull()).over(w), F.lit(True))
    t = t.withColumns({"_ruby": _inside(["ruby"], w), "_rt": _inside(["rt"], w), "_rp": _inside(["rp"], w), "ruby": count("ruby"), "rt": count("rt"), "alone": next_to(F.lag) & next_to(F.lead)})
    free = F.col("_ruby") == 0
    image = opens & F.col("name").isin(IMAGES) & free
    begins = opens & F.col("name").isin(BLOCKS) & free
    # An image is a block of its own, so what follows it begins another one.
    number = F.sum(F.when(image, 2).when(begins, 1).otherwise(0)).over(w)
    t = t.withColumns({"block": F.when(image, number - 1).otherwise(number), "begins": begins | image, "ruby": F.when(~free, F.col("ruby")), "rt": F.when(F.col("_rt") > 0, F.col("rt"))})
    return t.filter(F.col("body").isNull() | (F.col("_rp") == 0)).drop("step", "_skip", "_ruby", "_rt", "_rp")


def _pieces(walk: DataFrame) -> DataFrame:
    """book, path, block, k, piece, rt, start: texts between tags, or of a ruby, white space put together, with their offsets in the block."""
    joined = lambda: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "body"))), lambda x: x["body"]), "")
    texts = walk.filter("body IS NOT NULL")
    by = F.coalesce(F.concat(F.lit("r"), F.col("ruby").cast("string")), F.concat(F.lit("n"), F.col("node").cast("string")))
    # A text between two tags is a piece as it is; only those in rubies, or beside others, are put together.
    single = F.col("alone") & F.col("ruby").isNull()
    many = texts.filter(~single & F.col("rt").isNull()).groupBy(*PAGE, "block", "ruby", by.alias("_by")).agg(F.min("k").alias("k"), collapsed(joined()).alias("piece"))
    kept = [*PAGE, "block", "ruby", "k", "piece"]
    base = many.select(*kept).unionByName(texts.filter(single & F.col("rt").isNull()).withColumn("piece", collapsed(F.col("body"))).select(*kept)).filter("piece <> ''")
    read = texts.filter("rt IS NOT NULL").groupBy(*PAGE, "ruby", "rt").agg(stripped_join(joined()).alias("s")).filter("s <> ''")
    read = read.groupBy(*PAGE, "ruby").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rt", "s"))), lambda x: x["s"]), " ").alias("rt"))
    w = Window.partitionBy(*PAGE, "block").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    out = base.join(read, [*PAGE, "ruby"], "left").withColumn("start", F.coalesce(F.sum(F.length("piece")).over(w), F.lit(0)).cast("long"))
    return out.select(*PAGE, "block", "k", "piece", "rt", "start")


def stripped_join(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACES}|{SPACES}$", "")


def page_blocks(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, anchors) of pages (book, path, markup).

    blocks: book, path, block (from 0), tag, text, ruby (start, end, base, rt), src, alt. A block goes from where an
    element begins it to where the next one does; blocks without text are left out, but for images. anchors: book,
    path, anchor, block, offset: the place of each named element, the first of a name.
    """
    walk = settled(walked(pages))
    parts = settled(_pieces(walk))
    row = F.struct("start", "piece", "rt")
    texts = parts.groupBy(*PAGE, "block").agg(F.array_sort(F.collect_list(row)).alias("_p"))
    heads = walk.filter("begins").groupBy(*PAGE, "block").agg(F.first("name").alias("tag"), F.first(attribute(F.col("x"), "src")).alias("_src"), F.first(attribute(F.col("x"), "href")).alias("_href"), F.first(attribute(F.col("x"), "alt")).alias("alt"))
    all_ = texts.join(heads, [*PAGE, "block"], "full").withColumn("image", F.coalesce(F.col("tag").isin(IMAGES), F.lit(False))).filter("image OR _p IS NOT NULL")
    told = F.transform(F.filter("_p", lambda x: x["rt"].isNotNull()), lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["piece"])).alias("end"), x["piece"].alias("base"), x["rt"].alias("rt")))
    none = F.array().cast("array<struct<start: bigint, end: bigint, base: string, rt: string>>")
    kept = all_.select(
        *PAGE, F.col("block").alias("_b"), F.coalesce("tag", F.lit("p")).alias("tag"), F.coalesce(F.array_join(F.transform("_p", lambda x: x["piece"]), ""), F.lit("")).alias("text"),
        F.coalesce(told, none).alias("ruby"), F.when(F.col("image"), F.coalesce("_src", "_href")).alias("src"), "alt",
    ).withColumn("block", F.row_number().over(Window.partitionBy(*PAGE).orderBy("_b")) - 1)
    named = F.coalesce(attribute(F.col("x"), "id"), F.when(F.col("name") == "a", attribute(F.col("x"), "name")))
    marks = walk.filter("name IS NOT NULL AND x NOT LIKE '</%' AND (ruby IS NULL OR name = 'ruby')").select(*PAGE, "block", "k", named.alias("anchor")).filter("anchor IS NOT NULL")
    marks = marks.groupBy(*PAGE, "anchor").agg(F.min_by(F.struct("block", "k"), "k").alias("m")).select(*PAGE, "anchor", "m.*")
    so_far = marks.join(parts.select(*PAGE, "block", F.col("k").alias("_k"), "piece"), [*PAGE, "block"], "left").groupBy(*PAGE, "anchor", "block").agg(F.sum(F.when(F.col("_k") < F.col("k"), F.length("piece"))).alias("offset"))
    # A block that isn't kept gives way to the next one that is.
    both = so_far.select(*PAGE, F.col("block").alias("_b"), "anchor", "offset", F.lit(None).cast("int").alias("block")).unionByName(kept.select(*PAGE, "_b", F.lit(None).cast("string").alias("anchor"), F.lit(None).cast("long").alias("offset"), "block"))
    before = F.count("block").over(Window.partitionBy(*PAGE).orderBy("_b").rangeBetween(Window.unboundedPreceding, -1))
    anchors = both.withColumn("_n", before).filter("anchor IS NOT NULL").select(*PAGE, "anchor", F.col("_n").cast("int").alias("block"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset"))
    return kept.drop("_b"), anchors


def contents(pages: DataFrame, ncx: bool = False) -> DataFrame:
    """book, path, entry (from 0), parent, title, href, volume (titles above it), is_parent of pages of contents.

    Pages have lists in a nav of the kind toc, or of none; with ncx, navPoint elements. Entries are in the order in
    which they begin; an entry's parent is the one around it.
    """
    item, labels = ("navPoint", ["navLabel"]) if ncx else ("li", ["a", "span"])
    w = Window.partitionBy(*PAGE).orderBy("k")
    t = tokens(pages)
    opens = F.col("name").isNotNull() & ~F.col("x").startswith("</")
    if not ncx:
        nav = F.sum(F.when((F.col("name") == "nav") & opens, 1).otherwise(0)).over(w)
        kind = F.coalesce(attribute(F.col("x"), "type"), F.lit("toc"))
        t = t.withColumns({"_open": _inside(["nav"], w), "_nav": nav}).filter("_open > 0")
        t = t.withColumn("_toc", F.first(F.when(F.col("name") == "nav", F.array_contains(F.split(kind, " "), "toc")), True).over(w.partitionBy(*PAGE, "_nav"))).filter("_toc")
    own = opens & (F.col("name") == item)
    t = t.withColumns({"_level": _inside([item], w), "_entry": F.when(own, F.count(F.when(own, 1)).over(w) - 1)})
    at = Window.partitionBy(*PAGE, "_level").orderBy("k")
    t = t.withColumns({"_of": F.last("_entry", True).over(at), "_top": F.last(F.when(own, F.col("depth")), True).over(at)})
    direct = opens & (F.col("_level") > 0) & (F.col("depth") - F.when(F.col("step") == 0, 0).otherwise(1) == F.col("_top"))
    is_label = direct & F.col("name").isin(labels)
    first = F.min(F.when(is_label, F.col("k"))).over(Window.partitionBy(*PAGE, "_of"))
    t = t.withColumn("_label", F.when(is_label & (F.col("k") == first), F.col("_of")))
    # A label ends where its element closes: of the closes at its depth, the next one.
    t = t.withColumn("_height", F.when(F.col("step") == 1, F.col("depth")).when(F.col("step") == -1, F.col("depth") + 1))
    opened = F.lag(F.col("_label").isNotNull()).over(Window.partitionBy(*PAGE, "_height").orderBy("k"))
    t = t.withColumn("_shuts", (F.col("step") == -1) & F.coalesce(opened, F.lit(False)))
    edge = F.when(F.col("_label").isNotNull() & (F.col("step") == 1), 1).when(F.col("_shuts"), -1).otherwise(0)
    t = t.withColumns({"_in": F.sum(edge).over(w), "_last": F.last("_label", True).over(w)})
    t = settled(t)
    said = t.filter("body IS NOT NULL AND _in > 0").groupBy(*PAGE, F.col("_last").alias("entry")).agg(collapsed(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "body"))), lambda x: x["body"]), "")).alias("title"))
    source = (direct & (F.col("name") == "content")) if ncx else F.col("_label").isNotNull()
    links = t.filter(source).groupBy(*PAGE, F.col("_of").alias("entry")).agg(F.min_by(attribute(F.col("x"), "src" if ncx else "href"), "k").alias("href"))
    items = t.filter("_entry IS NOT NULL").select(*PAGE, "k", F.col("_entry").alias("entry"), "_level")
    # Each entry tells its level who it is, and asks the level above.
    asked = items.select(*PAGE, "k", F.explode(F.array(F.struct(F.col("_level").alias("l"), F.col("entry").alias("own"), F.lit(None).cast("long").alias("asks")), F.struct((F.col("_level") - 1).alias("l"), F.lit(None).cast("long").alias("own"), F.col("entry").alias("asks")))).alias("e")).select(*PAGE, "k", "e.*")
    parents = asked.withColumn("parent", F.last("own", True).over(Window.partitionBy(*PAGE, "l").orderBy("k"))).filter("asks IS NOT NULL").select(*PAGE, F.col("asks").alias("entry"), "parent")
    keys = [*PAGE, "entry"]
    rows = settled(items.drop("k").join(parents, keys).join(said, keys, "left").join(links, keys, "left").na.fill("", ["title", "href"]))
    up = rows.select(*PAGE, F.col("entry").alias("_p"), F.col("title").alias("_t"), F.col("parent").alias("_pp"))
    out = rows.withColumns({"volume": F.array().cast("array<string>"), "_next": F.col("parent")})
    for _ in range((rows.agg(F.max("_level")).first()[0] or 1) - 1):
        out = out.join(up.withColumnRenamed("_p", "_next"), [*PAGE, "_next"], "left").withColumns({"volume": F.concat(F.when(F.col("_t") != "", F.array("_t")).otherwise(F.array().cast("array<string>")), "volume"), "_next": F.col("_pp")}).drop("_t", "_pp")
    with_children = rows.filter("parent IS NOT NULL").select(*PAGE, F.col("parent").alias("entry"), F.lit(True).alias("_kids")).distinct()
    out = out.join(with_children, keys, "left")
    return out.select(*keys, "parent", "title", "href", F.array_join("volume", " · ").alias("volume"), F.coalesce("_kids", F.lit(False)).alias("is_parent"))


def resolved(base: Column, href: Column) -> Column:
    """struct(path, fragment) of a link in a file; nulls for one that leads outside."""

    @F.pandas_udf("path string, fragment string")
    def run(bases: pd.Series, hrefs: pd.Series) -> pd.DataFrame:
        rows = []
        for b, h in zip(bases, hrefs, strict=True):
            parts = urlsplit(h or "")
            steps: list[str] | None = (b or "").split("/")[:-1] if parts.path else (b or "").split("/")
            for s in unquote(parts.path).split("/") if parts.path else []:
                if s == ".." and steps is not None:
                    steps = steps[:-1] if steps else None
                elif s not in ("", ".") and steps is not None:
                    steps = [*steps, s]
            outside = bool(parts.scheme or parts.netloc or parts.path.startswith("/") or steps is None or not h)
            rows.append((None, None) if outside else ("/".join(steps or []), parts.fragment or None))
        return pd.DataFrame(rows, columns=["path", "fragment"])

    return run(base, href)


def chapters(blocks: DataFrame, anchors: DataFrame, entries: DataFrame, spine: DataFrame) -> DataFrame:
    """book, chapter (from 0), title, path, block (of the book, from 0), start, text, continues: all blocks, in chapters.

    spine: book, path, position; entries: as contents() has them, of one page a book. A chapter begins where an entry
    leads to, which may be within a block, and ends where the next one begins. Of entries that lead to the same place,
    the first one without entries of its own is the chapter. What comes before the first chapter is one by itself,
    unless that is no text. Entries that lead nowhere are passed over.
    """
    b = blocks.join(spine, PAGE)
    b = settled(b.withColumn("_g", (F.row_number().over(Window.partitionBy("book").orderBy("position", "block")) - 1).cast("long")))
    sizes = spine.join(blocks.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("_n")), PAGE, "left").na.fill(0, ["_n"])
    w = Window.partitionBy("book").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*PAGE, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))
    e = entries.filter("href <> ''").withColumn("_to", resolved(F.col("path"), F.col("href"))).select("book", "entry", "title", "volume", "is_parent", F.col("_to.path").alias("path"), F.col("_to.fragment").alias("fragment")).filter("path IS NOT NULL").join(starts, PAGE)
    e = e.join(anchors.select(*PAGE, F.col("anchor").alias("fragment"), "block", "offset"), [*PAGE, "fragment"], "left").filter("fragment IS NULL OR block IS NOT NULL")
    e = e.withColumns({"_g": F.col("_start") + F.coalesce("block", F.lit(0)), "_o": F.coalesce("offset", F.lit(0))}).drop("block", "offset", "_start")
    # A place at the end of a block is the beginning of the next one.
    size = b.select("book", "_g", F.length("text").cast("long").alias("_len"))
    e = e.join(size, ["book", "_g"]).withColumn("_end", (F.col("_len") > 0) & (F.col("_o") == F.col("_len")))
    e = e.withColumns({"_g": F.when(F.col("_end"), F.col("_g") + 1).otherwise(F.col("_g")), "_o": F.when(F.col("_end"), F.lit(0)).otherwise(F.col("_o"))}).drop("_len", "_end").join(size.select("book", "_g"), ["book", "_g"])
    label = F.struct("path", "title", "volume")
    points = e.groupBy("book", "_g", "_o").agg(F.min_by(label, F.struct("is_parent", F.when(F.col("is_parent"), -F.col("entry")).otherwise(F.col("entry")))).alias("x")).select("book", "_g", "_o", "x.*")
    points = settled(points)
    least = points.groupBy("book").agg(F.min(F.struct("_g", "_o")).alias("_first"))
    told = b.filter("text <> ''").groupBy("book").agg(F.min("_g").alias("_text"))
    least = least.join(told, "book", "left")
    points = points.join(least, "book")
    first = (F.col("_g") == F.col("_first._g")) & (F.col("_o") == F.col("_first._o"))
    moved = first & (F.col("_o") == 0) & (F.col("_text").isNull() | (F.col("_text") >= F.col("_g")))
    points = points.withColumn("_g", F.when(moved, F.lit(0).cast("long")).otherwise(F.col("_g")))
    name = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.lit(UNTITLED))
    points = points.select("book", "_g", "_o", "path", F.when(F.col("volume") != "", F.concat("volume", F.lit(" · "), name)).otherwise(name).alias("title"))
    opening = b.filter("_g = 0").select("book", "_g", F.lit(0).cast("long").alias("_o"), "path", F.lit(FRONT).alias("title"))
    front = opening.join(points.filter("_g = 0 AND _o = 0").select("book"), "book", "left_anti").join(points.select("book").distinct(), "book", "left_semi")
    points = points.unionByName(front)
    # A block is cut where a chapter begins in it; each part belongs to the last chapter that began by then.
    cuts = points.filter("_o > 0").groupBy("book", "_g").agg(F.array_sort(F.collect_set("_o")).alias("_cuts"))
    parts = b.join(cuts, ["book", "_g"], "left").withColumn("_at", F.concat(F.array(F.lit(0).cast("long")), F.coalesce("_cuts", F.array().cast("array<bigint>"))))
    parts = parts.select("book", "_g", "text", "_at", F.posexplode("_at").alias("_i", "_o"))
    text = F.substring("text", (F.col("_o") + 1).cast("int"), (F.coalesce(F.get("_at", F.col("_i") + 1), F.length("text")) - F.col("_o")).cast("int"))
    parts = parts.select("book", "_g", "_o", F.lit(1).alias("_asks"), text.alias("text"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("title"))
    both = parts.unionByName(points.select("book", "_g", "_o", F.lit(0).alias("_asks"), F.lit(None).cast("string").alias("text"), "path", "title"))
    w = Window.partitionBy("book").orderBy("_g", "_o", "_asks")
    chapter = F.sum(F.when(F.col("_asks") == 0, 1).otherwise(0)).over(w) - 1
    out = both.withColumns({"chapter": chapter, "_x": F.last(F.when(F.col("_asks") == 0, F.struct("path", "title")), True).over(w)}).filter("_asks = 1 AND chapter >= 0")
    return out.select("book", "chapter", F.col("_x.title").alias("title"), F.col("_x.path").alias("path"), F.col("_g").alias("block"), F.col("_o").alias("start"), "text", (F.col("_o") > 0).alias("continues"))
