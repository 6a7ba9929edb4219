"""Columns of short paragraphs that style sheets set upright or beside each other, made into running text.

A page's elements come from `markup.tokens`, where an element that may be a column is one row, whatever it holds; only
those that are short enough are cut into their own tokens. Style sheets are cut into rows of selectors and declarations.
A selector is a pattern over the line of an element and what stands around it, so the cascade is a join of selectors with
the few elements that matter and the greatest of (importance, inline, specificity, order). Only pages with columns are matched.

Selectors have types, classes, ids and * joined by spaces or >; others are left out, each by itself. Nothing is loaded:
imports, conditional rules and pseudo-elements have no effect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.operators import markup
from narrata.operators.graph import settled
from narrata.operators.markup import ASIDE, INNER, PAGE, SPACES, TOKEN, attribute, collapsed, named, said

#: Elements that may be a column, and what may stand within its paragraphs (fixed values).
WRAPPERS = ["div", "section", "aside", "article"]
INLINE = ["span", "em", "strong", "b", "i", "u", "small", "ruby", "rb", "rt", "rp", "br", "a", "sup", "sub", "p"]
#: Paragraphs of a column, letters of a paragraph and of a column, letters of columns that are put together (fixed values).
LEAST, MOST, LETTERS, ALL_LETTERS = 3, 160, 12, 160
#: Bytes of a sheet and of a page's sheets, selectors of a sheet and of a page's sheets (fixed values).
SHEET_BYTES, PAGE_BYTES, SELECTORS = 128 * 1024, 512 * 1024, 2048
#: Values that set text beside a column, and upright (fixed values).
BESIDE, UPRIGHT = ["right", "left", "inline-start", "inline-end"], ["vertical-rl", "vertical-lr", "tb-rl", "tb-lr"]
PROPERTIES = {"float": "float", "writing-mode": "writing-mode", "-epub-writing-mode": "writing-mode", "-webkit-writing-mode": "writing-mode"}

#: An element that may be a column: from the tag that opens it to the tag that closes it, without another of the kind.
LEAF = rf"<(?![!?]){named(*WRAPPERS)}{INNER}(?<!/)>(?:{ASIDE}|</?(?!{named(*WRAPPERS)})[^\s<>/!?]{INNER}>|[^<]++)*+</{named(*WRAPPERS)}[^<>\"']*+>"
#: What sheets are found by: a style with its texts, a link, all between them, and what is left.
SHEETS = rf"<(?![!?]){named('style')}{INNER}(?<!/)>(?:{ASIDE}|[^<]++)*+|<(?![!?]){named('link')}{INNER}>|(?:{ASIDE}|</?(?!{named('style', 'link')})[^\s<>/!?]{INNER}>|[^<]++)++|{TOKEN}"

_NAME = r"[-_A-Za-z0-9\x{80}-\x{10ffff}]+"
_COMPOUND = rf"(?:(?:\*|{_NAME})(?:[#.]{_NAME})*|(?:[#.]{_NAME})+)"
_STRING = r"\"[^\"]*\"|'[^']*'"
_BLOCK = rf"\{{(?:{_STRING}|[^{{}}\"']++)*+\}}"
for _ in range(3):
    _BLOCK = rf"\{{(?:{_STRING}|[^{{}}\"']++|{_BLOCK})*+\}}"
_SELECTOR = rf"^{_COMPOUND}(?:(?:\s*>\s*|\s+){_COMPOUND})*$"


def stripped(text: Column) -> Column:
    """text without white space at its ends; a long run of it within a text is passed once."""
    return F.regexp_replace(text, rf"^{SPACES}+|(?<!{SPACES[:-1]}){SPACES}+$", "")


def declarations(css: Column) -> Column:
    """[(name, value, important, index)] of the properties that matter in a block of declarations."""
    parts = F.split(F.regexp_replace(F.coalesce(css, F.lit("")), r"(?s)/\*.*?(?:\*/|$)", " "), ";")
    known = F.create_map(*[F.lit(x) for kv in PROPERTIES.items() for x in kv])

    def row(x: Column, k: Column) -> Column:
        told = F.lower(collapsed(F.regexp_extract(x, r"(?s)^\s*[-\w]+\s*:(.*)$", 1)))
        important = told.rlike("! ?important$")
        return F.struct(
            F.try_element_at(known, F.lower(F.regexp_extract(x, r"^\s*([-\w]+)\s*:", 1))).alias("name"), F.trim(F.regexp_replace(told, r"! ?important$", "")).alias("value"), important.alias("important"), k.alias("index")
        )

    return F.filter(F.transform(parts, row), lambda x: x["name"].isNotNull())


def pattern(selector: Column) -> Column:
    """The pattern of lines that a selector finds; see `line`."""
    tidy = F.regexp_replace(F.regexp_replace(selector, r"\s*>\s*", ">"), r"\s+", " ")
    steps = F.regexp_extract_all(tidy, F.lit(rf"[ >]?{_COMPOUND}"), F.lit(0))

    def compound(x: Column) -> Column:
        bare = F.regexp_replace(x, "^[ >]", "")
        kind = F.lower(F.regexp_extract(bare, rf"^(?:\*|{_NAME})?", 0))
        marks = F.transform(F.regexp_extract_all(bare, F.lit(rf"[#.]{_NAME}"), F.lit(0)), lambda m: F.concat(F.lit("(?=[^/]*"), F.when(m.startswith("."), F.lit(r"\.")).otherwise(F.lit("#")), F.substring(m, F.lit(2), F.length(m)), F.lit(";)")))
        far = F.when(x.startswith(">"), F.lit("")).otherwise(F.lit("(?:/[^/]*)*"))
        return F.concat(far, F.lit("/"), F.when(kind.isin("", "*"), F.lit("[^/;]*")).otherwise(kind), F.lit("(?=;)"), F.array_join(marks, ""), F.lit("[^/]*"))

    return F.concat(F.lit("^"), F.array_join(F.transform(steps, compound), ""), F.lit("$"))


def rules(sheets: DataFrame) -> DataFrame:
    """sheets (css, and columns that are kept) to a row for each selector: n (its number in the sheet), pattern, specificity, d (declarations)."""
    css = F.regexp_replace(F.coalesce("css", F.lit("")), r"(?s)/\*.*?(?:\*/|$)", " ")
    css = F.regexp_replace(css, rf"@(?:{_STRING}|[^{{}};\"']++)*+(?:;|{_BLOCK})", " ")
    keep = [c for c in sheets.columns if c != "css"]
    r = sheets.select(*keep, F.posexplode(F.regexp_extract_all(css, F.lit(rf"(?<![^{{}}])[^{{}}]++\{{(?:{_STRING}|[^{{}}\"']++)*+\}}"), F.lit(0))).alias("_r", "x"))
    r = r.select(*keep, "_r", F.regexp_extract("x", r"(?s)^([^{]*)\{", 1).alias("_s"), declarations(F.regexp_extract("x", r"(?s)\{(.*)\}$", 1)).alias("d")).filter(F.size("d") > 0)
    r = r.select(*keep, "_r", "d", F.posexplode(F.split("_s", ",")).alias("_k", "_s")).withColumn("_s", collapsed(F.col("_s")))
    r = r.filter((F.col("_s") != "") & F.col("_s").rlike(_SELECTOR))
    count = lambda p: F.size(F.regexp_extract_all("_s", F.lit(p), F.lit(0)))
    specificity = F.struct(count(f"#{_NAME}").alias("a"), count(rf"\.{_NAME}").alias("b"), count(rf"(?<![#.\w\x{{80}}-\x{{10ffff}}-]){_NAME}").alias("c"))
    number = F.row_number().over(Window.partitionBy(*keep).orderBy("_r", "_k")) - 1
    return r.select(*keep, number.alias("n"), pattern(F.col("_s")).alias("pattern"), specificity.alias("specificity"), "d").filter(F.col("n") < SELECTORS)


def line(name: Column, tag: Column) -> Column:
    """/name;#id;.class;.class; of an element: one step of the lines that patterns are held against."""
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[/;.#]", "\x01")
    classes = F.filter(F.split(clean(attribute(tag, "class")), SPACES), lambda x: x != "")
    own = clean(attribute(tag, "id"))
    return F.concat(F.lit("/"), clean(name), F.lit(";"), F.when(own != "", F.concat(F.lit("#"), own, F.lit(";"))).otherwise(""), F.array_join(F.transform(classes, lambda c: F.concat(F.lit("."), c, F.lit(";"))), ""))


def _leveled(pages: DataFrame, leaf: str | None = None) -> DataFrame:
    """tokens() with opens, and level: how many elements an element, or a text, is within, itself included."""
    t = markup.tokens(pages, leaf)
    opens = F.col("name").isNotNull() & ~F.col("x").startswith("</")
    inner = F.col("name").isNull() | F.col("x").endswith("/>") | (F.col("step") == -1)
    if leaf:
        inner |= F.col("whole").isNotNull()
    return t.withColumns({"opens": opens, "level": F.col("depth") + F.when(inner, 1).otherwise(0)})


def _unread(w) -> Column:
    """Whether a token is in no reading of a ruby."""
    return F.sum(F.when(F.col("name").isin("rt", "rp"), F.col("step")).otherwise(0)).over(w) == 0


def columns(leaves: DataFrame) -> DataFrame:
    """book, path, k, level, single (every paragraph is one letter), letters, tags: elements of a few short paragraphs only.

    leaves: book, path, k, level, whole: elements that hold no other that could be one. Each is cut like a page of its
    own; tags are its paragraphs' own among its tokens. One with more letters than a column may have isn't cut, unless
    some of them may not count, in readings, breaks or asides.
    """
    simple = ~F.col("whole").rlike(r"<[!?]|<(?:[^\s<>/:]+:)*(?:rt|rp|br)(?![^\s<>/:])")
    least = F.length(F.regexp_replace("whole", rf"<{INNER}>|&#?[A-Za-z0-9]+;|{SPACES}", ""))
    t = leaves.filter(~simple | (least <= ALL_LETTERS)).select("book", F.struct("path", "k", "level").alias("path"), F.col("whole").alias("markup"))
    w = Window.partitionBy(*PAGE).orderBy("k")
    t = _leveled(t)
    child = F.col("opens") & (F.col("level") == 2)
    t = t.withColumns({"_said": _unread(w), "_n": F.count(F.when(child, 1)).over(w), "_of": F.last(F.when(child, F.col("name")), True).over(w)}).filter("level > 1")
    direct, is_text = F.col("level") == 2, F.col("body").isNotNull()
    bad = F.when(is_text, direct & (stripped(F.col("body")) != "")).when(child, ~F.col("name").isin("p", "br")).otherwise(F.col("opens") & (F.col("_of") == "p") & ~F.col("name").isin(INLINE))
    joined = lambda rows: F.array_join(F.transform(F.array_sort(rows), lambda x: x["body"]), "")
    told = F.collect_list(F.when(is_text & F.col("_said"), F.struct("k", "body")))
    # Texts of an element itself, between its paragraphs, count where columns are put together.
    part = F.when(direct & is_text, F.lit(-1) - F.col("k")).otherwise(F.col("_n"))
    p = t.withColumns({"_bad": bad, "_part": part}).groupBy(*PAGE, "_part").agg(
        F.max("_bad").alias("_bad"), F.min("k").alias("k"), F.first("_of").alias("_of"), joined(told).alias("body"), F.collect_list(F.when(direct & (F.col("name") == "p"), F.col("k"))).alias("_tags")
    )
    p = p.withColumns({"_p": (F.col("_part") > 0) & (F.col("_of") == "p"), "_len": F.length(stripped(F.col("body")))})
    out = p.groupBy(*PAGE).agg(
        F.max("_bad").alias("bad"), F.count_if("_p").alias("n"), F.min(F.when(F.col("_p"), F.col("_len"))).alias("least"), F.max(F.when(F.col("_p"), F.col("_len"))).alias("most"),
        F.sum(F.when(F.col("_p"), F.col("_len"))).alias("sum"), F.collect_list(F.struct("k", "body")).alias("_texts"), F.flatten(F.collect_list("_tags")).alias("tags"),
    )
    out = out.filter(~F.col("bad") & F.col("n").between(LEAST, MOST) & (F.col("least") > 0) & (F.col("most") <= LETTERS) & (F.col("sum") <= ALL_LETTERS))
    letters = F.length(stripped(joined(F.col("_texts"))))
    return out.select("book", "path.*", (F.col("most") == 1).alias("single"), letters.alias("letters"), "tags")


def page_sheets(pages: DataFrame, sheets: DataFrame) -> DataFrame:
    """book, path, k, css: what each page's style and link elements give, in order, as far as the bytes of a page go.

    sheets: book, path, css. A sheet that is too much for the rest is passed over, and the next one is tried.
    """
    is_ = lambda x, *names: x.rlike(rf"^<(?![!?]){named(*names)}")
    found = F.filter(F.regexp_extract_all("markup", F.lit(SHEETS), F.lit(0)), lambda x: is_(x, "style", "link"))
    t = pages.select(*PAGE, F.posexplode(found).alias("k", "x"))
    texts = F.transform(F.regexp_extract_all("x", F.lit(TOKEN), F.lit(0)), said)
    own = t.filter(is_(F.col("x"), "style")).select(*PAGE, "k", F.array_join(texts, "").alias("css"))
    rel = F.split(F.lower(F.coalesce(attribute(F.col("x"), "rel"), F.lit(""))), SPACES)
    links = t.filter(is_(F.col("x"), "link")).filter(F.array_contains(rel, "stylesheet")).select(*PAGE, "k", markup.resolved(F.col("path"), attribute(F.col("x"), "href"))["path"].alias("_to"))
    linked = links.join(sheets.select("book", F.col("path").alias("_to"), "css"), ["book", "_to"]).select(*PAGE, "k", "css")
    all_ = settled(own.unionByName(linked).withColumn("_b", F.octet_length("css")).filter("_b > 0"))
    row = F.array_sort(F.collect_list(F.struct("k", "_b")))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("ks"))
    fits = lambda acc, x: acc["used"] + x["_b"] <= PAGE_BYTES
    taken = F.aggregate(row, start, lambda acc, x: F.when(fits(acc, x), F.struct((acc["used"] + x["_b"]).alias("used"), F.concat(acc["ks"], F.array(x["k"])).alias("ks"))).otherwise(acc))
    kept = all_.groupBy(*PAGE).agg(taken["ks"].alias("ks")).select(*PAGE, F.explode("ks").alias("k"))
    return all_.join(kept, [*PAGE, "k"]).filter(F.col("_b") <= SHEET_BYTES).select(*PAGE, "k", "css")


def _lineages(tokens: DataFrame, asked: DataFrame) -> DataFrame:
    """book, path, k, level, own, x, steps: for each element asked for, the elements around it and itself, with their lines."""
    told = tokens.filter("opens").select(*PAGE, "k", F.col("level").alias("l"), F.struct(F.col("k").alias("own"), "x", line(F.col("name"), F.col("x")).alias("line")).alias("own"), F.lit(None).cast("int").alias("asks"), F.lit(0).alias("late"))
    asks = asked.select(*PAGE, "k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("level").cast("long"))).alias("l"), F.lit(None).cast(told.schema["own"].dataType).alias("own"), F.col("k").alias("asks"), F.lit(1).alias("late"))
    found = told.unionByName(asks).withColumn("own", F.last("own", True).over(Window.partitionBy(*PAGE, "l").orderBy("k", "late"))).filter("asks IS NOT NULL")
    chain = F.array_sort(F.collect_list(F.struct("l", "own")).over(Window.partitionBy(*PAGE, "k")))
    out = found.select(*PAGE, F.col("asks").alias("k"), "l", "own").withColumn("_c", chain)
    steps = F.array_join(F.transform(F.filter("_c", lambda x: x["l"] <= F.col("l")), lambda x: x["own"]["line"]), "")
    return out.select(*PAGE, "k", F.col("l").alias("level"), F.col("own.own").alias("own"), F.col("own.x").alias("x"), steps.alias("steps"))


def styles(pages: DataFrame, tokens: DataFrame, asked: DataFrame, sheets: DataFrame) -> DataFrame:
    """asked (book, path, k, level: elements of the pages' tokens) with beside and upright, as the page's sheets and the elements' own styles say."""
    lines = settled(_lineages(tokens, asked))
    around = lines.select(*PAGE, "own", "x", "steps").dropDuplicates([*PAGE, "own"])
    r = rules(page_sheets(pages, sheets))
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy("k", "n")) - 1
    r = r.withColumn("order", order).filter(F.col("order") < SELECTORS).drop("k", "n")
    hit = around.join(r, PAGE).filter(F.regexp_like("steps", F.col("pattern")))
    rank = lambda inline, spec, at: F.struct(F.col("d.important").alias("important"), F.lit(inline).alias("inline"), spec.alias("specificity"), at.alias("order"), F.col("d.index").alias("index"))
    none = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"))
    said = hit.select(*PAGE, "own", F.explode("d").alias("d"), "specificity", "order").select(*PAGE, "own", "d.name", "d.value", rank(0, F.col("specificity"), F.col("order")).alias("rank"))
    style = attribute(F.col("x"), "style")
    inline = around.filter(F.length(style) <= SHEET_BYTES).select(*PAGE, "own", F.explode(declarations(style)).alias("d")).select(*PAGE, "own", "d.name", "d.value", rank(1, none, F.lit(0)).alias("rank"))
    value = said.unionByName(inline).groupBy(*PAGE, "own").pivot("name", ["float", "writing-mode"]).agg(F.max_by("value", "rank"))
    x = lines.join(value, [*PAGE, "own"], "left")
    mode = F.max_by("writing-mode", F.when(F.coalesce(F.col("writing-mode"), F.lit("inherit")) != "inherit", F.col("level")))
    out = x.groupBy(*PAGE, "k").agg(F.max(F.when(F.col("own") == F.col("k"), F.col("float"))).alias("_float"), mode.alias("_mode"))
    is_ = lambda c, among: F.coalesce(F.col(c).isin(among), F.lit(False))
    return asked.join(out.select(*PAGE, "k", is_("_float", BESIDE).alias("beside"), is_("_mode", UPRIGHT).alias("upright")), [*PAGE, "k"], "left").na.fill(False, ["beside", "upright"])


def running(pages: DataFrame, sheets: DataFrame) -> DataFrame:
    """pages (book, path, markup) with the paragraphs of decorative columns as spans, and columns: how many were found.

    A column of single letters is one if it is upright or beside other text, one of short paragraphs if it is beside
    other text on a page with at least two columns of single letters that are. Columns of single letters that are all
    that an element holds become spans too. The other markup stays as it is. sheets: book, path, css. A page without
    markup (null) stays so, with no columns; a page is told by book and path, which are distinct.
    """
    t = settled(_leveled(pages, LEAF).withColumn("unread", _unread(Window.partitionBy(*PAGE).orderBy("k"))))
    found = settled(columns(t.filter("whole IS NOT NULL AND unread")))
    some = found.select(*PAGE).distinct()
    near = t.join(some, PAGE, "left_semi")
    s = styles(pages.join(some, PAGE, "left_semi"), near, found, sheets).withColumn("_two", F.count_if(F.col("beside") & F.col("single")).over(Window.partitionBy(*PAGE)) >= 2)
    won = settled(s.filter((F.col("upright") & F.col("single")) | (F.col("beside") & (F.col("single") | F.col("_two")))))
    near = near.join(won.select(*PAGE).distinct(), PAGE, "left_semi")
    # Who holds what: each token asks the level above it. What a leaf holds can be no column.
    near = near.join(won.select(*PAGE).distinct(), PAGE, "left_semi")
    tell = near.filter("opens").select(*PAGE, "k", F.col("level").alias("l"), F.col("k").alias("own"), F.lit(False).alias("asks"), F.lit(None).cast("boolean").alias("text"))
    ask = near.filter("opens OR trim(body) <> ''").select(*PAGE, "k", (F.col("level") - 1).alias("l"), F.lit(None).cast("int").alias("own"), F.lit(True).alias("asks"), F.when(F.col("opens"), F.lit(False)).otherwise(stripped(F.col("body")) != "").alias("text"))
    held = tell.unionByName(ask).withColumn("of", F.last("own", True).over(Window.partitionBy(*PAGE, "l").orderBy("k"))).filter("asks AND of IS NOT NULL").select(*PAGE, "k", "of", "text")
    held = settled(held.join(won.select(*PAGE, "k", "single", "letters"), [*PAGE, "k"], "left"))
    whole = held.groupBy(*PAGE, "of").agg(F.max("text").alias("text"), F.count_if(~F.col("text")).alias("n"), F.count_if("single").alias("ones"), F.sum("letters").alias("letters"))
    whole = whole.filter((F.col("n") >= 2) & (F.col("n") == F.col("ones")) & ~F.col("text") & (F.col("letters") <= ALL_LETTERS)).select(*PAGE, "of")
    united = held.filter("NOT text").join(whole, [*PAGE, "of"], "left_semi").select(*PAGE, "k", F.lit(True).alias("_united"))
    # A column's tags are renamed within it, and its own where it was put together with those beside it.
    spans = won.select(*PAGE, "k", "tags").join(united, [*PAGE, "k"], "left").withColumn("_united", F.coalesce("_united", F.lit(False)))
    cut = pages.join(won.select(*PAGE).distinct(), PAGE, "left_semi").select(*PAGE, F.posexplode(F.regexp_extract_all("markup", F.lit(f"{LEAF}|{TOKEN}"), F.lit(0))).alias("k", "x")).join(spans, [*PAGE, "k"], "left")
    inner = F.regexp_extract_all("x", F.lit(TOKEN), F.lit(0))
    own = lambda k: F.col("_united") & ((k == 0) | (k == F.size(inner) - 1))
    put = F.transform(inner, lambda x, k: F.when(own(k) | F.array_contains("tags", k), F.regexp_replace(x, r"^(</?)[^\s<>/]+", "$1span")).otherwise(x))
    again = cut.select(*PAGE, "k", F.when(F.col("tags").isNotNull(), F.array_join(put, "")).otherwise(F.col("x")).alias("x")).groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda y: y["x"]), "").alias("_m"))
    counts = won.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("columns"))
    out = pages.join(again, PAGE, "left").join(counts, PAGE, "left")
    return out.select(*[F.coalesce("_m", "markup").alias(c) if c == "markup" else F.col(c) for c in pages.columns], F.coalesce("columns", F.lit(0)).cast("long").alias("columns"))
