"""Text segmentation with code-point offsets, chapters, cues, token estimates, and the quote scanner."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.functions.slices import mapped
from narrata.operators import intervals
from narrata.operators.graph import settled

#: Delimiter pairs, their names, and the kind that they hint at (fixed values).
PAIRS = {"「": "」", "『": "』", "“": "”", "‘": "’", "〈": "〉", "《": "》", "（": "）", "(": ")"}
NAMES = {
    "「": "corner_bracket", "『": "corner_bracket_double", "“": "curly_double", "‘": "curly_single",
    "〈": "angle_single", "《": "angle_double", "（": "paren_fullwidth", "(": "paren_ascii",
}
HINTS = {"〈": "quotation", "《": "quotation", "（": "other", "(": "other"}
#: Longest quote, most line breaks in it, deepest nesting; an opening that is older than CEILING is given up.
MAX_LENGTH, MAX_LINES, MAX_DEPTH, CEILING = 1200, 3, 8, 4800
#: Words that hint at who speaks, and quote marks (fixed values).
CUES = ["说", "道", "问", "答", "喊", "叫", "低语", "嘟囔", "回答", "反问", "开口", "出声", "回话", "点头", "摇头", "笑", "叹", "沉默", "看向", "转向", "抬起头", "低下头"]
MARKS = "「」『』“”\"'"
SENTENCE = r"[^。！？!?\n]*[。！？!?\n]|[^。！？!?\n]+$"
#: What strip() takes away at both ends of a string.
STRIP = r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$"
#: Headings of chapters: numbered ones, and names that stand alone (fixed values).
NUMBERED = "第[0-9０-９一二三四五六七八九十百千万零〇两]+[章节節回卷篇部]"
HEADING = f"^(?:{NUMBERED}[^\\n]{{0,20}}|序章|序言|序|楔子|引子|前言|后记|後記|尾声|尾聲|终章|終章|终幕|終幕|外传|外傳|番外)[^\\n]{{0,20}}$"
PROSE = "[，、。！!；;…]"
REPEATED = ["序章", "序言", "后记", "後記", "终章", "終章"]
#: Code points that count as a token each; of others, four do (fixed values).
WIDE = r"[\x{3400}-\x{9FFF}\x{3040}-\x{30FF}\x{3000}-\x{303F}\x{AC00}-\x{D7AF}\x{FF00}-\x{FFEF}\x{20000}-\x{2FA1F}]"


def parts(text: Column) -> Column:
    """The sentences of a text, as SENTENCE finds them: it is cut after each end of a sentence.

    A cut looks at one character at a time. The pattern's classes of all but the ends took some six times as long.
    """
    return F.filter(F.split(text, r"(?<=[。！？!?\n])", -1), lambda x: x != "")


def _cue_pattern() -> str:
    """Marks and cues of one character as classes; longer cues that hold none of them, looked for only where one may begin.

    Most characters are below all but two of these: one comparison passes them over.
    """
    single = [c for c in CUES if len(c) == 1]
    longer = [c for c in CUES if len(c) > 1 and not set(c) & set(single)]
    plain, wide = [c for c in MARKS if ord(c) < 128], [*(c for c in MARKS if ord(c) >= 128), *single]
    begins = sorted({c[0] for c in longer})
    least = min(ord(c) for c in (*wide, *begins))
    return f"[{''.join(plain)}]|(?=[\\x{{{least:x}}}-\\x{{ffff}}])(?:[{''.join(wide)}]|(?=[{''.join(begins)}])(?:{'|'.join(longer)}))"


_CUE = _cue_pattern()


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, STRIP, "")


def estimated_tokens(text: Column) -> Column:
    """A token for each wide character, and one for every four others or part of them; none for null."""
    wide = F.regexp_count(text, F.lit(WIDE))
    return F.coalesce(wide + F.floor((F.length(text) - wide + 3) / 4), F.lit(0)).cast("long")


def has_cue(text: Column) -> Column:
    """Whether the text may say who speaks: it has a quote mark or a cue."""
    return text.rlike(_CUE)


def suspicious(title: Column) -> Column:
    """Whether a numbered heading reads like prose."""
    return (F.length(title) > 50) | title.rlike(PROSE)


def is_heading(title: Column) -> Column:
    """title: a stripped line."""
    return F.length(title).between(1, 30) & ~(title.startswith("第") & suspicious(title)) & title.rlike(HEADING)


def split_lines(texts: DataFrame, owner: str = "book") -> DataFrame:
    """owner, line, body, sep, canonical and source offsets of every line, whatever its break.

    A break counts for one code point in the canonical text and as it is in the source. synthetic: not a line feed.
    """
    brk = "\r\n|\r|\n"
    seps = F.concat(F.regexp_extract_all("text", F.lit(brk), F.lit(0)), F.array(F.lit("")))
    t = texts.select(owner, F.posexplode(F.arrays_zip(F.split("text", brk, -1).alias("body"), seps.alias("sep"))).alias("line", "l"))
    t = t.select(owner, F.col("line").cast("long").alias("line"), "l.*").filter("body <> '' OR sep <> ''")
    w = Window.partitionBy(owner).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n, broken = F.length("body").cast("long"), F.when(F.col("sep") == "", 0).otherwise(1)
    end = F.sum(n + broken).over(w)
    source = F.sum(n + F.length("sep")).over(w) - F.length("sep") - n
    t = t.withColumns({"start_cp": end - broken - n, "text_end_cp": end - broken, "end_cp": end, "source_start_cp": source, "source_end_cp": source + n})
    return t.withColumn("synthetic", ~F.col("sep").isin("", "\n"))


def chaptered(lines: DataFrame, owner: str = "book") -> DataFrame:
    """Adds to lines: title (stripped), heading, opens (whether a chapter starts here) and ordinal, its number.

    A heading that repeats the end of the one before it, with blank lines between only, opens none. Text before the
    first heading is chapter 0, if there is any.
    """
    w = Window.partitionBy(owner).orderBy("line")
    t = lines.withColumn("title", stripped(F.col("body"))).withColumn("heading", is_heading(F.col("title")))
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_last", F.last(F.when(F.col("title") != "", F.struct("title", "heading")), True).over(upto))
    repeats = F.col("title").isin(REPEATED) & F.col("_last.heading") & F.endswith("_last.title", "title")
    t = t.withColumn("opens", F.col("heading") & ~F.coalesce(repeats, F.lit(False)))
    count = F.sum(F.col("opens").cast("long")).over(w)
    before = F.max((~F.col("opens") & (F.col("title") != "") & (count == 0)).cast("long")).over(Window.partitionBy(owner))
    none = F.max(F.col("opens").cast("long")).over(Window.partitionBy(owner)) == 0
    ordinal = F.when(none, F.lit(0)).when(count == 0, F.when(before == 1, F.lit(0))).otherwise(count - 1 + before)
    return t.withColumn("ordinal", ordinal.cast("long")).drop("_last")


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line, start_cp, end_cp of every line; a break counts for one."""
    t = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).withColumn("n", F.length("t").cast("long"))
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("end_cp", F.sum(F.col("n") + 1).over(w) - 1)
    return t.select("doc_id", F.col("line").cast("long").alias("line"), (F.col("end_cp") - F.col("n")).alias("start_cp"), "end_cp")


def plausibility(text: Column) -> Column:
    """1 minus the share of control, private-use and replacement characters; 1 for no text."""
    odd = F.length(text) - F.length(F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{E000}-\\x{F8FF}\\x{FFFD}]", ""))
    return F.when(F.length(text) == 0, F.lit(1.0)).otherwise(1 - odd / F.length(text))


def sentences(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(parts(F.col("text"))).alias("k", "s"))


def scan_piece(
    text: str, base: int = 0, before: Sequence[tuple[str, int, int]] = (), closes: Sequence[tuple[int, int]] = (), last: bool = True
) -> tuple[list[tuple], list[tuple], list[tuple[str, int, int]]]:
    """Quotes (start, end, opening, depth, start of what they lie in, normalized), warnings (code, position, opening,
    cause), and the openings that stay open, of a piece of a text that begins at base.

    An opening is closed by the nearest close of its pair; openings above it are dropped with a warning. Openings
    beyond the depth limit, closes without an opening, quotes that are too long or span too many lines, and openings
    whose newest neighbour grew older than CEILING give warnings too. before, and what stays open: (opening, position,
    line breaks from there to the piece's start, or end). closes: (opening, where it is to end) of quotes that end in
    this piece without a mark. last: nothing follows the piece.
    """
    opener = {c: o for o, c in PAIRS.items()}
    events = [(base + m.start(), 1, m.group()) for m in _DELIMITER.finditer(text)] + [(end, 0, opening) for opening, end in closes]
    warnings: list[tuple] = []
    # At one position, later openings end first, and all before the character itself.
    events.sort(key=lambda e: (e[0], e[1], -e[2] if e[1] == 0 else 0))
    stack = [(o, p) for o, p, _ in before]
    breaks_before = {p: n for _, p, n in before}
    found: list[tuple] = []

    def shut(at: int, end: int, normalized: bool) -> None:
        warnings.extend(("unclosed_quote", p, o, "outer") for o, p in stack[at + 1 :])
        opening, start = stack[at]
        del stack[at:]
        found.append((start, end, opening, len(stack), stack[-1][1] if stack else None, normalized))

    def give_up(position: int) -> None:
        if stack and position - stack[-1][1] > CEILING:
            warnings.extend(("unclosed_quote", p, o, "ceiling") for o, p in stack)
            stack.clear()

    def breaks(start: int, end: int) -> int:
        return breaks_before.get(start, 0) + text.count("\n", max(0, start - base), end - base)

    for position, real, what in events:
        if not real:
            give_up(position - 1)
            at = next((k for k, x in enumerate(stack) if x == ("“", what)), None)
            if at is None:
                warnings.append(("invalid_auto_close", what, "“", "unmatched"))
            else:
                shut(at, position, True)
            continue
        give_up(position)
        if what in PAIRS:
            if len(stack) < MAX_DEPTH:
                stack.append((what, position))
            else:
                warnings.append(("nesting_too_deep", position, what, "depth"))
            continue
        at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == opener[what]), None)
        if at is None:
            warnings.append(("stray_close", position, opener[what], "stray"))
        else:
            shut(at, position + 1, False)
    if last:
        give_up(base + len(text) - 1)
        warnings += [("unclosed_quote", p, o, "end") for o, p in reversed(stack)]
    quotes = []
    for q in found:
        if q[1] - q[0] > MAX_LENGTH:
            warnings.append(("quote_too_long", q[0], q[2], "length"))
        elif breaks(q[0], q[1]) > MAX_LINES:
            warnings.append(("quote_spans_too_many_paragraphs", q[0], q[2], "lines"))
        else:
            quotes.append(q)
    return sorted(quotes, key=lambda q: q[:2]), warnings, [(o, p, breaks(p, base + len(text))) for o, p in stack]


def _out_of_range(opening: int) -> tuple:
    return "invalid_auto_close", opening, "“", "range"


def scan(text: str, closes: list[tuple[int, int]] | None = None) -> tuple[list[tuple], list[tuple]]:
    """The quotes and warnings of a whole text, as scan_piece() has them; a quote's parent is one of the quotes, or none."""
    n, closes = len(text), closes or []
    quotes, warnings, _ = scan_piece(text, closes=[c for c in closes if c[0] < c[1] < n])
    kept = {q[0] for q in quotes}
    return sorted((*q[:4], q[4] if q[4] in kept else None, q[5]) for q in quotes), [_out_of_range(o) for o, end in closes if not o < end <= n] + warnings


_DELIMITER = re.compile("[" + "".join(map(re.escape, (*PAIRS, *PAIRS.values()))) + "]")
_QUOTES = "array<struct<start_cp: bigint, end_cp: bigint, opening: string, depth: int, parent_start: bigint, normalized: boolean, parent_end: bigint>>"
_WARNINGS = "array<struct<code: string, position: bigint, opening: string, cause: string>>"
_OPEN = "array<struct<opening: string, at: bigint, breaks: bigint>>"
#: Code points of a piece of a text that is scanned by itself.
PIECE = 1 << 18


def pieces_of(texts: DataFrame, size: int = PIECE) -> DataFrame:
    """book, piece, base, text, last, closes: texts in pieces of `size` code points, or segments put together to such.

    texts: book and text; or book, turn, seg and start_cp, the segments of texts in order, which are never all in one
    row. Either may have closes (an array of opening_cp, close_cp) in each row of a book.
    """
    closes = F.col("closes") if "closes" in texts.columns else F.array().cast("array<struct<opening_cp: bigint, close_cp: bigint>>")
    if "seg" in texts.columns:
        t = texts.select("book", "turn", "seg", "start_cp", closes.alias("closes"), F.floor(F.col("start_cp") / size).alias("piece"))
        rows = F.array_sort(F.collect_list(F.struct("turn", "seg")))
        put = t.groupBy("book", "piece").agg(F.min("start_cp").alias("base"), F.array_join(F.transform(rows, lambda x: x["seg"]), "").alias("text"), F.first("closes").alias("closes"))
        ends = t.groupBy("book").agg(F.max("piece").alias("_end"), F.max(F.col("start_cp") + F.length("seg")).alias("_n"))
        put = put.join(ends, "book").withColumn("last", F.col("piece") == F.col("_end"))
    else:
        text = F.coalesce("text", F.lit(""))
        # Texts of one piece stay as they are.
        parts = F.when(F.length(text) <= size, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))
        put = texts.select("book", F.length(text).alias("_n"), F.size(parts).alias("_many"), closes.alias("closes"), F.posexplode(parts).alias("piece", "text"))
        put = put.withColumns({"piece": F.col("piece").cast("long"), "base": F.col("piece").cast("long") * size, "last": F.col("piece") == F.col("_many") - 1})
    end = F.col("base") + F.length("text")
    bad = lambda c: ~((c["opening_cp"] < c["close_cp"]) & (c["close_cp"] <= F.col("_n")))
    own = F.filter(F.coalesce("closes", F.array()), lambda c: F.when(bad(c), F.col("piece") == 0).otherwise((c["close_cp"] >= F.col("base")) & (c["close_cp"] < end)))
    own = F.transform(own, lambda c: F.struct(c["opening_cp"].cast("long").alias("opening_cp"), c["close_cp"].cast("long").alias("close_cp"), bad(c).alias("bad")))
    return put.select("book", "piece", F.col("base").cast("long").alias("base"), "text", "last", own.alias("closes"))


def _scanned_rows(f: pd.DataFrame, states: bool) -> pd.DataFrame:
    names = ("start_cp", "end_cp", "opening", "depth", "parent_start", "normalized", "parent_end"), ("code", "position", "opening", "cause"), ("opening", "at", "breaks")
    got = []
    for text, base, before, closes, last in zip(f["text"], f["base"], f["before"], f["closes"], f["last"], strict=True):
        held = [(o["opening"], o["at"], o["breaks"]) for o in before]
        quotes, warnings, after = scan_piece(text, base, held, [(c["opening_cp"], c["close_cp"]) for c in closes if not c["bad"]], last)
        ends = {q[0]: q[1] for q in quotes}
        quotes = [(*q, ends.get(q[4])) for q in quotes]
        got.append((quotes, [_out_of_range(c["opening_cp"]) for c in closes if c["bad"]] + warnings, after))
    sides = [[[dict(zip(names[k], x, strict=True)) for x in g[k]] for g in got] for k in (range(3) if not states else (2,))]
    out = {"book": f["book"], "piece": f["piece"]}
    return pd.DataFrame(out | {"before": f["before"], "after": sides[0]} if states else out | {"quotes": sides[0], "warnings": sides[1]})


def _openings(pieces: DataFrame) -> DataFrame:
    """book, piece, before: the openings that are open where each piece begins.

    All pieces are scanned at once, as if nothing were open before them; then those again before which something is
    open after all, until nothing changes. Since no opening stays open for long (MAX_DEPTH times CEILING), a second round nearly
    always ends it, but no result depends on that.
    """
    kind = dict(pieces.dtypes)["book"]
    advance = lambda f: _scanned_rows(f, True)
    schema = f"book {kind}, piece bigint, before {_OPEN}, after {_OPEN}"
    none = F.array().cast(_OPEN)
    known = settled(mapped(pieces.withColumn("before", none), advance, schema))
    while True:
        want = F.coalesce(F.lag("after").over(Window.partitionBy("book").orderBy("piece")), none)
        wrong = settled(known.withColumn("want", want).filter("want <> before").select("book", "piece", F.col("want").alias("before")))
        if wrong.isEmpty():
            return known.select("book", "piece", "before")
        again = mapped(wrong.join(pieces, ["book", "piece"]), advance, schema)
        known = settled(known.join(wrong, ["book", "piece"], "left_anti").unionByName(again))


def scanned(texts: DataFrame, size: int = PIECE) -> DataFrame:
    """book, piece, quotes, warnings of texts as pieces_of() takes them.

    A long text is scanned in pieces by many tasks. What is open where a piece begins comes from the pieces before it.
    parent_start tells where the opening is that a quote lies in, whether or not that has become a quote; parent_end,
    where the quote ends that it has become in the same piece.
    """
    return _scanned(texts, size)[0]


def _scanned(texts: DataFrame, size: int) -> tuple[DataFrame, bool]:
    """scanned(), and whether no text has more than one piece."""
    pieces = pieces_of(texts, size)
    kind = dict(pieces.dtypes)["book"]
    if whole := pieces.filter("piece > 0").isEmpty():
        ready = pieces.withColumn("before", F.array().cast(_OPEN))
    else:
        pieces = settled(pieces)
        ready = pieces.join(_openings(pieces), ["book", "piece"])
    found = mapped(ready, lambda f: _scanned_rows(f, False), f"book {kind}, piece bigint, quotes {_QUOTES}, warnings {_WARNINGS}")
    return found, whole


def scan_quotes(texts: DataFrame, version: str = "scanner-1", size: int = PIECE) -> DataFrame:
    """The quotes of texts, one a row, with ids, names of their delimiters and the kinds these hint at."""
    found, whole = _scanned(texts, size)
    q = found.select("book", F.explode("quotes").alias("q")).select("book", "q.*")
    hint = F.when((F.col("opening") == "『") & (F.col("depth") > 0), "quotation").otherwise(_lookup(HINTS))
    ident = lambda a, b: stable_id("q", F.col("book"), F.col(a), F.col(b), version)
    q = q.withColumns({"quote_id": ident("start_cp", "end_cp"), "delimiter": _lookup(NAMES), "kind_hint": hint})
    if whole:
        q = q.withColumn("parent_id", F.when(F.col("parent_end").isNotNull(), ident("parent_start", "parent_end")))
    else:  # a quote's parent may end in another piece
        parent = q.select("book", F.col("start_cp").alias("parent_start"), F.col("quote_id").alias("parent_id"))
        q = q.join(parent, ["book", "parent_start"], "left")
    return q.withColumn("parent_start", F.when(F.col("parent_id").isNotNull(), F.col("parent_start"))).drop("parent_end")


def _lookup(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[F.col("opening")]


def stable_id(kind: str, owner: Column, start: Column, end: Column, version: str) -> Column:
    key = F.concat_ws("|", owner.cast("string"), start.cast("string"), end.cast("string"), F.lit(version))
    return F.concat(F.lit(kind), F.substring(F.sha1(key.cast("binary")), 1, 31))


#: Counters of a scan and the causes that they count.
COUNTERS = {
    "abandoned_open_quotes": ["ceiling"], "stray_closes": ["stray"], "unclosed_quotes": ["ceiling", "outer", "end"],
    "dropped_too_long": ["length"], "dropped_too_many_paragraphs": ["lines"], "depth_limit_hits": ["depth"],
}


def scan_stats(texts: DataFrame) -> DataFrame:
    """book and the ten counters of its scan."""
    how_many = lambda c, keep: F.sum(F.size(F.filter(c, keep))).cast("long")
    caused_by = lambda causes: lambda w: w["cause"].isin(*causes)
    return scanned(texts).groupBy("book").agg(
        F.sum(F.size("quotes")).cast("long").alias("quotes"), how_many("quotes", lambda q: q["depth"] == 0).alias("top_level_quotes"),
        F.sum(F.size("warnings")).cast("long").alias("warnings"),
        *(how_many("warnings", caused_by(causes)).alias(name) for name, causes in COUNTERS.items()),
        how_many("quotes", lambda q: q["normalized"]).alias("normalized_closes"),
    )


def whole_texts(segments: DataFrame) -> DataFrame:
    """book, text from segments (book, turn, seg)."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "seg")))
    return segments.groupBy("book").agg(F.array_join(F.transform(rows, lambda x: x["seg"]), "").alias("text"))


def narration_gaps(texts: DataFrame, quotes: DataFrame, version: str = "scanner-1") -> DataFrame:
    """book, gap_id, left_id, right_id, start_cp, end_cp between adjacent outer quotes, where there is more than white space."""
    w = Window.partitionBy("book").orderBy("start_cp")
    nxt = lambda c: F.lead(c).over(w)
    g = quotes.filter("depth = 0").select("book", F.col("quote_id").alias("left_id"), nxt("quote_id").alias("right_id"), F.col("end_cp").alias("start_cp"), nxt("start_cp").alias("end_cp"))
    g = g.filter("end_cp > start_cp").join(texts, "book")
    told = F.substring("text", (F.col("start_cp") + 1).cast("int"), (F.col("end_cp") - F.col("start_cp")).cast("int"))
    return g.filter(stripped(told) != "").withColumn("gap_id", stable_id("g", F.col("book"), F.col("start_cp"), F.col("end_cp"), version)).drop("text")


def rescanned(stored: DataFrame, scan: DataFrame) -> DataFrame:
    """book, start_cp, quote_id, outcome after a new scan.

    stored: book, start_cp, old_id, annotated. Quotes are the same if they start alike; then the old id stays. Stored
    quotes that the scan doesn't find go, unless they are annotated.
    """
    both = stored.join(scan.select("book", "start_cp", "quote_id"), ["book", "start_cp"], "full").filter("quote_id IS NOT NULL OR annotated")
    outcome = F.when(F.col("old_id").isNull(), "new").when(F.col("quote_id").isNull(), "protected").otherwise("updated")
    return both.select("book", "start_cp", F.coalesce("old_id", "quote_id").alias("quote_id"), outcome.alias("outcome"))


def bound_toc(toc: DataFrame, chapters: DataFrame) -> DataFrame:
    """book, line, chapter, target_cp for entries (book, line, ordinal, at) over chapters (book, ordinal, r_start, r_end).

    The chapter of the entry's ordinal if it holds the target, its end included; else the one that holds it; else an
    empty one just there.
    """
    own = chapters.select("book", "ordinal", F.col("r_start").alias("a"), F.col("r_end").alias("b"))
    t = toc.join(own, ["book", "ordinal"], "left")
    t = t.withColumn("own", F.when(F.col("at").between(F.col("a"), F.col("b")), F.col("ordinal"))).drop("a", "b", "ordinal")
    lost = t.filter("own IS NULL AND at IS NOT NULL").select("book", "line", "at")
    near = lost.join(chapters.withColumnRenamed("ordinal", "c"), "book").filter("at >= r_start AND at < r_end OR (r_start = at AND r_end = at)")
    near = near.groupBy("book", "line").agg(F.min_by("c", F.struct(F.col("r_start") == F.col("r_end"), "c")).alias("c"))
    out = t.join(near, ["book", "line"], "left").withColumn("chapter", F.coalesce("own", "c"))
    return out.select("book", "line", "chapter", F.when(F.col("chapter").isNotNull(), F.col("at")).alias("target_cp"))


def auto_close_suggestions(texts: DataFrame, owner: str = "book") -> DataFrame:
    """owner, opening_cp, close_cp: openings of “ that stay open, with the end of their paragraph.

    An opening stays open if the balance of marks after it never falls below its own. It is suggested only if the first
    mark from the paragraph's end on is an opening, and something stands between.
    """
    # Marks and breaks, each with what stands before it by its length alone. What is left at the end is found once, not from each of its places.
    parts = F.regexp_extract_all("text", F.lit("[^“”\\n]*+(?:[“”\\n]|\\z)"), F.lit(0))
    found = F.transform(parts, lambda x: F.struct(F.length(x).alias("n"), F.substring(x, -1, 1).alias("what")))
    found = F.filter(found, lambda x: x["what"].isin("“", "”", "\n"))
    marks = texts.select(owner, F.posexplode(found).alias("k", "x"))
    step = F.when(F.col("x.what") == "“", 1).when(F.col("x.what") == "”", -1)
    order = Window.partitionBy(owner).orderBy("k")
    marks = marks.select(owner, "k", F.col("x.n").cast("long").alias("n"), step.alias("step"))
    marks = marks.withColumns({"at": F.sum("n").over(order) - 1, "depth": F.sum(F.coalesce("step", F.lit(0))).over(order)})
    # What follows is looked at from the end, so that every row is passed once.
    back = Window.partitionBy(owner).orderBy(F.desc("k"))
    later = back.rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumns({"low": F.min(F.when(F.col("step").isNotNull(), F.col("depth"))).over(later), "next": F.last("step", True).over(later)})
    end = F.last(F.when(F.col("step").isNull(), F.struct("at", "next")), True).over(later)
    out = marks.withColumn("end", end).filter("step = 1 AND (low IS NULL OR low >= depth) AND end.next = 1 AND end.at > at + 1")
    return out.select(owner, F.col("at").alias("opening_cp"), F.col("end.at").alias("close_cp"))


_PART, _MAY = re.compile(SENTENCE.replace("$", r"\Z")), re.compile(f"[{MARKS}{''.join(sorted({c[0] for c in CUES}))}]")
_SAYS = re.compile("|".join([f"[{MARKS}]", *CUES]))


def _spans(text: str | None, threshold: int, most: float) -> list[dict]:
    """What compressed() gives of one text, in one pass over its sentences."""
    parts = _PART.findall(text) if text is not None and len(text) > threshold else []
    if len(parts) < 3:
        return []
    hit = [_MAY.search(s) is not None and _SAYS.search(s) is not None for s in parts]
    hit[0] = hit[-1] = True
    kept = [x or y or z for x, y, z in zip([False, *hit], hit, [*hit[1:], False], strict=False)]
    if sum(len(s) for s, k in zip(parts, kept, strict=True) if k) > len(text) * most:
        return []
    out, at = [], 0
    for s, k in zip(parts, kept, strict=True):
        if k and out and out[-1]["kept"]:
            out[-1]["end_cp"] = at + len(s)
        else:
            out.append({"kept": k, "start_cp": at, "end_cp": at + len(s)})
        at += len(s)
    return out


def _spanned(texts: DataFrame, threshold: int, most: float) -> DataFrame:
    """texts with spans, an array, instead of text: worked out text by text, so that nothing is sorted or moved."""
    keep = [c for c in texts.columns if c != "text"]
    kinds = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep)
    make = lambda f: f[keep].assign(spans=[_spans(x, threshold, most) for x in f["text"]])
    return mapped(texts.select(*keep, "text"), make, f"{kinds}, spans array<struct<kept: boolean, start_cp: bigint, end_cp: bigint>>")


def compressed(texts: DataFrame, owner: str, threshold: int = 80, most: float = 0.6) -> DataFrame:
    """owner, kept, start_cp, end_cp: the runs of sentences that stay of long texts, and each sentence that goes.

    Sentences with a cue, the first and the last stay, with a neighbour on each side. Nothing is dropped of short
    texts, of texts with fewer than three sentences, and where more than a share of the text would stay: these give no rows.
    """
    return _spanned(texts.select(owner, "text"), threshold, most).select(owner, F.inline("spans"))


def loss(texts: DataFrame, owner: str, threshold: int = 80, most: float = 0.6) -> DataFrame:
    """owner, compressed, dropped_spans, dropped_cp, violations for texts with must_keep, an array of ranges (a, b)."""
    gone = _spanned(texts.select(owner, "must_keep", "text"), threshold, most).select(owner, "must_keep", F.filter("spans", lambda x: ~x["kept"]).alias("gone"))
    bad = F.filter("gone", lambda x: F.exists("must_keep", lambda r: (x["start_cp"] < r["b"]) & (x["end_cp"] > r["a"])))
    dropped = F.aggregate("gone", F.lit(0).cast("long"), lambda n, x: n + x["end_cp"] - x["start_cp"])
    long = lambda c, name: c.cast("long").alias(name)
    return gone.select(owner, long(F.size("gone") > 0, "compressed"), long(F.size("gone"), "dropped_spans"), long(dropped, "dropped_cp"), long(F.coalesce(F.size(bad), F.lit(0)), "violations"))


#: A line that separates scenes (fixed value).
SEPARATOR = r"^(?:\*{3,}|(?:\*\s+){2,}\*|[＊◇◆☆★※]{3,})$"


def source_units(texts: DataFrame, quotes: DataFrame, budget: int) -> DataFrame:
    """book, start_cp, end_cp: whole texts, and those over budget cut after lines that separate scenes, but not in quotes.

    texts: book, text; quotes: book, start_cp, end_cp.
    """
    over = texts.filter(estimated_tokens(F.col("text")) > budget)
    lines_ = split_lines(over).filter(stripped(F.col("body")).rlike(SEPARATOR)).select("book", F.col("end_cp").alias("at"))
    length = F.length("text").cast("long")
    q = quotes.select("book", F.col("start_cp").alias("r_start"), F.col("end_cp").alias("r_end"))
    inside = intervals.containing(lines_, q).filter("at > r_start").select("book", "at").distinct()
    cuts = lines_.join(inside, ["book", "at"], "left_anti").join(texts.select("book", length.alias("_n")), "book").filter("at < _n").drop("_n")
    ends = texts.select("book", F.explode(F.array(F.lit(0).cast("long"), length)).alias("at"))
    w = Window.partitionBy("book").orderBy("at")
    return cuts.unionByName(ends).distinct().select("book", F.col("at").alias("start_cp"), F.lead("at").over(w).alias("end_cp")).filter("end_cp IS NOT NULL")


def fragments(quotes: DataFrame, lengths: DataFrame) -> DataFrame:
    """book, kind, start_cp, end_cp: a text (book, length) as its outer quotes and what lies before, between and after."""
    w = Window.partitionBy("book").orderBy("start_cp")
    q = quotes.filter("depth = 0").select("book", "start_cp", "end_cp")
    cursor = F.coalesce(F.lag("end_cp").over(w), F.lit(0).cast("long"))
    before = q.select("book", F.when(cursor == 0, "outer_gap").otherwise("inner_gap").alias("kind"), cursor.alias("a"), F.col("start_cp").alias("b"))
    last = lengths.join(q.groupBy("book").agg(F.max("end_cp").alias("e")), "book", "left").select("book", F.lit("outer_gap").alias("kind"), F.coalesce("e", F.lit(0).cast("long")).alias("a"), F.col("length").alias("b"))
    gaps = before.unionByName(last).filter("a < b").select("book", "kind", F.col("a").alias("start_cp"), F.col("b").alias("end_cp"))
    return gaps.unionByName(q.select("book", F.lit("target_quote").alias("kind"), "start_cp", "end_cp"))
