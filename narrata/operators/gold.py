"""What in a gold standard refers to nothing, contradicts itself or lies outside its text.

books: book, length_cp (null: unknown). scenes: book, i, scene_id, start_cp, end_cp, participants (labels). quotes: book,
i, quote_id, start_cp, end_cp, scene_id, group_id, resolvable, kind, fragments (start_cp, end_cp), evidence (start_cp,
end_cp, visible_from_cp), body (the text within the range; null where that is not known). gaps: book, i, gap_id,
left_quote_id, right_quote_id, must_keep (start_cp, end_cp). i numbers what is said in order.

Where ids repeat, the last row with an id is what others refer to. A null place is before the text, a null id is no id
that exists, a null array is empty. Books that aren't in books have no known length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.operators.text import PAIRS

#: Kinds of quotes that stand between marks, and issues that are warnings only (fixed values).
MARKED = ["speech", "thought", "quotation"]
WARNINGS = ["visible_before_evidence", "must_keep_outside_gap", "quote_not_delimited"]


def _place(c: Column) -> Column:
    return F.coalesce(c, F.lit(-1))


def _within(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Whether a range that isn't empty lies within another one."""
    return (low <= _place(start)) & (_place(start) < _place(end)) & (_place(end) <= high)


def _each(items: str, wrong) -> Column:
    """How many items of an array are wrong."""
    return F.size(F.filter(F.coalesce(F.col(items), F.array()), lambda x: F.coalesce(wrong(x), F.lit(False))))


def _told(rows: DataFrame, target: str, found: dict[str, Column]) -> DataFrame:
    """A row for each code as often as it was found; counts are whole numbers or conditions."""
    counted = F.array(*[F.struct(F.lit(code).alias("code"), F.coalesce(n.cast("int"), F.lit(0)).alias("n")) for code, n in found.items()])
    out = rows.select("book", F.col(target).alias("target"), F.explode(F.filter(counted, lambda x: x["n"] > 0)).alias("x"))
    return out.select("book", F.when(F.col("x.code").isin(WARNINGS), "warning").otherwise("error").alias("level"), "x.code", "target", F.col("x.n").cast("long").alias("times"))


def _named(rows: DataFrame, key: str, **last: Column) -> DataFrame:
    """book and key of all rows, with the number of the first row (_first) and values of the last; a row for each id."""
    return rows.filter(F.col(key).isNotNull()).groupBy("book", key).agg(F.min("i").alias("_first"), *[F.max_by(c, "i").alias(name) for name, c in last.items()])


def reference_issues(books: DataFrame, scenes: DataFrame, quotes: DataFrame, gaps: DataFrame) -> DataFrame:
    """book, level, code, target, times: all issues; a code may come from several rows of the same id."""
    length = books.groupBy("book").agg(F.max("length_cp").alias("_length"))
    zero, outside = F.lit(0), lambda start, end: F.col("_length").isNotNull() & ~_within(start, end, F.lit(0), F.col("_length"))
    start, end, again = F.col("start_cp"), F.col("end_cp"), F.col("i") > F.col("_first")
    known = _named(scenes, "scene_id", _labels=F.coalesce(F.col("participants"), F.array().cast("array<string>")))
    s = scenes.join(length, "book", "left").join(known, ["book", "scene_id"], "left")
    found = [_told(s, "scene_id", {"duplicate_scene_id": again, "scene_range_out_of_bounds": outside(start, end)})]
    ranges = _named(quotes, "quote_id", _range=F.struct(_place(start).alias("start"), _place(end).alias("end")))
    q = quotes.join(length, "book", "left").join(ranges.drop("_range"), ["book", "quote_id"], "left").join(known.select("book", "scene_id", "_labels"), ["book", "scene_id"], "left")
    grouped, body = F.col("group_id").isNotNull(), F.col("body")
    marked = F.substring(body, 1, 1).isin(*PAIRS) & F.substring(body, -1, 1).isin(*PAIRS.values())
    found.append(_told(q, "quote_id", {
        "duplicate_quote_id": again, "quote_range_out_of_bounds": outside(start, end), "unknown_scene": F.col("_labels").isNull(),
        "resolvable_without_group": F.col("resolvable") & ~grouped, "unresolvable_with_group": ~F.col("resolvable") & grouped,
        "group_not_in_scene": grouped & ~F.coalesce(F.array_contains("_labels", F.col("group_id")), F.lit(False)),
        "fragment_out_of_quote": _each("fragments", lambda x: ~_within(x["start_cp"], x["end_cp"], _place(start), _place(end))),
        "evidence_range_out_of_bounds": _each("evidence", lambda x: outside(x["start_cp"], x["end_cp"])),
        "visible_before_evidence": _each("evidence", lambda x: F.coalesce(x["visible_from_cp"], zero) < _place(x["start_cp"])),
        "quote_not_delimited": F.col("kind").isin(MARKED) & (F.length(body) > 0) & (_place(start) >= 0) & (start < end) & ~marked,
    }))
    side = lambda name: ranges.select("book", F.col("quote_id").alias(f"{name}_quote_id"), F.col("_range").alias(f"_{name}"))
    g = gaps.join(_named(gaps, "gap_id"), ["book", "gap_id"], "left").join(side("left"), ["book", "left_quote_id"], "left").join(side("right"), ["book", "right_quote_id"], "left")
    lost = [(F.col(f"{x}_quote_id").isNotNull() & F.col(f"_{x}").isNull()).cast("int") for x in ("left", "right")]
    both = F.col("_left").isNotNull() & F.col("_right").isNotNull()
    kept = _each("must_keep", lambda x: ~_within(x["start_cp"], x["end_cp"], F.col("_left.end"), F.col("_right.start")))
    found.append(_told(g, "gap_id", {"duplicate_gap_id": again, "unknown_quote_in_gap": lost[0] + lost[1], "must_keep_outside_gap": F.when(both, kept)}))
    return reduce(DataFrame.unionByName, found).groupBy("book", "level", "code", "target").agg(F.sum("times").alias("times"))
