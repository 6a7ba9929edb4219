"""Windows of targets under token budgets: named policies, greedy packing, evidence around targets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.operators.graph import followed, settled


@dataclass(frozen=True)
class Policy:
    context_tokens: int = 2500
    overlap_tokens: int = 200
    state_tokens: int = 300
    gap_compression: bool = False
    recheck_max_targets: int = 0
    full_source: bool = False
    dialogue_blocks: bool = False
    dialogue_target_limit: int = 0


#: Policies by name (fixed values); any other name has the first one.
POLICIES = {
    "context-1": Policy(),
    "context-2": Policy(gap_compression=True, recheck_max_targets=3),
    "context-chapter-1": Policy(context_tokens=32000, full_source=True),
    "context-chapter-2": Policy(context_tokens=32000, full_source=True, dialogue_blocks=True),
    "context-chapter-3": Policy(context_tokens=32000, full_source=True, dialogue_blocks=True, dialogue_target_limit=128),
}


def policy(name: str | None) -> Policy:
    return POLICIES.get(name or "", POLICIES["context-1"])


#: Positions of a cell in which running sums are taken by themselves.
CELL = 1 << 16


def running(rows: DataFrame, at: str, sums: dict[str, Column], owner: str = "book") -> DataFrame:
    """Adds _i (the number of each row of an owner by position, from 0) and running sums, the row's own included.

    Rows are counted and summed by cells of positions, and cells by owner, so that no task holds an owner's rows.
    """
    cut = rows.withColumn("_cell", F.floor(F.col(at) / CELL))
    all_ = {"_i": F.lit(1).cast("long")} | sums
    totals = cut.groupBy(owner, "_cell").agg(*[F.sum(c).alias(n) for n, c in all_.items()])
    before = Window.partitionBy(owner).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(owner, "_cell", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_base{n}") for n in all_])
    own = Window.partitionBy(owner, "_cell").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = cut.withColumns({f"_own{n}": F.sum(c).over(own) for n, c in all_.items()}).join(base, [owner, "_cell"])
    t = t.withColumns({n: (F.col(f"_own{n}") + F.col(f"_base{n}")).cast("long") for n in all_})
    return t.withColumn("_i", F.col("_i") - 1).drop("_cell", *[f"{x}{n}" for n in all_ for x in ("_own", "_base")])


def last_within(rows: DataFrame, total: str, reach: Column, most: int, out: str, owner: str = "book") -> DataFrame:
    """Adds out: the largest _i of the owner whose total isn't over reach; none where the row's own total is.

    rows: owner, _i, and total, which never falls. reach is at most `most` beyond the row's own total, so what is
    sought is in the reach's cell or the one before it: rows and reaches are sorted together by cell.
    """
    width = max(1, most)
    asked = F.when(reach >= F.col(total), reach)
    points = rows.select(owner, F.col(total).alias("_v"), F.lit(0).alias("_asks"), F.col("_i").alias("_p"), F.lit(None).cast("long").alias("_q"))
    queries = rows.select(owner, asked.alias("_v"), F.lit(1).alias("_asks"), F.lit(None).cast("long").alias("_p"), F.col("_i").alias("_q")).filter("_v IS NOT NULL")
    both = points.unionByName(queries).withColumn("_c", F.floor(F.col("_v") / width))
    w = Window.partitionBy(owner, "_c").orderBy("_v", "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_p", F.max("_p").over(w)).filter("_asks = 1")
    tops = points.groupBy(owner, (F.floor(F.col("_v") / width) + 1).alias("_c")).agg(F.max("_p").alias("_top"))
    found = seen.join(tops, [owner, "_c"], "left").select(owner, F.col("_q").alias("_i"), F.coalesce("_p", "_top").alias(out))
    return rows.join(found, [owner, "_i"], "left")


def numbered_from(rows: DataFrame, starts: DataFrame, out: str, owner: str = "book") -> DataFrame:
    """Adds out: how many of the starts (owner, at: numbers _i) aren't beyond a row, less one."""
    marked = rows.join(starts.select(owner, F.col("at").alias("_i"), F.lit(1).alias("_starts")), [owner, "_i"], "left")
    counted = running(marked, "_i", {"_n": F.coalesce("_starts", F.lit(0))}, owner)
    return counted.withColumn(out, F.col("_n") - 1).drop("_n", "_starts")


def packed(targets: DataFrame, budget: int, most: int = 0) -> DataFrame:
    """Adds window and oversized to targets (book, start_cp, tokens, gap_before: tokens of the narration before).

    Each window takes targets in order while its quotes, and the narration between its first and last, fit the budget;
    a target that alone doesn't fit has a window of its own. most: targets of a window at most, 0 for any number.
    Where a window ends that begins at a target follows from running sums, for all targets at once; which targets begin one,
    from following these ends from the first.
    """
    whole = (F.col("tokens") + F.col("gap_before")).cast("long")
    t = settled(running(targets, "start_cp", {"_sum": whole}))
    # What the window's first target may add to: its own sum without its gap, less its tokens, and the budget.
    t = last_within(t, "_sum", F.lit(budget) + F.col("_sum") - F.col("tokens"), budget, "_last")
    end = F.greatest(F.coalesce("_last", F.col("_i")), F.col("_i")) + 1
    next_ = F.least(end, F.col("_i") + most) if most else end
    starts = followed(t.select("book", F.col("_i").alias("at"), next_.alias("next")))
    out = numbered_from(t.drop("_last"), starts, "window").withColumn("oversized", F.col("tokens") > budget)
    return out.select(*targets.columns, "window", "oversized")


def overlap(windows: DataFrame, paragraphs: DataFrame, limit: int) -> DataFrame:
    """book, window, start_cp: how far back whole paragraphs before a window reach within limit tokens, one at least.

    windows: book, window, at (its start); paragraphs: book, p_start, p_end, tokens.
    """
    p = running(paragraphs.withColumn("tokens", F.col("tokens").cast("long")), "p_start", {"_sum": F.col("tokens")})
    p = settled(p.withColumn("_before", F.col("_sum") - F.col("tokens")).select("book", "_i", "p_start", "p_end", "_sum", "_before"))
    # From which paragraph on the limit is kept up to each one: the first whose sum of what lies before it is large enough.
    width = limit + 1
    points = p.select("book", F.col("_before").alias("_v"), F.lit(1).alias("_asks"), F.col("_i").alias("_p"), F.lit(None).cast("long").alias("_q"))
    asks = p.select("book", (F.col("_sum") - limit).alias("_v"), F.lit(0).alias("_asks"), F.lit(None).cast("long").alias("_p"), F.col("_i").alias("_q"))
    both = points.unionByName(asks).withColumn("_c", F.floor(F.col("_v") / width))
    later = Window.partitionBy("book", "_c").orderBy("_v", "_asks").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    seen = both.withColumn("_p", F.min("_p").over(later)).filter("_asks = 0")
    firsts = points.groupBy("book", (F.floor(F.col("_v") / width) - 1).alias("_c")).agg(F.min("_p").alias("_low"))
    reach = seen.join(firsts, ["book", "_c"], "left").select("book", F.col("_q").alias("_i"), F.coalesce("_p", "_low").alias("_k"))
    from_ = p.join(reach, ["book", "_i"], "left").select("book", "p_end", F.least(F.coalesce("_k", F.col("_i")), F.col("_i")).alias("_i"))
    starts = from_.join(p.select("book", "_i", "p_start"), ["book", "_i"]).select("book", "p_end", "p_start")
    # The last paragraph that ends by then: windows and paragraphs are sorted together.
    ends = starts.select("book", F.col("p_end").alias("at"), F.lit(0).alias("_asks"), F.col("p_start").alias("start_cp"), F.lit(None).cast("long").alias("window"))
    every = ends.unionByName(windows.select("book", "at", F.lit(1).alias("_asks"), F.lit(None).cast("long").alias("start_cp"), "window"))
    last = F.last("start_cp", True).over(Window.partitionBy("book").orderBy("at", "_asks", "start_cp").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return every.withColumn("start_cp", last).filter("_asks = 1 AND start_cp IS NOT NULL").select("book", "window", "start_cp")


def evidence(items: DataFrame, budget: int, horizon: int) -> DataFrame:
    """window, item, outcome for a window's items (window, item, rank, start_cp, end_cp, cost, required).

    In order of rank and position: required items are taken, even beyond the budget, but for one that alone is over it;
    optional ones if they end within the horizon and still fit, else they are passed over. A window's items are few.
    """
    rows = F.array_sort(F.collect_list(F.struct("rank", "start_cp", "item", "cost", "required", (F.col("end_cp") > horizon).alias("late"))))
    kind = "array<struct<item:" + items.schema["item"].dataType.simpleString() + ",outcome:string>>"

    def take(state, x):
        fits = state["used"] + x["cost"] <= budget
        outcome = F.when(x["required"], F.when(x["cost"] > budget, "oversized_quote").otherwise("required")).when(x["late"], "beyond_visible_horizon").when(fits, "optional").otherwise("budget_exhausted")
        taken = outcome.isin("required", "optional")
        return F.struct((state["used"] + F.when(taken, x["cost"]).otherwise(0)).alias("used"), F.concat(state["told"], F.array(F.struct(x["item"].alias("item"), outcome.alias("outcome")))).alias("told"))

    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(kind).alias("told"))
    told = items.groupBy("window").agg(rows.alias("_r")).select("window", F.explode(F.aggregate("_r", start, take)["told"]).alias("x"))
    return told.select("window", "x.item", "x.outcome")


def dialogue_units(paragraphs: DataFrame, budget: int, most: int = 0) -> DataFrame:
    """book, unit, first, last, tokens, before, fits: paragraphs (book, line, tokens, has_quote, explicit) in units.

    Paragraphs with quotes that follow one another are one block, unless a separator (explicit) begins there. A unit
    takes blocks while they, and the paragraph before the unit that it repeats (before), stay within budget, and not
    more than `most` quotes (0: any number); it never goes beyond a separator. A block that alone is over budget is a
    unit that doesn't fit. Ends of units come from running sums, as those of windows do.
    """
    w = Window.partitionBy("book").orderBy("line")
    joins = F.col("has_quote") & F.coalesce(F.lag("has_quote").over(w), F.lit(False)) & ~F.col("explicit")
    p = paragraphs.withColumns({"_new": (~joins).cast("int"), "_before": F.coalesce(F.lag("tokens").over(w), F.lit(0))})
    p = p.withColumn("_block", F.sum("_new").over(w))
    head = F.min(F.struct("line", "_before", "explicit"))
    blocks = p.groupBy("book", "_block").agg(head.alias("h"), F.max("line").alias("last"), F.sum("tokens").alias("tokens"), F.sum(F.col("has_quote").cast("long")).alias("quotes"))
    blocks = blocks.select("book", F.col("h.line").alias("first"), "last", "tokens", "quotes", F.col("h._before").cast("long").alias("before"), F.col("h.explicit").alias("explicit"))

    b = settled(running(blocks.withColumn("_quotes", F.col("quotes")), "first", {"_sum": F.col("tokens"), "_many": F.col("_quotes"), "_part": F.col("explicit").cast("long")}))
    b = last_within(b, "_sum", F.lit(budget) - F.col("before") + F.col("_sum") - F.col("tokens"), budget, "_fit")
    if most:
        b = last_within(b, "_many", F.lit(most) + F.col("_many") - F.col("quotes"), most, "_count")
    # A unit ends before the next separator: with the last block of its part.
    b = b.join(b.groupBy("book", "_part").agg(F.max("_i").alias("_end")), ["book", "_part"])
    ends = [F.coalesce("_fit", F.col("_i")), F.col("_end"), *([F.coalesce("_count", F.col("_i"))] if most else [])]
    next_ = F.greatest(F.least(*ends), F.col("_i")) + 1
    starts = followed(b.select("book", F.col("_i").alias("at"), next_.alias("next")))
    u = numbered_from(b, starts, "unit").groupBy("book", "unit").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("tokens").cast("long").alias("tokens"), F.min_by("before", "_i").alias("before")
    )
    return u.withColumn("fits", F.col("tokens") + F.col("before") <= budget)
