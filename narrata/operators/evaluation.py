"""Predictions held against gold: matching by overlap, votes, intervals of confidence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.operators import intervals
from narrata.operators.graph import settled

#: Least overlap of a match, z of the interval, quotes that a target needs, and the targets (fixed values).
MATCH, Z, LEAST_QUOTES, ACCURACY, COVERAGE = 0.5, 1.96, 30, 0.97, 0.70


def ratio(a: Column, b: Column) -> Column:
    """a / b; null if b isn't positive."""
    return F.when(b > 0, a / b)


def f1(p: Column, r: Column) -> Column:
    """Null if either is null or zero."""
    return F.when((p > 0) & (r > 0), 2 * p * r / (p + r))


def wilson(hits: Column, total: Column) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, within 0 and 1; null without trials."""
    share, below = hits / total, 1 + Z * Z / total
    middle = (share + Z * Z / (2 * total)) / below
    margin = Z * F.sqrt(share * (1 - share) / total + Z * Z / (4 * total * total)) / below
    some = total > 0
    return F.when(some, F.greatest(F.lit(0.0), middle - margin)), F.when(some, F.least(F.lit(1.0), middle + margin))


def iou(a: str, b: str) -> Column:
    """Shared part of two half-open ranges (a_start, a_end), (b_start, b_end)."""
    s, e = (f"{a}_start", f"{b}_start"), (f"{a}_end", f"{b}_end")
    shared, union = F.least(*e) - F.greatest(*s), F.greatest(*e) - F.least(*s)
    return F.when((shared > 0) & (union > 0), shared / union).otherwise(0.0)


def one_to_one(edges: DataFrame, group: list[str], left: str, right: str, order: list[str]) -> DataFrame:
    """The edges that are taken when, in order, each is taken whose ends are both free; ends are told apart in a group.

    order: columns; the smallest comes first. An edge that is the first of both its ends is taken whatever the others
    do, so in each round all such edges are taken at once and those at their ends go; few rounds are left to do then.
    """
    ends = [*group, left], [*group, right]
    open_ = settled(edges.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).withColumn("_key", F.struct(*order, left, right)))
    taken = open_.limit(0)
    while True:
        first = open_
        for k, keys in enumerate(ends):
            first = first.join(open_.groupBy(*keys).agg(F.min("_key").alias(f"_first{k}")), keys)
        won = settled(first.filter((F.col("_key") == F.col("_first0")) & (F.col("_key") == F.col("_first1"))).select(*open_.columns).dropDuplicates([*group, left]))
        taken = taken.unionByName(won)
        for keys in ends:
            open_ = open_.join(won.select(*keys), keys, "left_anti")
        open_ = settled(open_)
        if open_.isEmpty():
            return taken.select(*edges.columns)


def matched(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """book, gold, pred, score: quotes matched one to one, the largest overlaps first."""
    g = gold.select("book", F.col("key").alias("gold"), F.col("start_cp").alias("l_start"), F.col("end_cp").alias("l_end"))
    p = pred.select("book", F.col("key").alias("pred"), F.col("start_cp").alias("r_start"), F.col("end_cp").alias("r_end"))
    pairs = intervals.overlapping(g, p).withColumn("score", iou("l", "r")).filter(F.col("score") >= MATCH)
    won = one_to_one(pairs.withColumn("worse", -F.col("score")), ["book"], "gold", "pred", ["worse", "l_start", "r_start"])
    return won.select("book", "gold", "pred", "score")


def with_acceptance(pred: DataFrame) -> DataFrame:
    """Adds accepted: what the flag says; without one, whether there is a group and the status allows it."""
    by_status = F.col("grp").isNotNull() & F.upper(F.coalesce("status", F.lit(""))).isin("", "ACCEPTED", "USER_CONFIRMED")
    return pred.withColumn("accepted", F.coalesce("flag", by_status))


def paired(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Every gold quote (book, gold, start, g_scene, g_grp, resolvable) with its match (pred, p_scene, p_grp, accepted)."""
    g = gold.select("book", F.col("key").alias("gold"), F.col("start_cp").alias("start"), F.col("end_cp").alias("end"), F.col("scene").alias("g_scene"), F.col("grp").alias("g_grp"), "resolvable")
    p = with_acceptance(pred).select("book", F.col("key").alias("pred"), F.col("scene").alias("p_scene"), F.col("grp").alias("p_grp"), "accepted")
    return g.join(matched(gold, pred).drop("score"), ["book", "gold"], "left").join(p, ["book", "pred"], "left")


def extraction(pairs: DataFrame, pred: DataFrame) -> DataFrame:
    """book, gold, predicted, matched, precision, recall, f1."""
    got = pairs.groupBy("book").agg(F.count(F.lit(1)).alias("gold"), F.count("pred").alias("matched"))
    all_ = got.join(pred.groupBy("book").agg(F.count(F.lit(1)).alias("predicted")), "book", "left").na.fill(0, ["predicted"])
    p, r = ratio(F.col("matched"), F.col("predicted")), ratio(F.col("matched"), F.col("gold"))
    return all_.withColumns({"precision": p, "recall": r}).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def scene_boundaries(pairs: DataFrame) -> DataFrame:
    """book, compared, wrong_split, wrong_join, accuracy over adjacent gold quotes that are both matched."""
    w = Window.partitionBy("book").orderBy("start", "end", "gold")
    nxt = pairs.withColumn("n", F.lead(F.struct("pred", "g_scene", "p_scene")).over(w)).filter("pred IS NOT NULL AND n.pred IS NOT NULL")
    same_g, same_p = F.col("g_scene").eqNullSafe(F.col("n.g_scene")), F.col("p_scene").eqNullSafe(F.col("n.p_scene"))
    out = nxt.groupBy("book").agg(F.count(F.lit(1)).alias("compared"), F.count_if(same_g & ~same_p).alias("wrong_split"), F.count_if(~same_g & same_p).alias("wrong_join"))
    return out.withColumn("accuracy", ratio(F.col("compared") - F.col("wrong_split") - F.col("wrong_join"), F.col("compared")))


def countable(pairs: DataFrame) -> DataFrame:
    """Matched and accepted quotes whose gold group is known, with their scene (- for none)."""
    return pairs.filter("pred IS NOT NULL AND resolvable AND g_grp IS NOT NULL AND accepted").withColumn("scene", F.coalesce("g_scene", F.lit("-")))


def cells(pairs: DataFrame) -> DataFrame:
    """book, scene, g_grp, p_grp, c: how many countable quotes of a scene have these groups."""
    return settled(countable(pairs).groupBy("book", "scene", "g_grp", "p_grp").agg(F.count(F.lit(1)).alias("c")))


def mapped(counts: DataFrame) -> DataFrame:
    """book, scene, g_grp, p_grp: the predicted group of each gold group of a scene, one to one, most votes first."""
    votes = counts.filter("p_grp IS NOT NULL").withColumn("fewer", -F.col("c"))
    return one_to_one(votes, ["book", "scene"], "g_grp", "p_grp", ["fewer"]).select("book", "scene", "g_grp", "p_grp")


def group_mapping(pairs: DataFrame) -> DataFrame:
    """As mapped(), from pairs."""
    return mapped(cells(pairs))


def accepted_accuracy(pairs: DataFrame) -> DataFrame:
    """book, accepted, correct, accuracy, low, high. A quote without a predicted group is right where its gold group has none."""
    counts = cells(pairs)
    mapping = mapped(counts).withColumnRenamed("p_grp", "mapped")
    both = counts.join(mapping, ["book", "scene", "g_grp"], "left")
    out = both.groupBy("book").agg(F.sum("c").alias("accepted"), F.sum(F.when(F.col("mapped").eqNullSafe(F.col("p_grp")), F.col("c")).otherwise(0)).alias("correct"))
    low, high = wilson(F.col("correct"), F.col("accepted"))
    return out.withColumns({"accuracy": ratio(F.col("correct"), F.col("accepted")), "low": low, "high": high})


def pairwise(pairs: DataFrame) -> DataFrame:
    """book, tp, fp, fn, f1 over the pairs of a scene's quotes, counted from the sizes of groups; no pair is made."""
    cell = countable(pairs).groupBy("book", "g_scene", "g_grp", "p_grp").agg(F.count(F.lit(1)).alias("c"))
    two = lambda name: F.sum(F.col("c") * (F.col("c") - 1) / 2).cast("long").alias(name)
    by = lambda *keys: cell.groupBy("book", "g_scene", *keys).agg(F.sum("c").alias("c")).groupBy("book")
    out = cell.groupBy("book").agg(two("tp")).join(by("p_grp").agg(two("p")), "book").join(by("g_grp").agg(two("g")), "book")
    out = out.select("book", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.withColumn("f1", f1(p, r))


def group_counts(pairs: DataFrame) -> DataFrame:
    """book, extra_groups, missing_groups: by how many predicted groups exceed, or lack, those of the gold scenes."""
    use = F.col("resolvable") & F.col("g_grp").isNotNull()
    seen = use & F.col("accepted")
    scenes = pairs.filter("g_scene IS NOT NULL").groupBy("book", "g_scene").agg(F.count_distinct(F.when(use, F.col("g_grp"))).alias("g"), F.count_distinct(F.when(seen, F.col("p_grp"))).alias("p"))
    more = F.col("p") - F.col("g")
    return scenes.groupBy("book").agg(F.sum(F.greatest(more, F.lit(0))).alias("extra_groups"), F.sum(F.greatest(-more, F.lit(0))).alias("missing_groups"))


def coverage(pairs: DataFrame) -> DataFrame:
    """book, coverage, refusal_rate, unknown_force_rate, sufficient, degenerate flags."""
    use = pairs.groupBy("book").agg(
        F.count(F.lit(1)).alias("gold"), F.count_if(F.col("accepted")).alias("covered"), F.count_if(~F.col("resolvable")).alias("hard"),
        F.count_if(~F.col("resolvable") & F.col("p_grp").isNotNull()).alias("forced"), F.count_if(F.col("resolvable")).alias("resolvable"),
    )
    return use.select(
        "book", ratio(F.col("covered"), F.col("gold")).alias("coverage"), ratio(F.col("gold") - F.col("covered"), F.col("gold")).alias("refusal_rate"),
        ratio(F.col("forced"), F.col("hard")).alias("unknown_force_rate"), (F.col("resolvable") >= LEAST_QUOTES).alias("sufficient"),
        (F.col("covered") == 0).alias("all_refusal"), ((F.col("hard") > 0) & (F.col("forced") == F.col("hard"))).alias("forced_all"),
    )


def bound_chapters(chapters: DataFrame, titles: DataFrame) -> DataFrame:
    """book, index, ordinal: chapters (book, ordinal, title) for the titles of a manifest (book, index, title).

    In order of the manifest, each entry takes the unused chapter of its title whose ordinal is nearest, else the unused
    one of its own index. A book's list is one task's work.
    """
    c = chapters.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("ordinal", F.trim(F.coalesce("title", F.lit(""))).alias("title")))).alias("chapters"))
    t = titles.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("index", F.trim(F.coalesce("title", F.lit(""))).alias("title")))).alias("titles"))

    def run(frames):
        for f in frames:
            rows = []
            for book, chapters, titles in zip(f["book"], f["chapters"], f["titles"], strict=True):
                unused = {x["ordinal"]: x["title"] for x in chapters}
                for x in titles:
                    named = [o for o, title in unused.items() if x["title"] and title == x["title"]]
                    pick = min(named, key=lambda o: abs(o - x["index"])) if named else x["index"] if x["index"] in unused else None
                    if pick is not None:
                        del unused[pick]
                        rows.append((book, x["index"], pick))
            yield pd.DataFrame(rows, columns=["book", "index", "ordinal"])

    return t.join(c, "book").mapInPandas(run, "book long, index long, ordinal long")


def restored_by_text(quotes: DataFrame, entries: DataFrame) -> DataFrame:
    """book, chapter, entry, quote_id (null: not found) for a manifest's entries (book, chapter, entry, text).

    Within a chapter (quotes: book, chapter, start_cp, quote_id, text) a pointer only goes forward: an entry takes the
    next quote with just its text; one that isn't found leaves the pointer where it was. A chapter is one task's work.
    """
    key = ["book", "chapter"]
    q = quotes.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start_cp", "quote_id", "text"))).alias("quotes"))
    e = entries.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("entry", "text"))).alias("entries"))

    def run(frames):
        for f in frames:
            rows = []
            for book, chapter, quotes, entries in zip(f["book"], f["chapter"], f["quotes"], f["entries"], strict=True):
                quotes = [] if quotes is None else list(quotes)
                at = 0
                for x in entries:
                    hit = next((k for k in range(at, len(quotes)) if x["text"] and quotes[k]["text"] == x["text"]), None)
                    rows.append((book, chapter, x["entry"], None if hit is None else quotes[hit]["quote_id"]))
                    at = at if hit is None else hit + 1
            yield pd.DataFrame(rows, columns=["book", "chapter", "entry", "quote_id"])

    return e.join(q, key, "left").mapInPandas(run, "book long, chapter long, entry long, quote_id string")
