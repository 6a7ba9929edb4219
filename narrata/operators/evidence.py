"""An index of where people are named, and the candidates that it gives for a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of facts that are names; margin around a task, most candidates (fixed values).
NAMING = ["name", "alias", "designation"]
MARGIN, CANDIDATES = 500, 8


def postings(facts: DataFrame, lines: DataFrame) -> DataFrame:
    """book, person, value, visible_from_cp, start_cp, end_cp: the lines that hold a name.

    facts: book, person, kind, value, visible_from_cp; lines: book, start_cp, end_cp, line. A line meets the names of
    its book by the first two code points of these, so that names and lines aren't all compared: of the beginnings that
    a book has, those that the line holds are opened. Lines are moved once and never copied; what goes on is the
    names that they hold.
    """
    names = facts.filter(F.col("kind").isin(NAMING) & (F.trim("value") != "")).select("book", "person", "value", "visible_from_cp").distinct()
    begun = names.groupBy("book", F.substring("value", 1, 2).alias("gram")).agg(F.collect_set("value").alias("values"))
    begun = begun.groupBy("book").agg(F.collect_list(F.struct("gram", "values")).alias("_begun"))
    opened = F.flatten(F.transform(F.filter("_begun", lambda b: F.contains("line", b["gram"])), lambda b: b["values"]))
    held = lines.join(begun, "book").select("book", "start_cp", "end_cp", F.explode(F.filter(opened, lambda v: F.contains("line", v))).alias("value"))
    return held.join(names, ["book", "value"]).select("book", "person", "value", "visible_from_cp", "start_cp", "end_cp")


def _nearest(tasks: DataFrame, names: DataFrame, index: DataFrame) -> DataFrame:
    """book, task, person, distance: the least distance from a task's first position to a line that it may see.

    Lines of a name and tasks are sorted together: of the lines before a task the last two are looked at, since the
    last may go on beyond what is visible, and of those after it the first.
    """
    keys = ["book", "person", "value", "visible_from_cp"]
    asks = tasks.select("book", "task", "first", "limit").join(names.select(*keys).distinct(), "book").filter("visible_from_cp <= limit")
    line = F.struct(F.col("start_cp").alias("a"), F.col("end_cp").alias("b"))
    points = index.select(*keys, F.col("start_cp").alias("_at"), F.lit(0).alias("_asks"), line.alias("_line"), F.lit(None).cast(tasks.schema["task"].dataType).alias("task"), F.lit(None).cast("long").alias("limit")).distinct()
    none = F.lit(None).cast("struct<a: bigint, b: bigint>")
    both = points.unionByName(asks.select(*keys, F.col("first").alias("_at"), F.lit(1).alias("_asks"), none.alias("_line"), "task", "limit"))
    w = Window.partitionBy(*keys).orderBy("_at", "_asks")
    last = F.last("_line", True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.last("_before", True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("_line", True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    lag = F.last("_line", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    seen = both.withColumn("_before", F.when(F.col("_asks") == 0, lag)).withColumns({"_last": last, "_prior": before, "_after": after}).filter("_asks = 1")
    far = lambda c: F.when(F.col(f"{c}.b") <= F.col("limit"), F.abs(F.col(f"{c}.a") - F.col("_at")))
    return seen.groupBy("book", "task", "person").agg(F.min(F.least(far("_last"), far("_prior"), far("_after"))).alias("distance"))


def candidates(tasks: DataFrame, facts: DataFrame, lines: DataFrame, margin: int = MARGIN, most: int = CANDIDATES) -> DataFrame:
    """book, task, rank, person, name, pinned, local, distance: the people that a task offers, the likeliest first.

    tasks: book, task, first, last (where its quotes begin and end), horizon (null: all may be seen), pinned (people
    that stay in any case). Pinned people come first, then those whom more lines around the task name, then those who
    are named nearest; ties by person. Beyond `most`, only pinned people stay. A person without a visible name or
    designation is no candidate; the name is the one that became visible last. distance: the text's length where no line names a person.
    """
    length = lines.groupBy("book").agg(F.max("end_cp").alias("_n"))
    t = tasks.join(length, "book").withColumn("limit", F.least(F.coalesce("horizon", "_n"), F.col("_n")))
    t = t.withColumns({"_from": F.greatest(F.lit(0), F.col("first") - margin), "_to": F.least(F.col("limit"), F.col("last") + margin)})
    index = postings(facts, lines)
    cell = max(1, 4 * margin)
    cut = t.select("book", "task", "limit", "_from", "_to", F.explode(F.sequence(F.floor(F.col("_from") / cell), F.floor(F.col("_to") / cell))).alias("_cell"))
    near = index.withColumn("_cell", F.floor(F.col("start_cp") / cell)).join(cut, ["book", "_cell"]).filter("start_cp >= _from AND start_cp < _to AND end_cp <= limit AND visible_from_cp <= limit")
    local = near.select("book", "task", "person", "start_cp").distinct().groupBy("book", "task", "person").agg(F.count(F.lit(1)).alias("local"))
    named = facts.filter(F.col("kind").isin("name", "designation")).select("book", "person", "kind", "value", "visible_from_cp")
    of = t.select("book", "task", "limit", "_n", "pinned").join(named, "book").filter("visible_from_cp <= limit")
    # A name goes before any designation; of equally late ones the first by value.
    best = F.max_by("value", F.struct((F.col("kind") == "name").alias("k"), "visible_from_cp", (-F.xxhash64("value")).alias("h")))
    of = of.groupBy("book", "task", "person").agg(best.alias("name"), F.first("_n").alias("_n"), F.first("pinned").alias("_pinned"))
    distance = _nearest(t, facts.filter(F.col("kind").isin(NAMING)), index)
    r = of.join(local, ["book", "task", "person"], "left").join(distance, ["book", "task", "person"], "left")
    r = r.withColumns({"pinned": F.coalesce(F.array_contains("_pinned", F.col("person")), F.lit(False)), "local": F.coalesce("local", F.lit(0)), "distance": F.coalesce("distance", "_n")})
    w = Window.partitionBy("book", "task").orderBy(F.desc("pinned"), F.desc("local"), "distance", "person")
    return r.withColumn("rank", F.row_number().over(w)).filter(F.col("pinned") | (F.col("rank") <= most)).select("book", "task", "rank", "person", "name", "pinned", "local", "distance")
