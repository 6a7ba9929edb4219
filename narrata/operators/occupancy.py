"""Which requests for work on a book's quotes are free to start, and which meet work that is under way.

requests: request, own (a job that doesn't count, or null), and as jobs. jobs: book, job, kind, state, start_cp, end_cp,
selected (windows that were chosen; null: none were, so the range counts), chapter. windows: job, win, quote_id; windows
that are stored. planned: job, win, quote_id; windows that a plan of a job or request would have. quotes: book, quote_id,
start_cp, depth. lengths: book, length_cp. Targets of windows lie within the range of their job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.operators import intervals

#: States of work under way, kinds that work on quotes, and the kind that works on a chapter's people (fixed values).
ACTIVE = ["QUEUED", "RUNNING", "PAUSING", "NEEDS_RECONCILIATION"]
ON_QUOTES, ON_PEOPLE = ["INFERENCE", "RECHECK", "RECOMPUTE"], "CHARACTER_ROSTER"


def bounds(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """rows with r_start, r_end: their ranges; a damaged range is the whole book, so that it frees nothing."""
    x = rows.join(lengths.groupBy("book").agg(F.max("length_cp").alias("_length")), "book", "left")
    start, end = F.coalesce("start_cp", F.lit(0)), F.coalesce("end_cp", "_length")
    good = F.coalesce((start >= 0) & (start <= end), F.lit(False))
    return x.withColumns({"r_start": F.when(good, start).otherwise(0).cast("long"), "r_end": F.when(good, end).otherwise(F.col("_length")).cast("long")}).drop("_length")


def resolved(rows: DataFrame, key: str, windows: DataFrame, planned: DataFrame, quotes: DataFrame, lengths: DataFrame) -> DataFrame:
    """key, book, quote_id: the quotes that each row of rows is about.

    Those of the chosen windows, if all of these are stored or planned; else those of the stored ones, and all outermost
    quotes that begin within the range. Nothing if no window was chosen of a list; the range if a window has no name.
    """
    x = bounds(rows, lengths)
    nameless = F.exists("selected", lambda s: s.isNull())
    chosen = x.filter(F.col("selected").isNotNull() & ~nameless).select(key, "book", F.explode(F.array_distinct("selected")).alias("win"))
    there = lambda t, name: t.filter("quote_id IS NOT NULL").select(F.col("job").alias(key), "win", F.lit(True).alias(name)).distinct()
    known = chosen.join(there(windows, "_stored"), [key, "win"], "left").join(there(planned, "_planned"), [key, "win"], "left")
    known = known.withColumns({"_stored": F.coalesce("_stored", F.lit(False)), "_planned": F.coalesce("_planned", F.lit(False))})
    lost = known.groupBy(key).agg(F.max(~F.col("_stored") & ~F.col("_planned")).alias("_lost"))
    of = lambda rows, t: rows.select(key, "book", "win").join(t.select(F.col("job").alias(key), "win", "quote_id").filter("quote_id IS NOT NULL"), [key, "win"]).select(key, "book", "quote_id")
    by_plan = known.filter("_planned AND NOT _stored").join(lost.filter("NOT _lost"), key, "left_semi")
    wide = x.join(lost, key, "left").filter(F.col("selected").isNull() | nameless | F.coalesce("_lost", F.lit(False))).select(key, "book", "r_start", "r_end").filter("r_start < r_end")
    points = quotes.filter("depth = 0").select("book", "quote_id", F.col("start_cp").alias("at"))
    within = intervals.containing(points, wide).select(key, "book", "quote_id")
    return of(known.filter("_stored"), windows).unionByName(of(by_plan, planned)).unionByName(within).distinct()


def _two(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The two least jobs of each key: enough to find one that isn't a request's own."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("job"))).filter("_n <= 2").select(*keys, "job")


def _least(met: DataFrame) -> DataFrame:
    other: Column = ~F.col("own").eqNullSafe(F.col("job"))
    return met.filter(other).groupBy("request").agg(F.min("job").alias("met"))


def admitted(requests: DataFrame, jobs: DataFrame, windows: DataFrame, planned: DataFrame, quotes: DataFrame, lengths: DataFrame) -> DataFrame:
    """request, met: the least job under way that each request meets; null for those that are free.

    Work on quotes meets other work on the same quote of the book, work on people that on the same chapter. Each quote
    keeps its two least jobs only, so jobs are never paired, however many share a book.
    """
    active = jobs.filter(F.col("state").isin(ACTIVE))
    on = lambda rows: rows.filter(F.col("kind").isin(ON_QUOTES))
    taken = _two(resolved(on(active), "job", windows, planned, quotes, lengths), ["book", "quote_id"])
    asked = resolved(on(requests), "request", windows.unionByName(_as_requests(on(requests), windows)), planned.unionByName(_as_requests(on(requests), planned)), quotes, lengths)
    met = asked.join(taken, ["book", "quote_id"]).join(requests.select("request", "own"), "request")
    place = lambda rows, *more: rows.filter(F.col("kind") == ON_PEOPLE).select(*more, "book", F.coalesce(F.concat(F.lit("c"), F.col("chapter").cast("string")), F.lit("")).alias("_chapter"))
    people = place(requests, "request", "own").join(_two(place(active, "job"), ["book", "_chapter"]), ["book", "_chapter"])
    cols = ["request", "own", "job"]
    return requests.select("request").join(_least(met.select(cols).unionByName(people.select(cols))), "request", "left")


def _as_requests(requests: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows of the jobs that requests continue, as the requests' own."""
    x = windows.join(requests.select("request", F.col("own").alias("job")).filter("job IS NOT NULL"), "job")
    return x.select(F.col("request").alias("job"), "win", "quote_id")
