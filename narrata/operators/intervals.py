"""Joins of ranges. Every one carries the owner as an equality key; long ranges are cut into cells of CELL code points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = 4096


def _cells(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(start / CELL), F.floor(F.greatest(end - 1, start) / CELL)))


def overlapping(left: DataFrame, right: DataFrame, owner: str = "book") -> DataFrame:
    """Pairs of non-empty ranges (l_start, l_end) and (r_start, r_end) of an owner that share a position.

    A pair is found in the cell where the later of both starts, so it comes once.
    """
    a = left.withColumn("_cell", _cells(F.col("l_start"), F.col("l_end")))
    b = right.withColumn("_cell", _cells(F.col("r_start"), F.col("r_end")))
    met = (F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end"))
    once = F.col("_cell") == F.floor(F.greatest("l_start", "r_start") / CELL)
    return a.join(b, [owner, "_cell"]).filter(met & once).drop("_cell")


def containing(points: DataFrame, ranges: DataFrame, owner: str = "book") -> DataFrame:
    """Points (at) with the ranges (r_start, r_end) that hold them."""
    a = points.withColumn("_cell", F.floor(F.col("at") / CELL))
    b = ranges.withColumn("_cell", _cells(F.col("r_start"), F.col("r_end")))
    return a.join(b, [owner, "_cell"]).filter("at >= r_start AND at < r_end").drop("_cell")


def gaps(quotes: DataFrame) -> DataFrame:
    """Ranges between adjacent quotes of a book that don't touch."""
    w = Window.partitionBy("book").orderBy("start_cp")
    nxt = quotes.select("book", F.col("quote_id").alias("left_id"), F.col("end_cp").alias("gap_start"), F.lead("start_cp").over(w).alias("gap_end"), F.lead("quote_id").over(w).alias("right_id"))
    return nxt.filter("gap_end > gap_start")


def latest_as_of(facts: DataFrame, horizons: DataFrame, keys: list[str], value: str) -> DataFrame:
    """For each horizon, the value with the largest visible_from_cp that isn't beyond it; of several there, the largest.

    Facts and horizons are sorted together, so a horizon isn't joined with all that lies before it. Horizons before
    any fact give no row.
    """
    f = facts.filter(F.col(value).isNotNull()).select(*keys, F.col("visible_from_cp").cast("long").alias("horizon"), F.lit(0).alias("_asks"), F.col(value))
    h = horizons.select(*keys, F.col("horizon").cast("long").alias("horizon"), F.lit(1).alias("_asks"), F.lit(None).cast(facts.schema[value].dataType).alias(value)).distinct()
    w = Window.partitionBy(*keys).orderBy("horizon", "_asks", value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = f.unionByName(h).withColumn(value, F.last(value, True).over(w))
    return seen.filter((F.col("_asks") == 1) & F.col(value).isNotNull()).drop("_asks")


def with_range_or_last(points: DataFrame, ranges: DataFrame, at: str, name: str, owner: str = "book") -> DataFrame:
    """points with the range (name, r_start, r_end) that holds at; where none does, the owner's last one."""
    last = ranges.groupBy(owner).agg(F.max(name).alias("_last"))
    held = containing(points.select(owner, F.col(at).alias("at")).distinct(), ranges, owner).select(owner, F.col("at").alias(at), name)
    out = points.join(held, [owner, at], "left").join(last, owner, "left")
    return out.withColumn(name, F.coalesce(name, "_last")).drop("_last")
