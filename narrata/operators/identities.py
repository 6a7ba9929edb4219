"""Groups of speakers over time: merges and splits as dated revisions, and what a reader sees who hasn't got so far.

A revision moves quotes from one group to another and may say what its new groups were before. A reader at a position
sees the revisions that become visible by then; of the others, the newest is taken back first. A move that is taken
back leads to a group that an older revision may have renamed in turn, so moves are followed from revision to revision:
each rename leads to the next older one of the group it came from. These ways are followed by jumps that double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.operators.graph import resolved, settled


def merged(groups: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(moves, survivors) of merges: merge, quote_id, old, new; and merge, survivor.

    groups: merge, group, first_cp (where the group first speaks; none if it never does), position (as listed): those that
    become one. The one that speaks first survives, or else the first listed. labels: quote_id, group.
    """
    order = F.struct(F.col("first_cp").isNull().alias("none"), "first_cp", "position")
    survivors = groups.groupBy("merge").agg(F.min_by("group", order).alias("survivor"))
    gone = groups.join(survivors, "merge").filter(F.col("group") != F.col("survivor"))
    moves = labels.join(gone.select("merge", "group", "survivor"), "group")
    return moves.select("merge", "quote_id", F.col("group").alias("old"), F.col("survivor").alias("new")), survivors


def split(buckets: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(moves, refused) of splits: split, quote_id, old, new; and split, reason.

    buckets: split, bucket, quote_id. Each bucket becomes a group of its own, named by split and bucket. All quotes of
    a split must be of one group; else it is refused as SPLIT_MIXED_GROUPS, or as NOT_IN_SCENE or NO_GROUP where a quote has
    no label or no group.
    """
    b = buckets.join(labels.select("quote_id", "group", F.lit(True).alias("_there")), "quote_id", "left")
    missing, bare, groups = F.count_if(F.col("_there").isNull()), F.count_if(F.col("_there") & F.col("group").isNull()), F.count_distinct("group")
    told = b.groupBy("split").agg(F.when(missing > 0, "NOT_IN_SCENE").when(bare > 0, "NO_GROUP").when(groups > 1, "SPLIT_MIXED_GROUPS").alias("reason"))
    refused = told.filter("reason IS NOT NULL")
    name = F.concat_ws("/", F.lit("split"), F.col("split").cast("string"), F.col("bucket").cast("string"))
    moves = b.join(refused, "split", "left_anti").select("split", "quote_id", F.col("group").alias("old"), name.alias("new"))
    return moves, refused


def _following(rows: DataFrame, renames: DataFrame) -> DataFrame:
    """rows (version, _id, at: a group, age, seq) with _next: the first rename of that group that is taken back later; or none."""
    asks = rows.select("version", F.col("at").alias("_group"), "age", "seq", F.lit(None).cast("string").alias("_edge"), F.col("_id").alias("_asker"))
    tells = renames.select("version", F.col("new").alias("_group"), "age", "seq", F.col("_id").alias("_edge"), F.lit(None).cast("string").alias("_asker"))
    w = Window.partitionBy("version", "_group").orderBy(F.desc("age"), F.desc("seq"), F.col("_asker").isNotNull().desc())
    seen = asks.unionByName(tells).withColumn("_next", F.last("_edge", True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return rows.join(seen.filter("_asker IS NOT NULL").select("version", F.col("_asker").alias("_id"), "_next"), ["version", "_id"], "left")


def reverted(moves: DataFrame, renames: DataFrame, horizon: Column) -> tuple[DataFrame, DataFrame]:
    """(quotes, groups): version, quote_id, group; and version, group, was: what a reader at horizon sees instead.

    moves: version, age, quote_id, old, visible_from_cp; renames: version, age, seq, new, old, visible_from_cp. age
    grows with the time since the revision was made, and each revision of a version has its own; seq orders a revision's
    renames. Only revisions that become visible beyond horizon are taken back. A quote has the group of the
    oldest of its moves, as renamed by revisions that are as old or older; a group was what its oldest rename says, as
    renamed by older ones. Moves from no group, and renames to the same name, count for nothing. A null horizon takes
    nothing back.
    """
    late = F.col("visible_from_cp") > horizon
    ident = lambda *c: F.concat_ws("|", *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in c])
    r = renames.filter(late & (F.coalesce("old", F.lit("")) != "") & (F.col("old") != F.col("new"))).select("version", "age", F.col("seq").cast("long").alias("seq"), "new", "old")
    r = settled(r.withColumn("_id", ident("version", "age", "seq", "new")))
    m = moves.filter(late & (F.coalesce("old", F.lit("")) != "")).groupBy("version", "quote_id").agg(F.max_by(F.struct("old", "age"), "age").alias("m"))
    m = m.select("version", "quote_id", F.col("m.old").alias("at"), F.col("m.age").alias("age"), F.lit(-1).cast("long").alias("seq")).withColumn("_id", ident("version", "quote_id"))
    onward = _following(r.withColumn("at", F.col("old")), r)
    ends = resolved(onward.filter("_next IS NOT NULL").select(F.col("_id").alias("node"), F.col("_next").alias("target")))
    last = onward.select("version", F.col("_id").alias("node")).join(ends, "node", "left").select("version", "node", F.coalesce("end", "node").alias("_id"))
    final = last.join(r.select("_id", F.col("old").alias("was")), "_id").select("node", "was")
    oldest = r.groupBy("version", "new").agg(F.max_by("_id", F.struct("age", "seq")).alias("node"))
    groups = oldest.join(final, "node").select("version", F.col("new").alias("group"), "was")
    led = _following(m, r).join(final, F.col("_next") == F.col("node"), "left")
    return led.select("version", "quote_id", F.coalesce("was", "at").alias("group")), groups
