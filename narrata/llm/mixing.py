"""Mixing sources to target weights by Pfair scheduling.

Every source's rows are dealt into blocks. With target weight a/Q (a whole number of the Q slots of a frame), block k
of a source may run from slot floor(k*Q/a) on and must run before slot ceil((k+1)*Q/a). In every slot, of the blocks
that may run, the one with the earliest deadline runs. As the weights sum to 1, no deadline is missed, so after t
slots every source has had more than t*a/Q - 1 and fewer than t*a/Q + 1 blocks. The pattern repeats each frame, so it
is computed once for Q slots, whatever the size of the corpus, and every block finds its slot by arithmetic.

When a source has no blocks left, its slots fall out and the others go on in their proportions.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.llm.common import let, running_totals, shuffle_partitions, unused

#: Slots of a frame, at least; weights are rounded to this grain.
FRAME = 1000
#: Sources a mix may have. Their weights are the only thing that the driver sees.
MAX_SOURCES = 10_000


def whole_shares(weights: Mapping[str, float], frame: int = FRAME) -> tuple[dict[str, int], int]:
    """Slots of each source in a frame, one at least, by largest remainders; and the frame's size."""
    weights = {s: float(w) for s, w in weights.items() if w and w > 0}
    frame = max(frame, 4 * len(weights))
    total = sum(weights.values())
    exact = {s: w / total * (frame - len(weights)) for s, w in weights.items()}
    out = {s: 1 + math.floor(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (math.floor(exact[s]) - exact[s], s))[: frame - sum(out.values())]:
        out[s] += 1
    return out, frame


def frame_plan(docs: DataFrame, shares: Mapping[str, int], frame: int) -> DataFrame:
    """(source, k, at): in which slot of a frame the source's k-th block runs.

    A fold over the slots of one frame, by earliest deadline among the released blocks; ties go to the source first
    in order of name. It keeps how many blocks each source has had, and the source of each slot.
    """
    spark = docs.sparkSession
    one = spark.createDataFrame([(sorted(shares), [int(shares[s]) for s in sorted(shares)])], "names array<string>, a array<int>")
    q = F.lit(frame)

    def pick(state: Column, t: Column) -> Column:
        def due(a: Column, i: Column) -> Column:
            k = state["had"][i]
            released = (k < a) & (F.floor(k * q / a) <= t)
            return F.struct(F.when(released, F.ceil((k + 1) * q / a)).otherwise(F.lit(1 << 40)).alias("deadline"), i.alias("i"))

        return let(F.array_min(F.transform("a", due))["i"], lambda c: F.struct(
            F.transform(state["had"], lambda n, i: n + F.when(i == c, 1).otherwise(0)).alias("had"), F.array_append(state["log"], c).alias("log"),
        ))

    start = F.struct(F.transform("a", lambda x: F.lit(0)).alias("had"), F.array().cast("array<int>").alias("log"))
    folded = F.aggregate(F.sequence(F.lit(0), q - 1), start, pick, lambda s: s["log"])
    slots = one.select("names", F.posexplode(folded).alias("at", "i")).select(F.col("names")[F.col("i")].alias("source"), "at")
    return slots.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("at")) - 1)


def numbered(rows: DataFrame, group: str, key: Column, out: str, at: Column | None = None, top: int = 0) -> DataFrame:
    """rows with a number from 0 within each group, in an order that depends on key alone.

    at: whole numbers from 0 to top that decide the order before key does. Groups are cut into pieces by ranges of at, or
    else by a hash of key, numbered by piece, and shifted by the sizes of the pieces before, so
    that no task holds a whole group. group has no nulls.
    """
    pieces = 16 * shuffle_partitions(rows.sparkSession)
    if at is None:
        cut = rows.withColumn("_h", F.xxhash64(key)).withColumn("_piece", F.pmod(F.col("_h"), F.lit(pieces)).cast("int"))
    else:
        cut = rows.withColumn("_h", at).withColumn("_piece", F.floor(F.col("_h") / (top // pieces + 1)).cast("int"))
    w = Window.partitionBy(group, "_piece").orderBy("_h", key)
    local = cut.withColumn("_rn", F.row_number().over(w))
    before = Window.partitionBy(group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        cut.groupBy(group, "_piece").count()
        .withColumn("_shift", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .select(F.col(group).alias("_g"), F.col("_piece").alias("_p"), "_shift")
    )
    same = (F.col(group) == F.col("_g")) & (F.col("_piece") == F.col("_p"))
    return local.join(shift, same).withColumn(out, F.col("_shift") + F.col("_rn") - 1).drop("_h", "_piece", "_rn", "_g", "_p", "_shift")


def tempered_weights(docs: DataFrame, power: float = 0.5, source_col: str = "source") -> dict[str, float]:
    """Weights by (rows of the source) ** power."""
    counts = docs.groupBy(F.coalesce(F.col(source_col), F.lit("")).alias("s")).count().limit(MAX_SOURCES + 1).collect()
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return {r["s"]: r["count"] ** power for r in counts}


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, *, block: int = 16, frame: int = FRAME, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """doc_id, source, block, release, deadline, slot, place for every row of a source with a weight above 0.

    block counts the source's blocks from 0; release and deadline are in the slots of the endless schedule, slot is
    the block's number in the mix (without gaps), place the row's number within its block. Without weights, sources
    weigh as the square root of their rows. Rows are dealt to blocks in the order of a hash of their id.

    A null source is the source ''. Null ids sort before others of the same hash; rows with the same id are rows of
    their own. Sources without a positive weight aren't part of the mix. Empty tables give no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"))
    weights = tempered_weights(docs, source_col=source_col) if weights is None else weights
    shares, frame = whole_shares(weights, frame)
    empty = rows.limit(0).select("doc_id", "source", *[F.lit(0).cast("long").alias(c) for c in ("block", "release", "deadline", "slot", "place")])
    if not shares:
        return empty
    # A row for each source with a weight; of which there are MAX_SOURCES at most.
    weighed = docs.sparkSession.createDataFrame([(s, int(a)) for s, a in shares.items()], "source string, _a int")
    rows = rows.join(F.broadcast(weighed), "source")
    dealt = (
        numbered(rows, "source", F.col("doc_id"), "_n")
        .withColumn("block", F.floor(F.col("_n") / block))
        .withColumn("place", F.col("_n") % block)
        .withColumn("_frame", F.floor(F.col("block") / F.col("_a")))
        .withColumn("k", (F.col("block") % F.col("_a")).cast("int"))
    )
    # The plan has one row a slot, and frame slots, whatever the input.
    joined = dealt.join(F.broadcast(frame_plan(docs, shares, frame)), ["source", "k"])
    # How many blocks each frame has: of each source, what is left of it, as far as a frame goes.
    held = rows.groupBy("source", "_a").agg(F.ceil(F.count(F.lit(1)) / block).alias("_held"))
    frames = held.withColumn("_frame", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_held") - 1) / F.col("_a")))))
    sizes = frames.groupBy("_frame").agg(F.sum(F.least(F.col("_a"), F.col("_held") - F.col("_frame") * F.col("_a"))).alias("_size"))
    before = running_totals(sizes, "_frame", "_size", "_before")
    # Within a frame, which has a block a slot at most, blocks are counted in the order of their slots.
    within = F.dense_rank().over(Window.partitionBy("_frame").orderBy("at")) - 1
    return joined.withColumn("_within", within).join(before, "_frame").select(
        "doc_id", "source", "block",
        F.floor(F.col("block") * frame / F.col("_a")).alias("release"),
        F.ceil((F.col("block") + 1) * frame / F.col("_a")).alias("deadline"),
        (F.col("_before") + F.col("_within")).alias("slot"),
        "place",
    )


def in_mix_order(docs: DataFrame, weights: Mapping[str, float] | None = None, *, at: str | None = None, **options) -> DataFrame:
    """docs with its own columns, the rows laid out in the order of the mix: sorted files, one range of slots each.

    Rows with the same id stay together, in the order of the first of them; sources without a weight come last.
    at: a column to add with the rows' positions in the mix, from 0; null for sources without a weight.
    """
    key, place = unused("_id", docs), unused("_at", docs)
    order = mix(docs, weights, **options).groupBy(F.col("doc_id").alias(key)).agg(F.min(F.struct("slot", "place")).alias(place))
    id_col = options.get("id_col", "doc_id")
    placed = docs.join(order, F.col(id_col).eqNullSafe(F.col(key)), "left").drop(key)
    slot = F.coalesce(F.col(f"{place}.slot"), F.lit((1 << 62)))
    n = max(1, shuffle_partitions(docs.sparkSession))
    laid = placed.repartitionByRange(n, slot, F.col(f"{place}.place")).sortWithinPartitions(slot, F.col(f"{place}.place"))
    if at:
        laid = laid.withColumn(at, F.col(f"{place}.slot") * options.get("block", 16) + F.col(f"{place}.place"))
    return laid.drop(place)
