"""Chat formatting by perspective rotation: every participant once speaks as the assistant.

For each participant of a conversation, the dialogue is rendered with that participant's turns as the assistant's and
all others' as those of named users. A turn's header and the others' turns are masked; the assistant's text and the
end mark after it are trained on. Turns of the system role stay the system's, in every perspective.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SYSTEM = "system"
#: Turns by which a conversation's running offsets are cut, so that no task needs a whole conversation.
PIECE = 256


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, perspective, turn, seq, segment, start, learn_start, learn_end for every participant and turn.

    segment is the rendered turn, start its offset (code points) in the rendered dialogue; learn_start and learn_end
    bound the part that is trained on (null where all is masked). Joining the segments by seq gives the dialogue.

    Nulls: a null text is empty, a null role the participant 'unknown', a null turn comes first, and null
    conversations form one. Turns with the same number are ordered by role, then text; repeated rows are turns of
    their own. A conversation with system turns only has no perspective and no rows. Empty tables give none.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("piece", F.coalesce(F.floor(F.col("turn") / PIECE), F.lit(-(1 << 62))))
    views = rows.filter(F.col("role") != SYSTEM).select(F.col("conv_id").alias("_c"), F.col("role").alias("perspective")).distinct()
    seen = rows.join(views, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    own = F.col("role") == F.col("perspective")
    header = F.when(own, F.lit("assistant")).when(F.col("role") == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), F.col("role")))
    head = F.concat(F.lit("<|im_start|>"), header, F.lit("\n"))
    seen = seen.select(
        "conv_id", "perspective", "piece", "turn", "role", F.length(head).alias("head"), own.alias("own"),
        F.concat(head, F.col("text"), F.lit("<|im_end|>\n")).alias("segment"),
    )
    w = Window.partitionBy("conv_id", "perspective", "piece").orderBy("turn", "role", "segment").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = seen.withColumns({
        "n": F.count(F.lit(1)).over(w),
        "upto": F.sum(F.length("segment").cast("long")).over(w),
    })
    before = Window.partitionBy("conv_id", "perspective").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        seen.groupBy("conv_id", "perspective", "piece")
        .agg(F.count(F.lit(1)).alias("m"), F.sum(F.length("segment").cast("long")).alias("chars"))
        .select(
            F.col("conv_id").alias("_c"), F.col("perspective").alias("_p"), F.col("piece").alias("_k"),
            F.coalesce(F.sum("m").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("_chars"),
        )
    )
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("perspective") == F.col("_p")) & (F.col("piece") == F.col("_k"))
    start = F.col("_chars") + F.col("upto") - F.length("segment")
    return local.join(shift, same).select(
        "conv_id", "perspective", "turn", (F.col("_n") + F.col("n") - 1).alias("seq"), "segment", start.alias("start"),
        F.when(F.col("own"), start + F.col("head")).alias("learn_start"),
        F.when(F.col("own"), start + F.length("segment") - 1).alias("learn_end"),
    )
