"""Who speaks, by rule: scenes by silence, and the name before the first verb of saying right after a quote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.operators.text import PIECE, pieces_of

#: Verbs of saying (fixed values).
VERBS = ["低声说", "忽然说", "低声回答", "开口说道", "接着说", "回答说", "说道", "喊道", "说", "道", "问", "答", "喊", "叫"]
#: Characters that a name doesn't hold (fixed value).
BOUNDARY = "。！？；，、,.!?;「」『』()《》〈〉“”\"'：: \n\t…—"
#: Code points after a quote that are looked at, of a silence that ends a scene, and of a name at most (fixed values).
LOOKAHEAD, SCENE_GAP, NAME = 40, 200, 6

_STOP = "[" + "".join(rf"\x{{{ord(c):x}}}" for c in BOUNDARY) + "]"


def tails(texts: DataFrame, quotes: DataFrame, size: int = LOOKAHEAD, piece: int = PIECE) -> DataFrame:
    """quotes (book, end_cp) with tail, the `size` code points of their text after them.

    texts: as pieces_of() takes them. A quote is looked up in its piece, which brings along what follows it.
    """
    w = Window.partitionBy("book").orderBy("piece")
    p = pieces_of(texts, piece).select("book", "piece", "base", "text")
    head = p.select("book", "piece", F.substring("text", 1, size).alias("_head"), F.length("text").alias("_n"))
    # Pieces may be short at their end, so two of them are looked at.
    head = head.select("book", "piece", F.concat(*[F.coalesce(F.lead("_head", k).over(w), F.lit("")) for k in (1, 2)]).alias("_more"), F.lead("piece").over(w).alias("_next"))
    p = p.join(head, ["book", "piece"])
    at = quotes.withColumn("_at", F.floor(F.greatest(F.col("end_cp") - 1, F.lit(0)) / piece))
    # A piece without a beginning in it has no row: the one before it reaches over it.
    spans = p.withColumn("_at", F.explode(F.sequence(F.col("piece"), F.greatest("piece", F.floor((F.col("base") + F.length("text") - 1) / piece)))))
    held = at.join(spans, ["book", "_at"], "left").filter("base IS NULL OR (end_cp > base AND end_cp <= base + length(text)) OR (end_cp = 0 AND base = 0)")
    tail = F.substring(F.concat("text", "_more"), (F.col("end_cp") - F.col("base") + 1).cast("int"), F.lit(size))
    return held.withColumn("tail", F.coalesce(tail, F.lit(""))).select(*quotes.columns, "tail")


def name_before(tail: Column, at: Column) -> Column:
    """The name that ends before position `at` of tail; empty where none does.

    What divides names is taken off the end. Of what is left, the last NAME code points are the name; where fewer are
    left, as many are passed over at the front as are missing, less what was taken off.
    """
    before = F.substring(tail, F.lit(1), at)
    bare = F.regexp_replace(before, f"{_STOP}+$", "")
    n = F.length(bare)
    skip = F.when(n >= NAME, n - NAME).otherwise(F.greatest(F.lit(0), F.length(before) + n - NAME))
    name = F.substring(bare, skip + 1, F.lit(NAME))
    return F.when(name.rlike(_STOP), "").otherwise(name)


def attributed(tail: Column) -> Column:
    """struct(name, verb): of the first place in tail where a verb stands with a name before it, the least verb there; or null."""
    verbs = F.array(*[F.lit(v) for v in sorted(VERBS)])

    def found(i: Column) -> Column:
        verb = F.get(F.filter(verbs, lambda v: F.substring(tail, i + 1, F.length(v)) == v), F.lit(0))
        return F.struct(name_before(tail, i).alias("name"), verb.alias("verb"))

    places = F.when(F.length(tail) > 1, F.sequence(F.lit(1), F.length(tail) - 1)).otherwise(F.array().cast("array<int>"))
    # Only where a verb may begin.
    begins = "[" + "".join(sorted({v[0] for v in VERBS})) + "]"
    places = F.filter(places, lambda i: F.substring(tail, i + 1, F.lit(1)).rlike(begins))
    return F.get(F.filter(F.transform(places, found), lambda x: x["verb"].isNotNull() & (x["name"] != "")), F.lit(0))


def baseline(quotes: DataFrame) -> DataFrame:
    """quotes (book, start_cp, end_cp, tail) with scene_key, group_key, status and evidence.

    A scene ends where more than SCENE_GAP code points pass without a quote. A quote without a name is UNKNOWN.
    """
    w = Window.partitionBy("book").orderBy("start_cp", "end_cp")
    furthest = F.max("end_cp").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start_cp") - furthest > SCENE_GAP, 1).otherwise(0)
    q = quotes.withColumn("_new", new).withColumn("_x", attributed(F.col("tail")))
    return q.withColumns({
        "scene_key": F.concat(F.lit("b0-scene-"), F.sum("_new").over(w).cast("string")), "group_key": F.col("_x.name"),
        "status": F.when(F.col("_x").isNotNull(), "ACCEPTED").otherwise("UNKNOWN"), "evidence": F.col("_x.verb"),
    }).drop("_new", "_x", "tail")
