"""How filters act together: what each removes, repeats and alone catches, in every order that they may be applied in.

Words are rows: documents are dealt out once by id and text, their words exploded, counted by (document, word) and then by
document, without another shuffle of words. Other flags come from a second reading of the documents and are joined
on. A document's failures make a number of five bits, and for each part of the corpus 32 conditional counts (of all,
of good and of toxic documents) say all that any order of filters does.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import SPACE

FILTERS = "ABCDE"
#: Fewest words, distinct words and capital letters in percent, and the symbols of the fourth filter.
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 200, 50, 3, "[#$%&*|]"
WHOLE = {"tinyint", "smallint", "int", "bigint"}


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """_id, _h, _given, part, t for every row: _id and _h tell apart ids and, among rows of an id, texts.

    A null id is a value of its own, which its text deals out; _given tells that the id isn't null.
    """
    given, text = F.col(id_col).isNotNull(), F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(id_col).dtypes[0][1] in WHOLE
    id_ = F.coalesce(F.col(id_col).cast("long"), F.lit(0)) if whole else F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    h = F.when(given, F.xxhash64(text)).otherwise(F.xxhash64(text, F.lit(1)))
    return docs.select(id_.alias("_id"), h.alias("_h"), given.alias("_given"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("t"))


def word_totals(rows: DataFrame) -> DataFrame:
    """_id, _h, n_words, n_distinct for each document of keyed(), copies taken together."""
    dealt = rows.select("_id", "_h", "t").repartition("_id", "_h")
    # A null beside the words counts the copies of a document, and stands for it where there is no word.
    words = dealt.select("_id", "_h", F.explode(F.array_append(F.split("t", SPACE), F.lit(None))).alias("word")).filter("word is null or word <> ''")
    counts = words.groupBy("_id", "_h", "word").agg(F.count(F.lit(1)).alias("n"))
    each = counts.groupBy("_id", "_h").agg(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))).alias("all"), F.count("word").alias("n_distinct"), F.max(F.when(F.col("word").isNull(), F.col("n"))).alias("copies"))
    return each.select("_id", "_h", F.coalesce((F.col("all") / F.col("copies")).cast("long"), F.lit(0)).alias("n_words"), "n_distinct")


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """_id, _h, _given, part and A to E for every row of docs: whether it fails that filter.

    A: too few words; B: too few distinct words; C: too many capital letters; D: a symbol; E: another row with a smaller
    id has the same text. A null text is empty, a null part ''. A row without an id fails no E, and no row fails E for
    it. Rows that repeat an id and text are judged alike and count each. Extra columns are ignored.
    """
    rows = keyed(docs, id_col, text_col, part_col)
    flags = rows.select(
        "_id", "_h", "_given", "part",
        (100 * F.regexp_count("t", F.lit("[A-Z]")) > CAPITAL_PERCENT * F.length("t")).alias("C"), F.col("t").rlike(SYMBOLS).alias("D"),
    )
    # The first id of each text; a row is matched by id and text, so no group of copies meets in one task.
    first = rows.filter("_given").groupBy(F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("_digest"), "_h").agg(F.min("_id").alias("_id")).select("_id", "_h", F.lit(True).alias("_first"))
    joined = flags.join(word_totals(rows), ["_id", "_h"], "left").join(first, ["_id", "_h"], "left")
    n_words, n_distinct = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    return joined.select(
        "_id", "_h", "_given", "part", (n_words < MIN_WORDS).alias("A"), (100 * n_distinct < DISTINCT_PERCENT * n_words).alias("B"), "C", "D",
        (F.col("_given") & F.col("_first").isNull()).alias("E"),
    )


def marked(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """failed with good and toxic: whether any label of the row's id says so. Labels that repeat an id count once."""
    id_ = F.col(id_col).cast("string" if dict(failed.dtypes)["_id"] == "string" else "long")
    told = labels.filter(F.col(id_col).isNotNull()).groupBy(id_.alias("_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    # Rows without an id meet no label; their texts' hashes spread them.
    pad = F.when(F.col("_given"), 0).otherwise(F.col("_h").bitwiseOR(F.lit(1)))
    both = failed.withColumn("_pad", pad).join(told.withColumn("_pad", F.lit(0).cast("long")), ["_id", "_pad"], "left")
    return both.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def interactions(flags: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and the counts of that step, from rows of part, good, toxic and a boolean for each filter."""
    mask = sum((F.when(F.col(f), 1 << k).otherwise(0) for k, f in enumerate(filters)), F.lit(0))
    subsets = range(1 << len(filters))
    of = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    found = flags.withColumn("_mask", mask).groupBy("part").agg(*[F.count_if((F.col("_mask") == m) & which).alias(f"{c}{m}") for c, which in of.items() for m in subsets])
    found = found.select("part", *[F.array(*[f"{c}{m}" for m in subsets]).alias(c) for c in of])

    def bits(letters: Column) -> Column:
        return sum((F.when(F.contains(letters, F.lit(f)), 1 << k).otherwise(0) for k, f in enumerate(filters)), F.lit(0))

    def total(counts: str, fits) -> Column:
        return F.aggregate(F.transform(counts, lambda n, m: F.when(fits(m), n).otherwise(0)), F.lit(0).cast("long"), lambda s, n: s + n)

    orders = F.explode(F.split(F.lit(",".join(map("".join, permutations(filters)))), ","))
    steps = found.withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    steps = steps.withColumns({
        "_own": bits(F.substring("filter_order", F.col("step"), F.lit(1))), "_before": bits(F.substring("filter_order", F.lit(1), F.col("step") - 1)),
    })
    fails = lambda m: m.bitwiseAND(F.col("_own")) != 0
    gone = lambda m: m.bitwiseAND(F.col("_before")) != 0

    def share() -> Column:
        """What the filter removes, summed over all orders: a document that fails k filters is removed by each in one of k orders."""
        return total_weighted("n", lambda m: F.when(fails(m), F.lit(factorial(len(filters))) / F.bit_count(m)).otherwise(0))

    def total_weighted(counts: str, weight) -> Column:
        return F.aggregate(F.transform(counts, lambda n, m: n * weight(m).cast("long")), F.lit(0).cast("long"), lambda s, n: s + n)

    return steps.select(
        "part", "filter_order", "step",
        total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"), total("n", lambda m: fails(m) & ~gone(m)).alias("removed"),
        total("n", lambda m: fails(m) & gone(m)).alias("redundant"), F.get("n", F.col("_own")).alias("unique_fails"),
        total("good", lambda m: fails(m) & ~gone(m)).alias("good_lost"), total("toxic", lambda m: fails(m) & ~gone(m)).alias("toxic_lost"), share().alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The counts of every step of every order of the five filters, in each part. An empty table gives no rows."""
    return interactions(marked(failures(docs, id_col, text_col, part_col), labels, id_col))
