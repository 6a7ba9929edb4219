"""Quality rules with risk-controlled thresholds.

Rules reject a document whose feature lies beyond a cutoff. In each stratum, the rules' cutoffs are tightened one step at
a time, and of this nested sequence of joint cutoffs the strictest is chosen up to which the exact binomial bound shows
that the rules together reject at most ALPHA of the good documents: were that rate ALPHA, so few rejections among the
labelled good documents had a probability of at most DELTA / strata. As the sequence is fixed before its bounds are
tested and the first step without a bound ends it, its steps need no further correction (fixed-sequence testing), and
all strata's choices hold together with probability 1 - DELTA. The order of the steps comes from one in ORDERING of the
labelled documents, which the bounds leave out: those that reject the fewest good ones come first, so that a rule that
doesn't suit a stratum comes last there and keeps no other from being used. A stratum with too few labels rejects nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import SPACE, let, named, stash, unused

#: Most good documents that the rules of a stratum may reject together, and the probability that any bound fails.
ALPHA, DELTA = 0.02, 0.05
#: rule -> (whether large values are rejected, candidate cutoffs from the strictest on). Fixed before labels are seen.
RULES = {
    "symbol_share": (True, [0.01, 0.02, 0.05, 0.1, 0.2, 0.4]),
    "dup_line_share": (True, [0.05, 0.1, 0.2, 0.3, 0.5, 0.7]),
    "repeat_share": (True, [0.02, 0.05, 0.08, 0.12, 0.16, 0.2]),
    "mean_word": (True, [8.0, 9.0, 10.0, 12.0, 15.0, 20.0]),
    "short_word": (False, [4.0, 3.5, 3.0, 2.5, 2.0, 1.5]),
}
#: One in so many labelled documents decides the order of the steps, by a hash of its id; the others decide the bounds.
ORDERING = 5
#: Strata whose table of cutoffs goes to every task; a longer table is dealt out, in so many copies that a large stratum is spread.
TO_ALL, COPIES = 10_000, 32
WINDOW, MIN_WORDS, REPEAT_PERCENT = 5, 10, 20


def repeat_words(words: Column) -> Column:
    """Words that lie in a five-word window which occurs twice or more in the text."""

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[h[i + j] for j in range(WINDOW)]))

    def covered(at: Column) -> Column:
        # at: sorted positions of such windows. Each covers its words up to the next window's start.
        return F.aggregate(
            F.transform(at, lambda p, i: F.when(i == F.size(at) - 1, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), F.get(at, i + 1) - p))),
            F.lit(0).cast("long"), lambda s, x: s + x,
        )

    def repeated(x: Column) -> Column:
        ranked = F.array_sort(F.transform(x, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return let(ranked, lambda r: let(
            F.array_sort(F.transform(
                F.filter(r, lambda e, i: F.coalesce(F.get(r, i - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(r, i + 1)["h"] == e["h"], F.lit(False))),
                lambda e: e["p"],
            )),
            covered,
        ))

    def of(h: Column) -> Column:
        return F.when(F.size(h) < WINDOW + 1, F.lit(0).cast("long")).otherwise(
            let(windows(h), lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0).cast("long")).otherwise(repeated(x)))
        )

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", whole: bool = False) -> DataFrame:
    """doc_id, stratum, the counts that the rules use, and the rules' features; whole: also the row itself, as _row.

    A null text has no words and every count 0; a null stratum is ''. Rows with the same id are rows of their own.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(F.col("t"), "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)
    row = ["_row"] if whole else []
    counts = (
        docs.select(*([F.struct(*named(docs)).alias("_row")] if whole else []), F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), text.alias("t"))
        .select(
            *row, "doc_id", "stratum",
            let(F.filter(F.split("t", SPACE), lambda w: w != ""), lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.aggregate(w, F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("word_chars"),
                repeat_words(w).alias("n_repeat_words"),
            )).alias("w"),
            (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            let(lines, lambda x: F.size(x).cast("long")).alias("n_lines"),
        )
        .select(*row, "doc_id", "stratum", "w.*", "n_symbols", "n_dup_lines", "n_lines")
    )
    return counts.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")),
        "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)),
        "mean_word": F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
        "short_word": F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
    })


def most_rejections(n: Column, rate: float, level: Column) -> Column:
    """The largest k with P(Binomial(n, rate) <= k) <= level, or -1: exact, summed in logarithms."""
    step = math.log(rate / (1 - rate))

    def advance(s: Column, i: Column) -> Column:
        term = s["term"] + F.log(((n - i + 1) / i).cast("double")) + step
        top = F.greatest(s["sum"], term)
        total = top + F.log1p(F.exp(F.least(s["sum"], term) - top))
        return F.struct(term.alias("term"), total.alias("sum"), F.when((total <= F.log(level)) & (s["k"] == i - 1), i).otherwise(s["k"]).alias("k"))

    first = n * math.log1p(-rate)
    start = F.struct(first.alias("term"), first.alias("sum"), F.when(first <= F.log(level), F.lit(0).cast("long")).otherwise(F.lit(-1).cast("long")).alias("k"))
    # Beyond the mean the probability is over a half.
    last = F.ceil(n * rate).cast("long")
    return F.when(n < 1, F.lit(-1).cast("long")).otherwise(
        F.aggregate(F.when(last >= 1, F.sequence(F.lit(1).cast("long"), last)).otherwise(F.array().cast("array<bigint>")), start, advance, lambda s: s["k"])
    )


def rejects(rule: str, cut: Column) -> Column:
    return F.col(rule) > cut if RULES[rule][0] else F.col(rule) < cut


def by_stratum(rows: DataFrame, table: DataFrame, strata: int, how: str = "inner") -> DataFrame:
    """rows (with doc_id) joined with a table that has a row for each of so many strata, at most."""
    if strata <= TO_ALL:
        return rows.join(F.broadcast(table), "stratum", how)
    copy = unused("_copy", rows, table)
    spread = rows.withColumn(copy, F.pmod(F.xxhash64("doc_id"), F.lit(COPIES)))
    copies = table.withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(COPIES - 1).cast("long"))))
    return spread.join(copies, ["stratum", copy], how).drop(copy)


def thresholds(feats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, n_good, and for each rule the chosen cutoff (null: none is safe).

    labels: doc_id, quality (1: good). Labels without a document or with a null quality count for nothing; of
    repeated labels of a document, each different one counts once.
    """
    marks = labels.filter(F.col(label_col) == 1).select(F.col(id_col).alias("doc_id")).distinct()
    good = feats.join(marks, "doc_id", "left_semi").filter(~F.col("base_failed"))
    good = good.withColumn("_orders", F.pmod(F.xxhash64("doc_id"), F.lit(ORDERING)) == 0)
    steps = [(rule, c, len(cuts) - k) for rule, (_, cuts) in RULES.items() for k, c in enumerate(cuts)]
    strata = feats.agg(F.count_distinct("stratum")).first()[0]
    # Rejections by each step among the documents that order them, in the stratum and, for ties, in all strata.
    found = good.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n_good"), F.count_if(~F.col("_orders")).alias("_n"),
        *[F.count_if(F.col("_orders") & rejects(rule, F.lit(c))).alias(f"_c{k}") for k, (rule, c, _) in enumerate(steps)],
    )
    overall = found.agg(*[F.sum(f"_c{k}").alias(f"_all{k}") for k in range(len(steps))])
    order = F.array_sort(F.array(*[F.struct(F.col(f"_c{k}").alias("own"), F.col(f"_all{k}").alias("all"), F.lit(level).alias("level"), F.lit(k).alias("k")) for k, (_, _, level) in enumerate(steps)]))
    found = found.crossJoin(F.broadcast(overall)).select("stratum", "n_good", "_n", F.transform(order, lambda x: x["k"]).alias("_order"))
    # The first step that rejects each of the other documents; one beyond the last, if none does.
    hit = F.array(*[rejects(rule, F.lit(c)) for rule, c, _ in steps])
    at = F.aggregate(F.transform("_order", lambda k, i: F.when(F.get(hit, k), i)), F.lit(len(steps)), lambda s, i: F.least(s, i))
    tested = by_stratum(good.filter(~F.col("_orders")), found.select("stratum", "_order"), strata).withColumn("_at", at)
    told = tested.groupBy("stratum").agg(*[F.count_if(F.col("_at") <= k).alias(f"_t{k}") for k in range(len(steps))])
    found = found.join(told, "stratum", "left").withColumn("_most", most_rejections(F.col("_n"), alpha, F.lit(delta / max(1, strata))))
    # Rejections grow along the sequence, so the steps with a bound are its first ones.
    found = found.withColumn("_steps", sum((F.when(F.coalesce(F.col(f"_t{k}"), F.lit(0)) <= F.col("_most"), 1).otherwise(0) for k in range(len(steps))), F.lit(0)))
    chosen = F.when(F.col("_steps") > 0, F.slice("_order", F.lit(1), F.col("_steps"))).otherwise(F.array().cast("array<int>"))
    place = {(rule, c): k for k, (rule, c, _) in enumerate(steps)}
    return found.withColumn("_chosen", chosen).select(
        "stratum", "n_good",
        *[
            F.coalesce(*[F.when(F.array_contains("_chosen", place[rule, c]), F.lit(c)) for c in cuts]).alias(f"cut_{rule}")
            for rule, (_, cuts) in RULES.items()
        ],
    )


def judge(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """Counts, features, cutoffs and verdict (base_failed, kept) for every row of docs.

    Null texts have no words and fail the base rules. Ids that repeat get a row each; a null id has no label. Extra
    columns of either table are ignored. Without labels, only the base rules reject. An empty table gives no rows.
    """
    feats = stash(features(docs, **names), "quality-features")
    return _with_verdict(feats, stash(thresholds(feats, labels), "quality-cuts"))


def _with_verdict(feats: DataFrame, cuts: DataFrame) -> DataFrame:
    bad = F.col("base_failed")
    for rule in RULES:
        bad = bad | F.coalesce(rejects(rule, F.col(f"cut_{rule}")), F.lit(False))
    return by_stratum(feats, cuts, cuts.count(), "left").withColumn("kept", ~bad)


def keep_good(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """The rows of docs that no rule rejects, with their columns."""
    cuts = stash(thresholds(stash(features(docs, **names), "quality-features"), labels), "quality-cuts")
    return _with_verdict(features(docs, **names, whole=True), cuts).filter("kept").select("_row.*")
