"""Decisions on model outputs and windows, checks of gold and manifests, risks and their closure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.operators import graph, intervals

#: Kinds that have an owner under the newer contract; bases that name a person outright, and weak ones (fixed values).
OWNED, EXPLICIT, WEAK = ("speech", "thought", "quotation"), ("DIRECT", "COREFERENCE"), ("STYLE_ONLY", "INSUFFICIENT")
HARD_TARGETS, AUDIT_STRIDE = 4, 16


def with_evidence(outputs: DataFrame) -> DataFrame:
    """Adds evidence, the array of the quotes that a label refers to."""
    return outputs.withColumn("evidence", F.array_compact(F.array("e_self", "e_prev")))


def accepted(labels: DataFrame) -> DataFrame:
    """Adds status, reason and review (the reason to review, if any) to labels.

    labels: quote_id, kind, versioned (whether the newer contract holds), assignment, basis, evidence.
    """
    basis = F.coalesce("basis", F.lit("INSUFFICIENT"))
    owned = (F.col("kind") == "speech") | (F.col("versioned") & F.col("kind").isin(*OWNED))
    outside = F.exists("evidence", lambda e: e != F.col("quote_id"))
    linked = F.size("evidence") > 0
    no_source = F.when(F.col("kind") == "quotation", "UNKNOWN_QUOTE_SOURCE").otherwise("UNKNOWN_SPEAKER")
    low = F.lower(basis)
    # condition: status, reason, review; the first that holds decides.
    rules: list[tuple[Column, str, Column | str, Column | str | None]] = [
        (F.col("kind") == "unknown", "UNKNOWN", "unknown_quote_kind", "UNKNOWN_QUOTE_KIND"),
        (~owned, "ACCEPTED", "non_speech_type", None),
        ((F.col("assignment") == "UNKNOWN") | (basis == "INSUFFICIENT"), "UNKNOWN", "insufficient_evidence", no_source),
        (basis == "STYLE_ONLY", "PROVISIONAL", "style_only_basis", "LOW_CONFIDENCE"),
        ((basis == "DIRECT") & ~outside, "PROVISIONAL", "unverified_direct_basis", "LOW_CONFIDENCE"),
        (basis == "DIRECT", "ACCEPTED", "direct_evidence", None),
        (basis.isin("COREFERENCE", "RESPONSE_LINK") & linked, "ACCEPTED", F.concat(F.lit("linked_"), low), None),
        (basis.isin("COREFERENCE", "RESPONSE_LINK"), "PROVISIONAL", F.concat(F.lit("unverified_"), low), "AMBIGUOUS_SPEAKER"),
        (F.lit(True), "PROVISIONAL", F.concat(F.lit("unsupported_"), low), "AMBIGUOUS_SPEAKER"),
    ]
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    verdict = F.coalesce(*(F.when(c, F.struct(F.lit(st).alias("status"), as_column(why).alias("reason"), as_column(r).cast("string").alias("review"))) for c, st, why, r in rules))
    return labels.withColumn("_v", verdict).select(*labels.columns, "_v.*")


def visible_from(positions: Column, fallback: Column) -> Column:
    """The last position of the evidence; the fallback without any."""
    return F.coalesce(F.array_max(positions), fallback)


def identity_proposals(proposals: DataFrame, cold_start: bool = True) -> DataFrame:
    """Adds reason and applied to proposals (operation, basis, inputs and outputs: how many, locked)."""
    explicit = F.concat(F.lit("explicit_"), F.lower("basis"))
    reason = (
        F.when(F.col("locked"), "touches_user_locked").when(F.col("basis").isNull(), "missing_basis")
        .when(~F.col("basis").isin(*EXPLICIT), F.concat(F.lit("evidence_too_weak:"), "basis"))
        .when((F.col("operation") == "MERGE") & (F.col("inputs") < 2), "merge_needs_two_inputs")
        .when((F.col("operation") == "SPLIT") & (F.col("outputs") < 2), "split_needs_two_outputs")
        .when(F.lit(cold_start) & (F.col("basis") == "COREFERENCE"), "cold_start_coreference").otherwise(explicit)
    )
    return proposals.withColumn("reason", reason).withColumn("applied", F.startswith("reason", F.lit("explicit_")))


def routed(windows: DataFrame, share: float) -> DataFrame:
    """Adds cap and reason to windows (job, win, targets, omitted, recheck): which of them a strong model may have."""
    hard = (F.col("recheck") == 1) | (F.col("omitted") == 1) | (F.col("targets") >= HARD_TARGETS)
    by = Window.partitionBy("job")
    w = windows.withColumns({"hard": hard, "cap": F.floor(F.lit(share) * F.count(F.lit(1)).over(by))})
    before = F.coalesce(F.sum(F.col("hard").cast("long")).over(by.orderBy("win").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reason = F.when(F.col("cap") <= 0, "disabled_by_policy").when(before >= F.col("cap"), "share_cap_reached").when(~F.col("hard"), "not_hard").otherwise("hard_window")
    return w.withColumn("reason", reason)


def recheck_targets(targets: DataFrame, most: int) -> DataFrame:
    """book, quote_id, position of the most urgent targets (book, quote_id, start_cp, priority), in order of the text."""
    k = F.row_number().over(Window.partitionBy("book").orderBy("priority", "start_cp"))
    position = F.row_number().over(Window.partitionBy("book").orderBy("start_cp"))
    return targets.withColumn("k", k).filter(F.col("k") <= most).select("book", "quote_id", position.alias("position"))


def scanner_recall(gold: DataFrame, quotes: DataFrame) -> DataFrame:
    """book, key, found: whether a gold range (l_start, l_end) was scanned exactly, lies inside a quote, or is missing."""
    met = intervals.overlapping(gold, quotes).filter("r_start <= l_start AND r_end >= l_end")
    got = met.groupBy("book", "key").agg(F.max((F.col("r_start") == F.col("l_start")) & (F.col("r_end") == F.col("l_end"))).alias("exact"))
    found = F.when(F.col("exact"), "exact").when(F.col("exact").isNotNull(), "inside").otherwise("missing")
    return gold.select("book", "key").join(got, ["book", "key"], "left").select("book", "key", found.alias("found"))


def gold_issues(quotes: DataFrame, scenes: DataFrame, groups: DataFrame) -> DataFrame:
    """book, key, issue: repeated keys, empty ranges, scenes and groups that aren't there, overlaps."""
    told = lambda df, issue: df.select("book", "key", F.lit(issue).alias("issue"))
    w = Window.partitionBy("book").orderBy("start_cp", "end_cp", "key").rowsBetween(Window.unboundedPreceding, -1)
    found = [
        told(quotes.groupBy("book", "key").count().filter("count > 1"), "duplicate_quote"),
        told(quotes.filter("end_cp <= start_cp"), "empty_range"),
        told(quotes.filter("scene IS NOT NULL").join(scenes.distinct(), ["book", "scene"], "left_anti"), "unknown_scene"),
        told(quotes.filter("grp IS NOT NULL").join(groups.distinct(), ["book", "grp"], "left_anti"), "unknown_group"),
        told(quotes.withColumn("e", F.max("end_cp").over(w)).filter("start_cp < e"), "overlap"),
    ]
    return reduce(DataFrame.unionByName, found)


def manifest_issues(books: DataFrame) -> DataFrame:
    """issue, key: books that occur twice, works that lie in several splits."""
    twice = books.groupBy(F.col("book").alias("key")).count().filter("count > 1").select(F.lit("duplicate_book").alias("issue"), "key")
    split = books.groupBy(F.col("work").alias("key")).agg(F.count_distinct("split").alias("c")).filter("c > 1")
    return twice.unionByName(split.select(F.lit("work_in_several_splits").alias("issue"), "key"))


def numbered(outputs: DataFrame) -> DataFrame:
    """Adds i, the number within the book, and many, how many there are."""
    by = Window.partitionBy("book")
    return outputs.withColumns({"i": F.row_number().over(by.orderBy("start_cp")) - 1, "many": F.count(F.lit(1)).over(by)})


def uncertain() -> Column:
    return (F.col("assignment") == "UNKNOWN") | (F.col("kind") == "unknown") | F.coalesce(F.col("basis").isin(*WEAK), F.lit(False))


def risks(outputs: DataFrame) -> DataFrame:
    """The outputs that give reasons to look again, with these (reasons) and their number in the book (i)."""
    labels = numbered(with_evidence(outputs))
    uses = labels.select(F.explode("evidence").alias("e"), "speaker").groupBy("e").agg((F.count_distinct("speaker") > 1).alias("shared"))
    weak = outputs.select(F.col("quote_id").alias("e"), uncertain().alias("weak"))
    about = uses.join(weak, "e", "full").select(F.col("e").alias("e_prev"), "shared", "weak")
    t = labels.join(about, "e_prev", "left")
    speech, outside = F.col("kind") == "speech", F.col("e_prev").isNotNull()
    told = [
        ("speech_type_ambiguity", ~speech), ("unknown", (F.col("assignment") == "UNKNOWN") | (F.col("kind") == "unknown")),
        ("weak_basis", F.col("basis").isin(*WEAK)), ("no_external_evidence", speech & ~outside), ("new_identity", F.col("assignment") == "NEW"),
        ("shared_evidence_conflict", outside & F.col("shared")), ("uncertain_evidence_chain", outside & F.col("weak")),
        ("window_edge", (F.col("i") == 0) | (F.col("i") == F.col("many") - 1)), ("accepted_sample_audit", F.col("i") % AUDIT_STRIDE == 0),
    ]
    return t.withColumn("reasons", F.array_compact(F.array(*(F.when(c, name) for name, c in told)))).filter(F.size("reasons") > 0)


#: Risks that spread to what refers to them (fixed values).
SPREADING = ("unknown", "weak_basis", "shared_evidence_conflict")


def chain_risks(outputs: DataFrame) -> DataFrame:
    """book, quote_id of the outputs at risk, and of the speech whose evidence leads to them, however far."""
    found = risks(outputs)
    seeds = found.filter(F.arrays_overlap("reasons", F.array(*map(F.lit, SPREADING)))).select(F.col("quote_id").alias("node"))
    edges = with_evidence(outputs).filter("kind = 'speech'").select(F.explode("evidence").alias("source"), F.col("quote_id").alias("target")).filter("source <> target")
    return outputs.select("book", "quote_id").join(graph.reached(edges, seeds).withColumnRenamed("node", "quote_id"), "quote_id", "left_semi")


def review_blocks(risky: DataFrame, outputs: DataFrame, neighbours: int, most: int) -> DataFrame:
    """book, first, last, targets: runs of risky outputs (book, i) with their neighbours, cut into blocks."""
    near = risky.select("book", F.explode(F.transform(F.sequence(F.lit(-neighbours), F.lit(neighbours)), lambda o: o + F.col("i"))).alias("i")).distinct()
    near = near.join(numbered(outputs).groupBy("book").agg(F.max("many").alias("many")), "book").filter("i >= 0 AND i < many")
    w = Window.partitionBy("book").orderBy("i")
    runs = near.withColumn("isle", F.col("i") - F.row_number().over(w))
    parts = runs.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("book", "isle").orderBy("i")) - 1) / most))
    return parts.groupBy("book", "isle", "part").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count(F.lit(1)).alias("targets")).drop("isle", "part")


def votes(outputs: DataFrame) -> DataFrame:
    """A first answer, a review and a third opinion for every output, by rules on its number."""
    k, own = F.col("k"), F.col("speaker")
    return outputs.withColumns({
        "locked": k % 13 == 0, "base": own, "review": F.when(k % 3 == 1, own).when(k % 3 == 2, "other"),
        "third": F.when(k % 5 == 0, "other").when(k % 5 == 1, own), "supported": k % 2 == 0,
    })


def reconciled(v: DataFrame) -> DataFrame:
    """speaker and outcome of votes: locked ones stay, a review needs a third opinion to win, else the conflict is open."""
    base, review, third = F.col("base"), F.col("review"), F.col("third")
    calm = F.col("locked") | review.isNull() | (review == base)
    speaker = F.when(calm, base).when(third == review, review).when(third == base, base)
    outcome = (
        F.when(F.col("locked"), "locked").when(review.isNull(), "unreviewed").when(review == base, "agreed")
        .when((third == review) | (third == base), "adjudicated").otherwise("unresolved_conflict")
    )
    return v.drop("speaker").withColumns({"speaker": speaker, "outcome": outcome})


def challenged(v: DataFrame) -> DataFrame:
    """Adds challenged: both answers agree, but a supported third opinion names someone else."""
    agree = F.col("review").eqNullSafe(F.col("base")) & F.col("review").isNotNull()
    return v.withColumn("challenged", ~F.col("locked") & agree & F.coalesce(F.col("third") != F.col("base"), F.lit(False)) & F.col("supported"))


def applied(outputs: DataFrame, gaps: DataFrame, stored: DataFrame) -> DataFrame:
    """What a window's answer makes of its quotes: scene, label, status, reason, review, visible_from_cp, version, history.

    outputs: labels with evidence and its positions (evidence_cp); gaps: book, at, decision; stored: quote_id, version,
    locked, was (its status). Gaps and labels are taken in the order of the text, a gap before a label at its end: a break
    opens a new scene, whose labels begin anew. Locked quotes keep what they have; the others go to the history first.
    """
    events = gaps.select("book", F.col("at").alias("start_cp"), F.lit(0).alias("_kind"), (F.col("decision") == "BREAK").cast("int").alias("_break"), F.lit(None).cast("string").alias("quote_id"))
    events = events.unionByName(outputs.select("book", "start_cp", F.lit(1).alias("_kind"), F.lit(0).alias("_break"), "quote_id"))
    w = Window.partitionBy("book").orderBy("start_cp", "_kind")
    scenes = events.withColumn("scene", F.sum("_break").over(w)).filter("quote_id IS NOT NULL").select("quote_id", "scene")
    t = accepted(outputs).withColumn("visible_from_cp", visible_from(F.col("evidence_cp"), F.col("start_cp")))
    t = t.join(scenes, "quote_id").join(stored, "quote_id", "left").withColumn("locked", F.coalesce("locked", F.lit(False)))
    # Only quotes that get an owner open a slot of their scene.
    owned = ~F.col("locked") & (F.col("status") != "UNKNOWN") & F.col("kind").isin(*OWNED)
    t = t.withColumn("_first", F.min(F.when(owned, F.col("start_cp"))).over(Window.partitionBy("book", "scene", "speaker")))
    slot = F.dense_rank().over(Window.partitionBy("book", "scene").orderBy(F.col("_first").asc_nulls_last()))
    t = t.withColumn("_slot", slot)
    old = F.col("version").isNotNull()
    return t.select(
        "book", "quote_id", "scene", F.when(owned, F.concat(F.lit("S"), F.col("_slot").cast("string"))).alias("label"),
        F.when(F.col("locked"), F.col("was")).otherwise(F.col("status")).alias("status"), F.when(~F.col("locked"), F.col("review")).alias("review"), "visible_from_cp",
        (F.coalesce("version", F.lit(0)) + (~F.col("locked")).cast("int")).alias("version"), (old & ~F.col("locked")).alias("history"),
    )
