"""Reasons to look at a model's answers again: signs in what was answered, never a measure of how likely it is wrong.

All tables have win, the window. targets: i (order), quote_id. labels: quote_id, kind, assignment, basis, speaker,
evidence (an array of references); the answers, one a quote. context: ref, text; what was sent along, targets included.
people: character_id, existing_ref, name, aliases; those who were proposed. declared: temp_ref, character_id (null or
empty: none); those whom the answer brought in. requested: quote_id; targets for which the answer asks for more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.operators.graph import settled

#: Bases that are no proof, verbs of speech, words by which one names oneself, targets between audits (fixed values).
WEAK = ["STYLE_ONLY", "INSUFFICIENT"]
VERBS, ONESELF = "说|问|答|喊|叫|开口|吐槽", "我是|我叫|本人"
STRIDE = 16


def _uncertain() -> Column:
    return F.coalesce(F.col("assignment") == "UNKNOWN", F.lit(False)) | F.coalesce(F.col("kind") == "unknown", F.lit(False)) | F.coalesce(F.col("basis").isin(WEAK), F.lit(False))


def _with_names(labels: DataFrame, people: DataFrame, declared: DataFrame) -> DataFrame:
    """labels with _new (declared without a known person) and _names of whom the speaker is; null for nobody that was proposed."""
    names = F.filter(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: F.coalesce(x, F.lit("")) != "")
    p = people.select("win", "character_id", "existing_ref", names.alias("_names"))
    known = p.filter("coalesce(character_id, '') <> ''").groupBy("win", "character_id").agg(F.first("_names").alias("_n1"))
    there = p.filter("existing_ref IS NOT NULL").groupBy("win", F.col("existing_ref").alias("speaker")).agg(F.first("_names").alias("_n2"))
    d = declared.groupBy("win", F.col("temp_ref").alias("speaker")).agg(F.max(F.coalesce("character_id", F.lit(""))).alias("character_id"), F.lit(True).alias("_declared"))
    x = labels.join(d.join(known, ["win", "character_id"], "left"), ["win", "speaker"], "left").join(there, ["win", "speaker"], "left")
    return x.withColumns({"_new": F.coalesce(F.col("_declared") & (F.col("character_id") == ""), F.lit(False)), "_names": F.when(F.col("_declared"), F.col("_n1")).otherwise(F.col("_n2"))}).drop("character_id", "_declared", "_n1", "_n2")


def detected(targets: DataFrame, labels: DataFrame, context: DataFrame, people: DataFrame, declared: DataFrame, requested: DataFrame, stride: int = STRIDE) -> DataFrame:
    """win, quote_id, i (from 0), reasons: the targets with reasons, these in a fixed order.

    Targets without an answer are told as such; answers about others, and requests for others, aren't targets' risks. A
    reference that wasn't sent is no evidence. Evidence is matched with people and answers by its reference, so that no
    window meets in one task but for its numbers.
    """
    if stride < 1:
        raise ValueError("stride must be positive")
    w = Window.partitionBy("win")
    t = targets.withColumn("i", F.row_number().over(w.orderBy("i", "quote_id")) - 1).withColumn("_last", F.max("i").over(w)).select("win", "quote_id", "i", "_last")
    texts = context.groupBy("win", "ref").agg(F.first("text").alias("text"))
    answers = settled(_with_names(labels.select("win", "quote_id", "kind", "assignment", "basis", "speaker", "evidence"), people, declared))
    cited = answers.select("win", "quote_id", "speaker", "_names", F.explode(F.array_distinct("evidence")).alias("ref"))
    shared = cited.filter("speaker <> ''").groupBy("win", "ref").agg((F.count_distinct("speaker") > 1).alias("_shared"))
    weak = answers.select("win", F.col("quote_id").alias("ref"), _uncertain().alias("_weak"))
    outside = cited.filter("ref <> quote_id").join(texts, ["win", "ref"]).join(shared, ["win", "ref"], "left").join(weak, ["win", "ref"], "left")
    named = F.exists("_names", lambda x: F.contains(F.col("text"), x))
    proof = outside.groupBy("win", "quote_id").agg(F.lit(True).alias("_outside"), F.max("_shared").alias("_shared"), F.max("_weak").alias("_weak"), F.max(named).alias("_named"), F.max(F.col("text").rlike(VERBS)).alias("_verb"))
    own = texts.select("win", F.col("ref").alias("quote_id"), "text")
    asked = requested.select("win", "quote_id", F.lit(True).alias("_asked")).distinct()
    x = t.join(answers.withColumn("_label", F.lit(True)), ["win", "quote_id"], "left").join(proof, ["win", "quote_id"], "left").join(own, ["win", "quote_id"], "left").join(asked, ["win", "quote_id"], "left")
    is_ = lambda c: F.coalesce(c, F.lit(False))
    label, speech = is_(F.col("_label")), is_(F.col("kind") == "speech")
    told = {
        "requested_context": F.col("_asked"), "missing_label": ~label, "speech_type_ambiguity": label & ~speech,
        "unknown": (F.col("assignment") == "UNKNOWN") | (F.col("kind") == "unknown"), "weak_basis": F.col("basis").isin(WEAK), "no_external_evidence": speech & ~is_(F.col("_outside")),
        "new_identity": F.col("_new"), "direct_relation_unverified": is_(F.col("basis") == "DIRECT") & ~(is_(F.col("_named")) & is_(F.col("_verb"))),
        "shared_evidence_conflict": F.col("_shared"), "uncertain_evidence_chain": F.col("_weak"),
        "addressed_person_conflict": label & F.exists("_names", lambda n: F.contains(F.col("text"), n)) & ~F.col("text").rlike(ONESELF),
        "window_edge": (F.col("i") == 0) | (F.col("i") == F.col("_last")), "accepted_sample_audit": F.col("i") % stride == 0,
    }
    reasons = F.array_compact(F.array(*[F.when(is_(c), name) for name, c in told.items()]))
    return x.select("win", "quote_id", "i", reasons.alias("reasons")).filter(F.size("reasons") > 0)
