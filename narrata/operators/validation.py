"""What a model's output for a window may refer to, and everything in it that refers to something else or contradicts itself.

All tables have win, the window. targets: kind, ref, position; kinds are quote, gap, scene, speaker, character, declared
(characters that may go without a name) and evidence. updates: i, temp_ref, after_gap, starts_at; decisions: i, gap, decision;
speakers: i, temp_ref, scene, first_quote, character, name, real_name, evidence (how many references); labels: i, quote,
scene, speaker, assignment, owned, evidence (an array of references); needs: quote. i numbers what is said in order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.operators.graph import settled
from narrata.operators.text import stripped

#: A window's scene where none is given, and what a name isn't (fixed values).
CURRENT = "scene_current"
NO_NAME = r"[（）(),，。；;\n]|本章|第一人称|叙述者|向.+搭讪|的打工前辈|^(?i:S\d+|new\d+|未知人物|未知|不确定)$"


def is_name(value: Column) -> Column:
    """Whether value is a short name, and no reference, note or sentence."""
    name = stripped(F.coalesce(value, F.lit("")))
    return (name != "") & (F.length(name) <= 32) & ~name.rlike(NO_NAME)


def _again(*keys: str) -> Column:
    """Whether a row isn't the first that says this."""
    return F.row_number().over(Window.partitionBy("win", *keys).orderBy("i")) > 1


def _known(rows: DataFrame, targets: DataFrame, kind: str, column: str, out: str) -> DataFrame:
    """rows with out: whether the column refers to a target of this kind."""
    refs = targets.filter(F.col("kind") == kind).select("win", F.col("ref").alias(column), F.lit(True).alias(out)).distinct()
    return rows.join(refs, ["win", column], "left").na.fill(False, [out])


def _told(rows: DataFrame, code: str, when: Column, ref: str) -> DataFrame:
    return rows.filter(F.coalesce(when, F.lit(False))).select("win", F.lit(code).alias("code"), F.col(ref).alias("ref"))


def scenes_of_quotes(targets: DataFrame, updates: DataFrame) -> DataFrame:
    """win, quote, expected, first: the scene of each target, by the scenes that begin at or before it, and the window's first scene."""
    scenes = targets.filter("kind = 'scene'").groupBy("win").agg(F.min_by("ref", "position").alias("first"))
    starts = updates.groupBy("win", F.col("starts_at").alias("quote")).agg(F.max_by("temp_ref", "i").alias("_new"))
    quotes = targets.filter("kind = 'quote'").select("win", F.col("ref").alias("quote"), "position")
    q = quotes.join(starts, ["win", "quote"], "left").join(scenes, "win", "left").na.fill(CURRENT, ["first"])
    w = Window.partitionBy("win").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return q.select("win", "quote", "position", "first", F.coalesce(F.last("_new", True).over(w), "first").alias("expected"))


def judged_labels(targets: DataFrame, updates: DataFrame, speakers: DataFrame, labels: DataFrame) -> DataFrame:
    """labels with code: the first thing that is wrong with each; null for those that are accepted."""
    scenes = targets.filter("kind = 'scene'").select("win", F.col("ref").alias("scene")).union(updates.select("win", "temp_ref")).distinct()
    declared = speakers.groupBy("win", F.col("temp_ref").alias("speaker")).agg(F.max_by("scene", "i").alias("_home"), F.lit(True).alias("_declared"))
    refs = targets.filter("kind = 'evidence'").groupBy("win").agg(F.collect_set("ref").alias("_refs"))
    x = labels.withColumn("_again", _again("quote")).join(scenes.withColumn("_scene", F.lit(True)), ["win", "scene"], "left")
    x = x.join(scenes_of_quotes(targets, updates), ["win", "quote"], "left").join(declared, ["win", "speaker"], "left").join(refs, "win", "left")
    x = _known(x, targets, "speaker", "speaker", "_allowed")
    existing = (F.col("_allowed") & (F.col("expected") == F.col("first"))) | F.coalesce(F.col("_home") == F.col("expected"), F.lit(False))
    is_ = lambda a: F.col("owned") & (F.col("assignment") == a)
    strange = F.col("_refs").isNotNull() & (F.size(F.array_except(F.coalesce("evidence", F.array().cast("array<string>")), F.coalesce("_refs", F.array().cast("array<string>")))) > 0)
    code = (
        F.when(F.col("_again"), "duplicate_label").when(F.col("expected").isNull(), "unknown_quote").when(F.col("_scene").isNull(), "unknown_scene")
        .when(F.col("scene") != F.col("expected"), "speaker_scene_mismatch")
        .when(is_("EXISTING") & ~existing, F.when(F.col("expected") != F.col("first"), "old_scene_speaker").otherwise("unknown_speaker"))
        .when(is_("NEW") & F.col("_declared").isNull(), "undeclared_new_speaker").when(is_("NEW") & (F.col("_home") != F.col("scene")), "speaker_scene_mismatch")
        .when(strange, "unknown_evidence")
    )
    return x.withColumn("code", code).select(*labels.columns, "code")


def issues(targets: DataFrame, updates: DataFrame, decisions: DataFrame, speakers: DataFrame, labels: DataFrame, needs: DataFrame, names_required: bool = True) -> DataFrame:
    """win, code, ref: all that is wrong with outputs, as often as it occurs."""
    breaks = decisions.filter("decision = 'BREAK'").select("win", F.col("gap").alias("after_gap"), F.lit(True).alias("_break")).distinct()
    u = updates.withColumns({"_again": _again("temp_ref"), "_gap_again": _again("after_gap"), "_start_again": _again("starts_at")})
    for kind, column, out in (("scene", "temp_ref", "_old"), ("gap", "after_gap", "_gap"), ("quote", "starts_at", "_quote")):
        u = _known(u, targets, kind, column, out)
    u = settled(u.join(breaks, ["win", "after_gap"], "left"))
    new_scenes = updates.select("win", F.col("temp_ref").alias("scene"), F.lit(True).alias("_made")).distinct()
    s = speakers.withColumn("_again", _again("temp_ref")).join(new_scenes, ["win", "scene"], "left")
    for kind, column, out in (("scene", "scene", "_scene"), ("quote", "first_quote", "_quote"), ("character", "character", "_person"), ("declared", "character", "_nameless"), ("speaker", "temp_ref", "_allowed")):
        s = _known(s, targets, kind, column, out)
    # Of the labels that use a speaker, the first in the order of quotes; quotes that aren't targets come last.
    places = targets.filter("kind = 'quote'").select("win", F.col("ref").alias("quote"), "position")
    uses = labels.filter("owned").join(places, ["win", "quote"], "left")
    first = uses.groupBy("win", F.col("speaker").alias("temp_ref")).agg(F.min_by(F.struct("quote", "assignment"), F.struct(F.col("position").isNull().alias("n"), "position", "i")).alias("_use"))
    s = settled(s.join(first, ["win", "temp_ref"], "left").withColumn("_used", F.col("_use.quote")))
    has, person = F.coalesce(F.col("evidence") > 0, F.lit(False)), F.coalesce("character", F.lit("")) != ""
    real = F.coalesce("real_name", F.lit("")) != ""
    d = _known(decisions.withColumn("_again", _again("gap")), targets, "gap", "gap", "_gap")
    x = settled(judged_labels(targets, updates, speakers, labels))
    quotes = targets.filter("kind = 'quote'").select("win", F.col("ref").alias("quote")).distinct()
    missing = quotes.join(labels.select("win", "quote"), ["win", "quote"], "left_anti").select("win").distinct().withColumn("ref", F.lit(None).cast("string"))
    lost = breaks.join(updates.select("win", "after_gap"), ["win", "after_gap"], "left_anti")
    found = [
        _told(u, "duplicate_scene_ref", F.col("_again") | F.col("_old"), "temp_ref"), _told(u, "duplicate_scene_update", F.col("_gap_again"), "after_gap"),
        _told(u, "duplicate_scene_start", F.col("_start_again"), "starts_at"), _told(u, "unknown_gap_in_scene_update", ~F.col("_gap"), "temp_ref"),
        _told(u, "scene_update_without_break", F.col("_gap") & F.col("_break").isNull(), "temp_ref"), _told(u, "unknown_quote_in_scene_update", ~F.col("_quote"), "temp_ref"),
        _told(lost, "break_without_scene_update", F.lit(True), "after_gap"),
        _told(s, "unknown_character_in_speaker", person & ~F.col("_person"), "temp_ref"), _told(s, "missing_character_evidence", person & ~has, "temp_ref"),
        _told(s, "missing_speaker_name", F.lit(names_required) & ~is_name(F.col("name")) & ~(F.col("name").isNull() & person & F.col("_nameless")), "temp_ref"),
        _told(s, "missing_real_name_evidence", real & (~is_name(F.col("real_name")) | ~has), "temp_ref"), _told(s, "duplicate_speaker_ref", F.col("_again"), "temp_ref"),
        _told(s, "unknown_scene_in_speaker", ~F.col("_scene") & F.col("_made").isNull(), "temp_ref"), _told(s, "unknown_quote_in_speaker", ~F.col("_quote"), "temp_ref"),
        _told(s, "speaker_used_before_creation", F.col("_use").isNotNull() & ~F.col("_allowed") & ~(F.col("_use.assignment").eqNullSafe("NEW") & F.col("_use.quote").eqNullSafe(F.col("first_quote"))), "_used"),
        _told(d, "duplicate_gap_decision", F.col("_again"), "gap"), _told(d, "unknown_gap", ~F.col("_gap"), "gap"),
        x.filter("code IS NOT NULL").select("win", "code", F.col("quote").alias("ref")), _told(missing, "missing_targets", F.lit(True), "ref"),
        _told(_known(needs, targets, "quote", "quote", "_quote"), "unknown_needs_context", ~F.col("_quote"), "quote"),
    ]
    return reduce(DataFrame.unionByName, found)
