"""Corrections by people: cleaning up what older ones left to review, taking one back, and what goes with deleted books.

annotations: id, book, quote_id, version, stale, user_locked, source, speaker. corrections: id, target_type, target_id,
applied_version, undone_by, speaker (before the correction), at (order). histories: annotation_id, revision,
correction_id. items: item, quote_id, reason, status, annotation_version, candidates (JSON). jobs: book, state. All ids
are unique in their tables, and a quote has at most one annotation. Nothing is changed in place: results say what becomes of each row.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

#: States in which a job forbids changes to its book, corrections of a quote alone, and of what holds quotes (fixed values).
ACTIVE = ["QUEUED", "RUNNING", "PAUSING"]
LOCAL, STRUCTURAL = ["QUOTE", "ANNOTATION"], ["SCENE", "GAP"]


def _is(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def busy(jobs: DataFrame) -> DataFrame:
    """book, busy: the books that a job works on, or is about to."""
    return jobs.filter(F.col("state").isin(ACTIVE)).select("book", F.lit(True).alias("busy")).distinct()


def cause(candidates: Column) -> Column:
    """The correction_id in a JSON object; null where it is no text, or the JSON none."""
    found = F.try_variant_get(F.try_parse_json(candidates), "$.correction_id", "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(F.try_parse_json(candidates), "$.correction_id", "string"))


def cleaned(items: DataFrame, annotations: DataFrame, corrections: DataFrame, histories: DataFrame, jobs: DataFrame) -> DataFrame:
    """book, item, annotation_id, verdict, restored, version, written of the open items about stale annotations.

    verdict: refused (a job works on the book), preserved, or resolved: pending, caused by the correction of another
    quote of the book, about the annotation's present version, which is a model's, unlocked and never was changed with
    its scene or gap. restored: the annotation isn't stale any more and has a new version (version, else the present
    one); written: its state before is to be written to the histories, which don't have it. Items of one annotation are
    taken in order of their names, so that of those about its present version only the first can restore it.
    """
    a = annotations.select("book", "quote_id", F.col("id").alias("annotation_id"), "version", "stale", "user_locked", "source")
    x = items.filter("reason = 'STALE_DEPENDENCY' AND status <> 'RESOLVED'").select("item", "quote_id", "status", "annotation_version", cause(F.col("candidates")).alias("_cause")).join(a, "quote_id")
    targets = annotations.select(F.col("quote_id").alias("_target"), F.col("book").alias("_book"))
    causes = corrections.select(F.col("id").alias("_cause"), "target_type", F.col("target_id").alias("_target")).join(targets, "_target")
    structural = histories.join(corrections.filter(F.col("target_type").isin(STRUCTURAL)).select(F.col("id").alias("correction_id")), "correction_id", "left_semi").select("annotation_id", F.lit(True).alias("_structural")).distinct()
    had = histories.select("annotation_id", F.col("revision").alias("version"), F.lit(True).alias("_had")).distinct()
    x = x.join(causes, "_cause", "left").join(structural, "annotation_id", "left").join(had, ["annotation_id", "version"], "left").join(busy(jobs), "book", "left")
    fit = _is(F.col("status") == "PENDING") & _is(F.col("target_type").isin(LOCAL)) & _is(F.col("_book") == F.col("book")) & _is(F.col("_target") != F.col("quote_id")) & ~_is(F.col("user_locked")) & _is(F.col("source") == "MODEL") & ~_is(F.col("_structural"))
    x = x.withColumns({"_fit": fit & ~_is(F.col("busy")), "_now": _is(F.col("annotation_version") == F.col("version"))})
    # The first item that restores an annotation moves its version on for those after it.
    first = x.filter("_fit AND _now AND stale").groupBy("annotation_id").agg(F.min("item").alias("_first"))
    x = x.join(first, "annotation_id", "left")
    restored = _is(F.col("item") == F.col("_first"))
    later = _is((F.col("item") > F.col("_first")) & (F.col("annotation_version") == F.col("version") + 1))
    resolved = F.col("_fit") & F.when(_is(F.col("stale")), restored | later).otherwise(F.col("_now"))
    verdict = F.when(F.col("busy"), "refused").when(resolved, "resolved").otherwise("preserved")
    return x.select("book", "item", "annotation_id", verdict.alias("verdict"), restored.alias("restored"), (F.col("version") + restored.cast("int")).alias("version"), (restored & ~_is(F.col("_had"))).alias("written"))


def cleanup_summary(done: DataFrame) -> DataFrame:
    """book, refused, resolved_records, preserved_records, restored_quotes of cleaned()."""
    of = lambda v: F.count_if(F.col("verdict") == v)
    return done.groupBy("book").agg(F.max(F.col("verdict") == "refused").alias("refused"), of("resolved").alias("resolved_records"), of("preserved").alias("preserved_records"), F.count_if("restored").alias("restored_quotes"))


def undone(requests: DataFrame, corrections: DataFrame, annotations: DataFrame) -> DataFrame:
    """id, verdict, annotation_id, version, speaker for requests (id) to take back corrections of quotes.

    verdict: no_correction, not_local, already_undone, no_annotation, changed_since (the annotation isn't at the
    version that the correction left), or undone; then version and speaker are those after, else null. Requests for one
    annotation are taken in order of their corrections: after one of them is granted, its version has moved on, so
    others that name a version are refused. Corrections that name none are granted one after the other.
    """
    c = corrections.select("id", "target_type", F.col("target_id").alias("quote_id"), "applied_version", "undone_by", F.col("speaker").alias("_before"), "at")
    a = annotations.select("quote_id", F.col("id").alias("annotation_id"), F.col("version").alias("_now"))
    x = requests.select("id").distinct().join(c.withColumn("_c", F.lit(True)), "id", "left").join(a, "quote_id", "left")
    wrong = (
        F.when(F.col("_c").isNull(), "no_correction").when(~_is(F.col("target_type").isin(LOCAL)), "not_local").when(F.coalesce("undone_by", F.lit("")) != "", "already_undone").when(F.col("annotation_id").isNull(), "no_annotation")
    )
    x = x.withColumn("_wrong", wrong)
    # One pass over the requests in order, which keeps how far the version of the present annotation has moved.
    fit = x.filter("_wrong IS NULL").select("id", "annotation_id", "at", (F.col("applied_version") - F.col("_now")).cast("double").alias("_needs"))

    def run(frames):
        last, n = None, 0
        for f in frames:
            rows = []
            for id_, annotation, needs in zip(f["id"], f["annotation_id"], f["_needs"], strict=True):
                n = n if annotation == last else 0
                ok = pd.isna(needs) or needs == n
                last, n = annotation, n + ok
                rows.append((id_, ok, n))
            yield pd.DataFrame(rows, columns=["id", "_ok", "_n"])

    inputs = fit.repartition("annotation_id").sortWithinPartitions("annotation_id", "at", "id")
    folded = inputs.mapInPandas(run, StructType([fit.schema["id"], StructField("_ok", BooleanType()), StructField("_n", LongType())]))
    done = x.join(folded, "id", "left")
    ok = _is(F.col("_ok"))
    verdict = F.when(F.col("_wrong").isNotNull(), F.col("_wrong")).when(ok, "undone").otherwise("changed_since")
    return done.select("id", verdict.alias("verdict"), "annotation_id", F.when(ok, F.col("_now") + F.col("_n")).alias("version"), F.when(ok, F.col("_before")).alias("speaker"))


def deleted(books: DataFrame, jobs: DataFrame, corrections: DataFrame, **held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(book, verdict: refused or deleted) of the books to delete, and id, book of the corrections that go with them.

    held: what corrections refer to (quotes, gaps, scenes, annotations), each with book and id. A correction goes if
    its target is any of what a deleted book holds; a book that a job works on stays with all that refers to it.
    """
    verdicts = books.select("book").distinct().join(busy(jobs), "book", "left").select("book", F.when(F.col("busy"), "refused").otherwise("deleted").alias("verdict"))
    gone = verdicts.filter("verdict = 'deleted'").select("book")
    targets = reduce(DataFrame.unionByName, [x.join(gone, "book", "left_semi").select("book", F.col("id").alias("target_id")) for x in held.values()])
    return verdicts, corrections.select("id", "target_id").join(targets, "target_id").groupBy("id").agg(F.min("book").alias("book"))
