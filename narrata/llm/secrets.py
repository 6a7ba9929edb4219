"""Secret scans with an incremental blob ledger.

Every version of a text is addressed by its content (SHA-256). The ledger holds, for each blob and rule version, that
it was scanned and what was found. A scan takes only (blob, rule version) pairs that aren't in the ledger, one copy
of each, and findings are joined back to every path that has the blob.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.llm.common import named, spread_join, stash, unused

RULES_VERSION = "2"
#: Kinds in the order in which spans at the same place are listed: kind -> (pattern, group that must be long, least length).
#: The lengths of the first three are part of the patterns where that can't change what else matches.
KINDS: dict[str, tuple[str, int, int]] = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
    "forge": (r"\b(?:gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{60,})", 0, 40),
    "chat": (r"\bxox[abprs]-[A-Za-z0-9-]{20,}", 0, 24),
    "cloud": (r"\bAIza[0-9A-Za-z_-]{35}", 0, 39),
    "jwt": (r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 34),
    "pem": (r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----", 0, 20),
}
BASE = ("assign", "access", "hex")
FINDING = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob string, rules string, found {FINDING}"

_compiled = [(k, kind, re.compile(p, re.ASCII), group, least) for k, (kind, (p, group, least)) in enumerate(KINDS.items())]


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; for each kind leftmost and non-overlapping."""
    out = []
    for k, kind, pattern, group, least in _compiled:
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def scan_new(versions: DataFrame, ledger: DataFrame, text_col: str = "text", rules: str = RULES_VERSION) -> DataFrame:
    """Ledger rows for the blobs of versions that this rule version hasn't seen, each scanned once."""
    texts = versions.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("blob", blob_of(F.col("text")))
    seen = ledger.filter(F.col("rules") == rules).select("blob")
    # One copy of each blob first, so that the copies of one don't meet in a join.
    unseen = texts.groupBy("blob").agg(F.first("text").alias("text")).join(seen, "blob", "left_anti")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t)] for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["blob"], pa.array(found, kind)], ["blob", "found"])

    scanned = unseen.mapInArrow(scan, f"blob string, found {FINDING}")
    return scanned.select("blob", F.lit(rules).alias("rules"), "found")


def scan(docs: DataFrame, ledger: DataFrame | None = None, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(docs with blob and found, the new ledger rows). ledger: what earlier scans returned, none at first.

    A null text is an empty blob. Equal texts share a blob and are scanned once; every row gets its findings, rows
    that repeat too. A ledger row that repeats counts once; rows of other rule versions count for nothing. Existing
    columns stay (blob and found replace any of those names). Empty tables give no rows.
    """
    return _with_findings(docs.drop("blob", "found"), F.col(text_col), "blob", "found", ledger)


def _with_findings(docs: DataFrame, text: Column, blob: str, found: str, ledger: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(docs with the columns blob and found, the new ledger rows); the names are not among those of docs."""
    old = empty_ledger(docs.sparkSession) if ledger is None else ledger
    new = stash(scan_new(docs.select(text.alias("text")), old), "secret-ledger")
    known = old.filter(F.col("rules") == RULES_VERSION).select("blob", "found").unionByName(new.select("blob", "found")) if ledger is not None else new
    out = docs.withColumn(blob, blob_of(text))
    key, hit = unused("_key", out), unused("_hit", out)
    hits = known.filter(F.size("found") > 0).select(F.col("blob").alias(key), F.col("found").alias(hit)).dropDuplicates([key])
    out = spread_join(out, hits, F.col(blob), key)
    return out.withColumn(found, F.coalesce(F.col(hit), F.array().cast(FINDING))).drop(key, hit), new


def rendered(found: Column, kinds: tuple[str, ...] | None = None) -> Column:
    kept = found if kinds is None else F.filter(found, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """docs with every found span replaced by mark; overlapping spans as one. n_chars, if there, is set anew.

    All columns stay as they are, whatever their names. A null text stays null, rows that repeat stay as many, and
    empty tables give no rows.
    """
    blob, found = unused("blob", docs), unused("found", docs)
    scanned, _ = _with_findings(docs, F.col(text_col), blob, found, None)

    def put(state: Column, x: Column) -> Column:
        gap = F.greatest(x["start"], state["at"])
        fresh = x["start"] >= state["at"]
        text = F.concat(state["out"], F.substring(F.col(text_col), state["at"] + 1, F.greatest(x["start"] - state["at"], F.lit(0))), F.when(fresh, F.lit(mark)).otherwise(F.lit("")))
        return F.struct(text.alias("out"), F.greatest(gap, x["end"]).alias("at"))

    clean = F.aggregate(
        F.col(found), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), put,
        lambda s: F.concat(s["out"], F.substring(F.col(text_col), s["at"] + 1, F.greatest(F.length(text_col) - s["at"], F.lit(0)))),
    )
    hit = F.size(found) > 0
    fixed = scanned.withColumn(text_col, F.when(hit, clean).otherwise(F.col(text_col)))
    if "n_chars" in docs.columns:
        fixed = fixed.withColumn("n_chars", F.when(hit, F.length(text_col).cast("long")).otherwise(F.col("n_chars")))
    return fixed.select(*named(docs))
