"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph (a piece between line feeds that is not blank) hashes to a wide vector; a document's fingerprint is the
sum of its paragraphs' vectors, lane by lane, modulo a power of two. Sums commute, so the order of paragraphs does
not matter, and paragraphs are put in or taken out by adding or subtracting their vectors (`combine`).

The vector has two parts. EQ_LANES lanes modulo 2**32 come from hashes of the whole paragraph, two lanes from each; the
hashes have seeds of their own, so none follows from another. Unequal multisets collide with a probability near
2**-256, as long as nobody looks for collisions: the hash isn't a cryptographic one. LIKE_LANES lanes modulo 2**32 sum +1 or -1 for each three-word
shingle of the paragraph; no text has so many shingles that they wrap, so they are read as signed numbers, and inner
products of two fingerprints estimate the inner product of the shingle multisets, which gives a likeness from 0 to 1.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.llm.common import SPACE, let, shuffle_partitions

EQ_LANES, LIKE_LANES, SHINGLE = 8, 128, 3
#: Cuts between ranges of ids that are searched as one.
GROUP = 64
_PAIRS = 0x0000000100000001
_LOW32 = 0xFFFFFFFF
_LIKE_MOD = 1 << 32


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda p: F.length(F.trim(F.regexp_replace(p, SPACE, " "))) > 0)


def shingle_hashes(text: Column) -> Column:
    """64-bit hashes of the three-word shingles of every paragraph; a shorter paragraph is one shingle."""

    def of_paragraph(p: Column) -> Column:
        words = F.filter(F.split(p, SPACE), lambda w: w != "")
        hashes = F.transform(words, lambda w: F.xxhash64(w))
        return let(
            hashes,
            lambda h: F.when(F.size(h) < SHINGLE, F.array(F.xxhash64(h))).otherwise(
                F.transform(
                    F.sequence(F.lit(0), F.size(h) - SHINGLE),
                    lambda i: F.xxhash64(h[i], h[i + 1], h[i + 2]),
                )
            ),
        )

    return F.flatten(F.transform(paragraphs(text), of_paragraph))


def equality_lanes(text: Column) -> Column:
    def lane(lines: Column, k: int) -> Column:
        half = lambda p: F.shiftrightunsigned(F.xxhash64(F.lit(k // 2), p), 32 * (k % 2)).bitwiseAND(F.lit(_LOW32))
        return F.aggregate(lines, F.lit(0).cast("long"), lambda acc, p: (acc + half(p)).bitwiseAND(F.lit(_LOW32)))

    return let(paragraphs(text), lambda lines: F.array(*[lane(lines, k) for k in range(EQ_LANES)]))


def likeness_sums(h: str = "h") -> list[Column]:
    """Aggregates over shingle hashes: the number of shingles, and packed pairs of lane counts."""
    first, second = F.col(h), F.xxhash64(F.col(h))
    out = [F.count(F.lit(1)).alias("units")]
    for k in range(LIKE_LANES // 2):
        source = first if k < 32 else second
        out.append(F.sum(F.shiftrightunsigned(source, k % 32).bitwiseAND(F.lit(_PAIRS))).alias(f"s{k}"))
    return out


def likeness_lanes(units: Column) -> Column:
    """Signed lane sums, from -2**31 to 2**31 - 1, of the packed counts."""
    lanes = []
    for k in range(LIKE_LANES // 2):
        packed = F.col(f"s{k}")
        lanes += [packed.bitwiseAND(F.lit(_LOW32)), F.shiftrightunsigned(packed, 32)]
    return F.transform(F.array(*lanes), lambda c: _signed(2 * c - units))


def _signed(x: Column) -> Column:
    half = _LIKE_MOD // 2
    return (F.pmod(x + half, F.lit(_LIKE_MOD)) - half).cast("int")


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint lanes struct(eq, lanes, units) of a with b's paragraphs put in (sign 1) or taken out (-1)."""
    return F.struct(
        F.zip_with(a["eq"], b["eq"], lambda x, y: F.pmod(x + sign * y, F.lit(1 << 32))).alias("eq"),
        F.zip_with(a["lanes"], b["lanes"], lambda x, y: _signed(x.cast("long") + sign * y)).alias("lanes"),
        (a["units"] + sign * b["units"]).alias("units"),
    )


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1; 1 for equal fingerprints, and only for those."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    equal = (a["units"] == b["units"]) & (a["eq"] == b["eq"]) & (a["lanes"] == b["lanes"])
    norm = dot(a["lanes"], a["lanes"]) + dot(b["lanes"], b["lanes"])
    estimate = F.when(norm > 0, 2 * dot(a["lanes"], b["lanes"]) / norm).otherwise(F.lit(0.0))
    empty = (a["units"] == 0) | (b["units"] == 0)
    return F.when(equal, 1.0).when(empty, 0.0).otherwise(F.least(F.lit(0.999999), F.greatest(F.lit(0.0), estimate)))


def render(fp: Column) -> Column:
    """Fixed-width hexadecimal form."""
    wide = lambda xs, mod, n: F.array_join(F.transform(xs, lambda x: F.lpad(F.hex(F.pmod(x.cast("long"), F.lit(mod))), n, "0")), "")
    return F.lower(F.concat(wide(fp["eq"], 1 << 32, 8), F.lpad(F.hex(fp["units"]), 16, "0"), wide(fp["lanes"], _LIKE_MOD, 8)))


def _rank(rows: DataFrame) -> Column:
    """A whole number for doc_id that doesn't fall where doc_id rises: numbers themselves, of strings seven bytes after what all share."""
    if dict(rows.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint"):
        return F.col("doc_id").cast("long")
    text = F.col("doc_id").cast("string")
    least, most = (x or "" for x in rows.agg(F.min(text), F.max(text)).first())
    shared = len(os.path.commonprefix([least.encode(), most.encode()]))
    return F.conv(F.rpad(F.hex(F.substring(text.cast("binary"), shared + 1, 7)), 14, "0"), 16, 10).cast("long")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, rn, own, doc_id, text, next_text): every row with the next row's text by descending id, then text.

    The last row's next is the first. Ids are cut into ranges of about equal counts; the first row of each range is
    also put at the end of the range before, so that one shuffle serves. Null ids come last; null texts are empty.
    Rows with own false are those second copies; they have no next.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rank = _rank(rows)
    n = 4 * shuffle_partitions(docs.sparkSession)
    cuts = sorted(set(rows.agg(F.percentile_approx(rank, [k / n for k in range(1, n)], min(100 * n, 1_000_000))).first()[0] or []))
    # Range 0 has the smallest ids and the nulls. Cuts are searched in groups: those that lie below as a whole, then within one.
    at = F.lit(cuts) if cuts else F.array().cast("array<bigint>")
    whole = F.lit(cuts[GROUP - 1 :: GROUP]) if len(cuts) >= GROUP else F.array().cast("array<bigint>")
    below = lambda xs: F.size(F.filter(xs, lambda c: c < F.col("_rank")))
    rows = rows.withColumn("_rank", rank).withColumn("_g", GROUP * below(whole))
    bucket = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.col("_g") + below(F.slice(at, F.col("_g") + 1, F.lit(GROUP))))
    rows = rows.withColumn("bucket", bucket).drop("_rank", "_g")
    top = {r["bucket"]: r["top"] for r in rows.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(top)
    into = {b: order[(k + 1) % len(order)] for k, b in enumerate(order)}
    homes = F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("late")))
    if order:
        every = range(order[-1] + 1)
        tops = F.get(F.array(*[F.lit(top.get(b)) for b in every]).cast(f"array<{dict(rows.dtypes)['doc_id']}>"), F.col("bucket"))
        homes = F.when(
            tops.eqNullSafe(F.col("doc_id")),
            F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("late")), F.struct(F.get(F.lit([into.get(b, 0) for b in every]), F.col("bucket")).alias("b"), F.lit(1).alias("late"))),
        ).otherwise(homes)
    placed = rows.withColumn("home", F.explode(homes)).select("doc_id", "text", F.col("home.b").alias("bucket"), F.col("home.late").alias("late"))
    w = Window.partitionBy("bucket").orderBy("late", F.col("doc_id").desc_nulls_last(), "text")
    return placed.select(
        "bucket", F.row_number().over(w).alias("rn"), (F.col("late") == 0).alias("own"), "doc_id", "text",
        F.lead("text").over(w).alias("next_text"),
    )


def edited(text: Column, next_text: Column) -> Column:
    cut = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - cut), F.substring(next_text, F.lit(1), cut))


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Nulls: a null text is empty; a null id comes after the others. An empty text has a fingerprint of zeros and no
    likeness to any text but an empty one. Repeated rows are rows of their own, next to each other; ids may be numbers
    or strings. Rows that share an id, or have none, are ordered in one task. Extra columns are ignored. An empty table gives no rows.
    """
    rows = with_next(docs, id_col, text_col)
    edit = F.coalesce(F.when(F.col("own"), edited(F.col("text"), F.col("next_text"))), F.lit(""))
    # A row's facts go as numbers along with its shingles, so that the texts are shuffled once and nothing is joined.
    sha = lambda k: F.conv(F.substring(F.sha2(F.col("e").cast("binary"), 256), 8 * k + 1, 8), 16, 10).cast("long")
    facts = F.concat(
        F.array(F.col("own").cast("long"), F.length("text").cast("long"), *map(sha, range(8))),
        equality_lanes(F.col("text")), equality_lanes(F.col("e")),
    )
    none = F.lit(None).cast("array<bigint>")
    versions = F.array(
        F.struct(F.lit(0).alias("v"), F.col("text").alias("t"), none.alias("m")),
        F.struct(F.lit(1).alias("v"), F.col("e").alias("t"), none.alias("m")),
        F.struct(F.lit(2).alias("v"), F.lit("").alias("t"), facts.alias("m")),
    )
    n_facts = 10 + 2 * EQ_LANES
    folded = (
        rows.withColumn("e", edit)
        .select("bucket", "rn", "doc_id", F.explode(versions).alias("x"))
        .select("bucket", "rn", F.when(F.col("x.v") == 2, F.col("doc_id")).alias("doc_id"), F.col("x.v").alias("v"), F.col("x.m").alias("m"), F.explode(F.when(F.col("x.v") == 2, F.array(F.lit(0).cast("long"))).otherwise(shingle_hashes(F.col("x.t")))).alias("h"))
        .groupBy("bucket", "rn", "v")
        .agg(F.max("doc_id").alias("doc_id"), *likeness_sums(), *[F.sum(F.col("m")[k]).alias(f"m{k}") for k in range(n_facts)])
        .select("bucket", "rn", "doc_id", "v", "units", likeness_lanes(F.col("units")).alias("lanes"), F.array(*[F.col(f"m{k}") for k in range(n_facts)]).alias("m"))
        .groupBy("bucket", "rn")
        .agg(F.max("doc_id").alias("doc_id"), *[F.max(F.when(F.col("v") == v, F.struct("lanes", "units"))).alias(f"u{v}") for v in (0, 1)], F.max(F.when(F.col("v") == 2, F.col("m"))).alias("m"))
    )
    zero = F.struct(F.array_repeat(F.lit(0), LIKE_LANES).alias("lanes"), F.lit(0).cast("long").alias("units"))
    whole = lambda at, u: F.struct(F.slice("m", at, EQ_LANES).alias("eq"), F.coalesce(F.col(u), zero)["lanes"].alias("lanes"), F.coalesce(F.col(u), zero)["units"].alias("units"))
    w = Window.partitionBy("bucket").orderBy("rn")
    joined = folded.withColumn("a", whole(11, "u0")).withColumn("b", whole(11 + EQ_LANES, "u1")).withColumn("n", F.lead("a").over(w))
    hexed = F.lower(F.concat(*[F.lpad(F.hex(F.col("m")[2 + k]), 8, "0") for k in range(8)]))
    return joined.filter(F.col("m")[0] == 1).select(
        "doc_id", F.col("m")[1].alias("n_chars"), hexed.alias("edited_sha256"),
        render(F.col("a")).alias("fingerprint"), render(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("n")).alias("near_next"),
    )
