"""Runs of repeated words: maximal stretches of words with a period, found by naming and a grid.

Blocks of 1, 2, 4, ... words get names, the same for the same words (Karp, Miller and Rosenberg): a block's name comes
from the pair of its halves' names. How far two places agree, onward or backward, follows from the names by descending
lengths. A stretch of period p and at least 2p words holds two places i and i + p of which i is a multiple of p, so for
each p such neighbours on the grid are extended both ways, and of the stretches found each keeps its smallest period:
a longer period of the same stretch is a multiple of it. Texts of a batch are named together, in numpy; words of
different texts have different names, so nothing reaches from one text into the next. Places whose block occurs once
in a text need no further names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import SPACE, let

#: Fewest words of a run.
LEAST = 12
#: Words of texts that are named together, and neighbours on the grid that are looked at together.
SLICE, GRID = 1 << 19, 1 << 20


def names(words: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
    """Names of the blocks of 2**k words at each place, for each k up to that of the longest block which repeats.

    words: a number for each word; text: the number of each word's text, ascending. Blocks that stand once in a text
    have a name of their own, and so have those which would end beyond the last word.
    """
    n = len(words)
    own = np.arange(n, 2 * n, dtype=np.int32) if n < 1 << 30 else np.arange(n, 2 * n)
    out: list[np.ndarray] = []
    at, key = np.arange(n), text.astype(np.int64) * (int(words.max()) + 1 if n else 1) + words
    size = 1
    while len(at):
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        begins = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        group = np.cumsum(begins) - 1
        repeats = np.bincount(group)[group] > 1
        if not repeats.any():
            break
        level = own.copy()
        level[at[order[repeats]]] = group[repeats]
        out.append(level)
        at = np.sort(at[order[repeats]])
        at = at[at + 2 * size <= n]
        # A block of twice the length repeats only where both halves do.
        at = at[level[at + size] < n]
        key = level[at].astype(np.int64) * n + level[at + size]
        size *= 2
    return out


def agreement(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words from i and from j on (back: before i and before j) are the same; i < j."""
    n, i, j = len(levels[0]), i.copy(), j.copy()
    first = i.copy()
    for k in range(len(levels) - 1, -1, -1):
        size = 1 << k
        if back:
            same = i >= size
            same[same] = levels[k][i[same] - size] == levels[k][j[same] - size]
            i[same] -= size
            j[same] -= size
        else:
            same = j + size <= n
            same[same] = levels[k][i[same]] == levels[k][j[same]]
            i[same] += size
            j[same] += size
    return first - i if back else i - first


def runs(words: np.ndarray, edges: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, by text, start and period. edges: where each text begins, and the last ends."""
    lengths = np.diff(edges)
    text = np.repeat(np.arange(len(lengths)), lengths)
    levels = names(words, text)
    found = [np.zeros((4, 0), np.int64)]
    if levels:
        of, period = _grid_lines(lengths, text, levels[0], edges)
        points = (lengths[of] - 1) // period
        cuts = np.searchsorted(np.cumsum(points), np.arange(0, int(points.sum()) + GRID, GRID), side="right")
        for a, b in zip(cuts[:-1], np.maximum(cuts[1:], cuts[:-1] + 1)):
            found.append(_extended(levels, edges, of[a:b], period[a:b], points[a:b], least))
    t, s, e, p = np.concatenate(found, axis=1)
    order = np.lexsort((p, e, s, t))
    t, s, e, p = t[order], s[order], e[order], p[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    t, s, e, p = t[new], s[new], e[new], p[new]
    order = np.lexsort((p, s, t))
    return t[order], (s - edges[t])[order], (e - s)[order], p[order]


def _grid_lines(lengths: np.ndarray, text: np.ndarray, level: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (text, period) with room for two periods, of texts in which a word repeats."""
    repeats = np.bincount(text[level < len(text)], minlength=len(lengths)) > 0
    most = np.where(repeats, lengths // 2, 0)
    of = np.repeat(np.arange(len(lengths)), most)
    return of, np.arange(1, len(of) + 1) - np.repeat(np.cumsum(most) - most, most)


def _extended(levels: list[np.ndarray], edges: np.ndarray, of: np.ndarray, period: np.ndarray, points: np.ndarray, least: int) -> np.ndarray:
    """Stretches of these periods: (text, start, end, period), the same ones again and again."""
    p = np.repeat(period, points)
    i = np.repeat(edges[of], points) + p * (np.arange(len(p)) - np.repeat(np.cumsum(points) - points, points))
    t = np.repeat(of, points)
    same = levels[0][i] == levels[0][i + p]
    i, p, t = i[same], p[same], t[same]
    onward = agreement(levels, i, i + p)
    # Only the first of a stretch's grid places is extended: one that agrees onward from the place before reaches this one.
    fresh = np.ones(len(i), bool)
    fresh[1:] = ~((t[1:] == t[:-1]) & (p[1:] == p[:-1]) & (i[1:] == i[:-1] + p[1:]) & (onward[:-1] >= p[1:]))
    i, p, t, onward = i[fresh], p[fresh], t[fresh], onward[fresh]
    back = agreement(levels, i, i + p, back=True)
    long = (onward + back >= p) & (onward + back + p >= least)
    return np.stack([t, i - back, i + p + onward, p])[:, long]


def _split(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """All words of texts one after another, and where each text begins, and the last ends."""
    parts = pc.ascii_split_whitespace(texts)
    words, ends = parts.flatten(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
    held = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(held.to_numpy(zero_copy_only=False))])
    return words.filter(held), before[ends]


def _told(texts: pa.StringArray, least: int) -> dict[str, list]:
    """For each text: its runs as (start, length, period), and its words without what runs repeat."""
    words, edges = _split(texts)
    coded = words.dictionary_encode()
    t, start, length, period = runs(coded.indices.to_numpy().astype(np.int64), edges, least)
    # Words of a run after its first period go: +1 where that begins, -1 where the run ends.
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, edges[t] + start + period, 1)
    np.add.at(change, edges[t] + start + length, -1)
    stays = np.cumsum(change[:-1]) == 0
    kept = np.concatenate([[0], np.cumsum(stays)])[edges]
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words.filter(pa.array(stays))), " ").to_pylist()
    cuts = np.searchsorted(t, np.arange(len(texts) + 1)).tolist()
    rows = list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
    return {"runs": [rows[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], "collapsed": collapsed}


RUNS = "runs array<struct<start: long, length: long, period: long>>, collapsed string"


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, runs by start and period, and collapsed (the words that no run repeats, joined by one space) of every row.

    A run is a stretch of at least `least` words and two periods that no neighbouring word extends; period is its
    smallest. Words are numbered from 0. A null or empty text has no runs and an empty collapsed text. Rows with the
    same id or none are looked at each by itself. Extra columns are ignored. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    one = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # Slices of about SLICE words, or of one text.
            sizes = np.cumsum(pc.binary_length(b["t"]).to_numpy(zero_copy_only=False).astype(np.int64) // 4)
            first = 0
            while first < b.num_rows:
                last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + SLICE, side="right")))
                told = _told(b["t"].slice(first, last - first), least)
                found = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in told["runs"]]
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].slice(first, last - first), pa.array(found, pa.list_(one)), pa.array(told["collapsed"], pa.string())], ["doc_id", "runs", "collapsed"]
                )
                first = last

    return rows.mapInArrow(whole, f"doc_id {kind}, {RUNS}")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: the first, then the least period), and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
        F.floor(1000 * F.col("_best.length") / -F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text: one in ten texts by the crc32 h of its id is made periodic from word a on, the others are as they are.

    With g = floor(h / 10), n words, a = g % n and p = 1 + floor((n - a) / (3 + g % 8)), word i >= a becomes word
    a + (i - a) % p. A text without words or without an id stays as it is.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def planted(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1).cast("long") + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        return F.when(n == 0, F.col(text_col)).otherwise(
            let(F.struct(a.alias("a"), p.alias("p")), lambda x: F.array_join(
                F.transform(words, lambda w, i: F.when(i < x["a"], w).otherwise(F.get(words, (x["a"] + (i - x["a"]) % x["p"]).cast("int")))), " "
            ))
        )

    words = F.filter(F.split(F.col(text_col), SPACE), lambda w: w != "")
    return docs.select(F.col(id_col).alias("doc_id"), F.when(h % 10 == 0, let(words, planted)).otherwise(F.col(text_col)).alias("text"))
