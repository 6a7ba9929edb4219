"""Best-two-fit packing of tokenized documents into sequences of a fixed length.

Which documents share a sequence depends on their lengths only, so the packing is made for the histogram of lengths
(at most `limit` entries): each bin is filled greedily with the longest piece that fits, then its smallest piece is
replaced by two unpacked ones that together fit the gap, so widened, more tightly. A bin's list of lengths is used for
as many bins as the counts allow. Pieces are then numbered within their length, and every piece finds its sequence
and offset by its number.

Documents may have positions, as in a mix of sources. Then ranges of positions are packed one after the other, each by a
plan of its own, and within a range the pieces of a length are numbered by position. A range has about RANGE_SEQUENCES
sequences, whatever the size of the corpus, so that the mix is followed as closely at any size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from narrata.llm.common import running_totals, stash
from narrata.llm.mixing import numbered
from narrata.llm.tokens import words_of

LIMIT, END_ID, KEPT_WORDS = 4096, 1, 600_000
#: Bytes of text whose words are encoded together, words of one call of the tokenizer.
SLICE, CALL = 16 << 20, 2000
#: Full sequences that a range of positions has on average, at least. There are as many ranges as the input needs.
RANGE_SEQUENCES = 2048


class Ids:
    """Token ids of texts by the tokenizer library, with the ids of words kept.

    White space always separates tokens, so a word's ids don't depend on what stands around it. Texts are taken in
    slices. Of a slice, each distinct word that isn't known is encoded once, many in one call, and the ids of all its
    words are gathered.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}

    def encoded(self, words: list[str]) -> dict[str, bytes]:
        """The ids (little-endian, unsigned, 32 bits) of each word."""
        out: dict[str, bytes] = {}
        for k in range(0, len(words), CALL):
            part = words[k : k + CALL]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.fromiter((a for a, _ in got.offsets), np.int64, len(got.offsets))
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            cuts = 4 * np.searchsorted(starts, np.concatenate([[0], ends]))
            blob = np.asarray(got.ids, "<u4").tobytes()
            out.update((w, blob[a:b]) for w, a, b in zip(part, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        return out

    def of(self, words: list[str], counts: list[int]) -> list[bytes]:
        """The ids of distinct words that occur so often; words that occur once are not kept."""
        known = self.known
        new = self.encoded([w for w in words if w not in known])
        out = [known[w] if w in known else new[w] for w in words]
        often = {w: i for w, i, n in zip(words, out, counts, strict=True) if n > 1}
        if len(known) + len(often) > KEPT_WORDS:
            self.known = often
        else:
            known.update(often)
        return out

    def slice(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids (unsigned, 32 bits) one text after another, and where each text begins, and the last ends."""
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens tell case, nothing else does
            texts = pc.ascii_lower(texts)
        split = pc.utf8_split_whitespace(texts)
        if pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():  # these four don't separate words here
            split = pa.array([words_of(x) for x in texts.to_pylist()], pa.list_(pa.string()))
        coded = split.flatten().dictionary_encode()
        at = coded.indices.to_numpy()
        words = self.of(coded.dictionary.to_pylist(), np.bincount(at, minlength=len(coded.dictionary)).tolist())
        sizes = np.fromiter(map(len, words), np.int64, len(words)) // 4
        flat = np.frombuffer(b"".join(words), "<u4")
        begins = np.cumsum(sizes) - sizes
        n = sizes[at]
        ends = np.cumsum(n)
        where = np.repeat((begins[at] - (ends - n)).astype(np.int32), n)
        where += np.arange(len(where), dtype=np.int32)
        edges = np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return flat[where], edges


@lru_cache(maxsize=2)
def ids_for(path: str) -> Ids:
    return Ids(path)


def pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", at: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces; only documents over limit are cut.

    at: a column of positions, which is added as `at`.
    """
    position = (F.col(at) if at else F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), position.alias("at"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    end = np.asarray([END_ID], "<u4")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "at"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_for(tokenizer)
        for b in batches:
            # Slices of bounded text, or of one text.
            sizes = np.cumsum(pc.binary_length(b["t"]).to_numpy(zero_copy_only=False).astype(np.int64))
            first = 0
            while first < b.num_rows:
                start = int(sizes[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(sizes, start + SLICE, side="right")))
                row, piece, length, crc = [], [], [], []
                data, edges = ids.slice(b["t"].slice(first, last - first))
                for k in range(last - first):
                    own = np.append(data[edges[k] : edges[k + 1]], end)
                    for at in range(0, len(own), limit):
                        part = own[at : at + limit]
                        row.append(first + k)
                        piece.append(at // limit)
                        length.append(len(part))
                        crc.append(zlib.crc32(part))
                p = np.asarray(piece, "int32")
                rows_of = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].take(rows_of), pa.array(p), pa.array(p.astype("int64") * limit), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), b["at"].take(rows_of)], names
                )
                first = last

    made = rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, at long")
    return made if at else made.drop("at")


def best_two_fit(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[list[int], int]]:
    """(lengths of a bin, number of such bins), from how often each length from 1 to limit occurs."""
    left = np.zeros(limit + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    out: list[tuple[list[int], int]] = []
    top = limit
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return out
        lengths = np.flatnonzero(left)  # ascending
        used: dict[int, int] = {}
        bin_, gap = [], limit

        def free(n: int) -> int:
            return int(left[n]) - used.get(n, 0)

        def take(n: int, sign: int = 1) -> None:
            nonlocal gap
            used[n] = used.get(n, 0) + sign
            gap -= sign * n
            bin_.append(n) if sign > 0 else bin_.remove(n)

        take(top)
        k = len(lengths) - 1
        while gap and k >= 0:
            k = min(k, int(np.searchsorted(lengths, gap, side="right")) - 1)
            if k < 0:
                break
            n = int(lengths[k])
            if free(n) > 0:
                take(n)
            else:
                k -= 1
        if gap and len(bin_) > 1:
            small = min(bin_)
            room = gap + small
            take(small, -1)
            fit = best_pair(lengths, left, used, small, room)
            for n in fit or (small,):
                take(n)
        times = min(int(left[n]) // u for n, u in used.items() if u)
        for n, u in used.items():
            left[n] -= u * times
        out.append((bin_, times))


def best_pair(lengths: np.ndarray, left: np.ndarray, used: dict[int, int], more: int, room: int) -> tuple[int, int] | None:
    """Two free lengths with the largest sum up to room, if it is over `more`."""
    spent = np.zeros_like(left)
    for n, u in used.items():
        spent[n] = u
    free = lengths[(left - spent)[lengths] > 0]
    free = free[free < room]
    if not len(free):
        return None
    mate = np.searchsorted(free, room - free, side="right") - 1
    ok = mate >= 0
    # A length can be its own mate only if two are left; else the next smaller one is taken.
    alone = ok & (mate == np.arange(len(free))) & ((left - spent)[free] < 2)
    mate = mate - alone
    ok = mate >= 0
    if not ok.any():
        return None
    sums = np.where(ok, free + free[np.maximum(mate, 0)], -1)
    k = int(np.argmax(sums))
    return (int(free[k]), int(free[mate[k]])) if sums[k] > more else None


def places(plan: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, how many, first sequence, of each bin, offset): where the pieces of each length go."""
    out, sequence, at = [], 0, {}
    for bin_, times in plan:
        offset = 0
        where: dict[int, list[int]] = {}
        for n in bin_:
            where.setdefault(n, []).append(offset)
            offset += n
        for n, offsets in where.items():
            for o in offsets:
                out.append((n, at.get(n, 0), times, sequence, o))
                at[n] = at.get(n, 0) + times
        sequence += times
    return out


def planned(hist: pa.Table, limit: int) -> pa.Table:
    """The places in one range, from its rows of (range, length, how often it occurs)."""
    counts = dict(zip(hist["length"].to_pylist(), hist["count"].to_pylist(), strict=True))
    cols = list(zip(*places(best_two_fit(counts, limit)), strict=True))
    out = {"_r": [hist["_r"][0].as_py()] * len(cols[0])} | dict(zip(("_length", "_first", "_n", "_sequence", "offset"), cols, strict=True))
    return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})


def pack(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", at: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document.

    A null text is empty: its one piece is the end id. Repeated rows and rows without an id are packed like any
    others. Extra columns are ignored. Empty tables give no rows. at: a column of positions from 0 that sequences follow;
    rows without a position come last.
    """
    made = stash(pieces(docs, tokenizer, limit, id_col, text_col, at), "pieces")
    group, position, top, ranges = F.lit(0).cast("long"), None, 0, 1
    if at:
        most, tokens = made.agg(F.max("at"), F.sum("length")).first()
        top, ranges = (most or 0) + 1, max(1, (tokens or 0) // (limit * RANGE_SEQUENCES))
        position = F.coalesce("at", F.lit(top))
        group = F.floor(position / (top // ranges + 1))
    grouped = made.withColumn("_r", group)
    # Of each range, the counts of at most `limit` lengths make its plan, wherever they meet.
    hist = grouped.groupBy("_r", F.col("length").cast("long").alias("length")).count()
    plans = hist.groupBy("_r").applyInArrow(lambda t: planned(t, limit), "_r long, _length long, _first long, _n long, _sequence long, offset long")
    plans = stash(plans, "packing-plans")
    base = running_totals(plans.groupBy("_r").agg(F.max(F.col("_sequence") + F.col("_n")).alias("_size")), "_r", "_size", "_base")
    # For each range and length, arrays that are searched by number.
    where = plans.join(base, "_r").groupBy((F.col("_r") * (limit + 1) + F.col("_length")).alias("_l")).agg(
        F.array_sort(F.collect_list(F.struct("_first", (F.col("_sequence") + F.col("_base")).alias("_sequence"), "offset"))).alias("_w")
    )
    if ranges == 1:  # at most `limit` rows; with more ranges, no length of one has more rows than its range
        where = F.broadcast(where)
    key = F.struct("doc_id", "piece", "ids_crc32")
    of_length = grouped.withColumn("_g_l", F.col("_r") * (limit + 1) + F.col("length"))
    ranked = numbered(of_length, "_g_l", key, "_k", position, top).join(where, F.col("_g_l") == F.col("_l"))
    slot = F.element_at(F.filter("_w", lambda x: x["_first"] <= F.col("_k")), -1)
    placed = ranked.withColumn("_s", slot)
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_s._sequence") + F.col("_k") - F.col("_s._first")).alias("sequence_id"), F.col("_s.offset").alias("offset"),
    )
