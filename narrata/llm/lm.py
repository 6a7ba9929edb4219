"""Language-model scoring with an Elias-Fano n-gram trie.

The trie has a level of words and a level of word pairs, each cut into shards that are built by tasks of their own
and written to the shared folder, from where scoring tasks map them into memory. A shard's sequences are monotone and
Elias-Fano coded: hashes of words; pointers from each context to its successors; successors, made monotone by adding
to each word id a base that depends on the context alone (one more than the last value of the context before). A query
gets its context's range from the pointers, adds the context's base, and searches for the successor in the sequence.

Probabilities: unigrams are smoothed by adding ADD to each count, with one more word for all unknown ones. Pairs are
discounted and interpolated with unigrams; pairs seen less often than `least` are left to the interpolation, which
gets their mass. Logarithms of pairs' probabilities and of contexts' weights are quantised to 256 values a shard.

Counts are gathered from all training rows and merged by shard. The shared folder must be a mounted file system.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import shared_dir, shuffle_partitions

ADD, DISCOUNT, LEAST = 0.1, 0.75, 1
#: Tokens that a task gathers before it sorts and counts them.
FLUSH = 1 << 20
#: White space can't be part of a word, so this is none.
END = xxhash.xxh3_64_intdigest(b" end ")
_ONE = np.uint64(1)


def bits_at(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The width-bit numbers that start at the given bits."""
    if not width:
        return np.zeros(len(at), np.uint64)
    k, r = at >> 6, (at & 63).astype(np.uint64)
    low = words[k] >> r
    high = np.where(r > 0, words[k + 1] << ((np.uint64(64) - r) & np.uint64(63)), np.uint64(0))
    return (low | high) & np.uint64((1 << width) - 1)


def nth_bit(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The place of the r-th set bit (from 0) of each word."""
    x, r = x.copy(), r.astype(np.int64)
    at = np.zeros(len(x), np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        n = np.bitwise_count(x & np.uint64((1 << half) - 1)).astype(np.int64)
        go = r >= n
        r -= np.where(go, n, 0)
        at += np.where(go, half, 0)
        x = np.where(go, x >> np.uint64(half), x)
    return at


class EliasFano:
    """A monotone sequence of numbers below 2**64, in about 2 + log2(largest / length) bits each."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    @staticmethod
    def encode(values: np.ndarray, top: int | None = None) -> dict[str, np.ndarray]:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if top is None and n else top or 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        digits = np.arange(width, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> digits) & _ONE).astype(np.uint8).ravel(), bitorder="little") if n else np.empty(0, np.uint8)
        low = np.r_[low, np.zeros(-len(low) % 8 + 16, np.uint8)].view(np.uint64)
        size = n + (top >> width) + 2
        flags = np.zeros(size + -size % 64 + 64, np.uint8)
        flags[(values >> np.uint64(width)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        ones = np.r_[0, np.cumsum(np.bitwise_count(high).astype(np.int64))]
        return {"meta": np.array([n, width], np.int64), "low": low, "high": high, "ones": ones.astype(np.int64)}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, width = map(int, arrays[f"{name}.meta"])
        return cls(n, width, *(arrays[f"{name}.{k}"] for k in ("low", "high", "ones")))

    def lows(self, i: np.ndarray) -> np.ndarray:
        return bits_at(self.low, i * self.width, self.width)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.ones, i, side="right") - 1
        at = k * 64 + nth_bit(self.high[k], i - self.ones[k])
        return ((at - i).astype(np.uint64) << np.uint64(self.width)) | self.lows(i)

    def _before(self, h: np.ndarray) -> np.ndarray:
        """How many values have high bits below h."""
        i = np.maximum(h - 1, 0)
        k = np.minimum(np.searchsorted(self.zeros, i, side="right") - 1, len(self.high) - 1)
        at = k * 64 + nth_bit(~self.high[k], i - self.zeros[k])
        return np.where(h > 0, np.minimum(at - i, self.n), 0)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Successor search: the place of the first value that isn't below x, or -1 where that value isn't x."""
        x = x.astype(np.uint64)
        high = x >> np.uint64(self.width)
        # High bits beyond the last value's have no zero to search for.
        most = int(self.zeros[-1]) - 1
        inside = high <= np.uint64(max(most, 0))
        h = np.where(inside, high, np.uint64(0)).astype(np.int64)
        lo, end = self._before(h), self._before(np.minimum(h + 1, max(most, 0)))
        end = np.where(h + 1 > most, self.n, end)
        want = x & np.uint64((1 << self.width) - 1)
        hi = end.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            less = open_ & (self.lows(np.minimum(mid, max(self.n - 1, 0))) < want)
            lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        ok = inside & (lo < end)
        ok[ok] &= self.lows(lo[ok]) == want[ok]
        return np.where(ok, lo, -1)


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file, put in place at once, so that a repeated task does no harm."""
    head, at, body = {}, 0, []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        head[name] = [a.dtype.str, len(a), at]
        body.append(a.tobytes() + bytes(-a.nbytes % 16))
        at += len(body[-1])
    first = json.dumps(head).encode()
    first += b" " * (-len(first) % 16)
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        f.write(len(first).to_bytes(16, "little") + first + b"".join(body))
    os.replace(own, path)


def load(path: str) -> dict[str, np.ndarray]:
    raw = np.memmap(path, np.uint8, "r")
    n = int.from_bytes(bytes(raw[:16]), "little")
    head = json.loads(bytes(raw[16 : 16 + n]))
    return {k: raw[16 + n + at : 16 + n + at + size * np.dtype(t).itemsize].view(t) for k, (t, size, at) in head.items()}


def coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, 256 values): each value's nearest of 256 quantiles."""
    if not len(values):
        return np.empty(0, np.uint8), np.zeros(256, np.float32)
    book = np.quantile(values, np.linspace(0, 1, 256)).astype(np.float32)
    right = np.clip(np.searchsorted(book, values), 1, 255)
    return np.where(values - book[right - 1] <= book[right] - values, right - 1, right).astype(np.uint8), book


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def token_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out = [xxhash.xxh3_64_intdigest(w) for w in words]
    out.append(END)
    return np.array(out, np.uint64)


class Trie:
    """The levels in a folder, mapped into memory shard by shard when first asked for."""

    def __init__(self, folder: str):
        self.folder = folder
        self.levels: dict[tuple[str, int], dict] = {}
        meta = json.loads(Path(folder, "words.json").read_text())
        self.shards, self.tokens = meta["shards"], meta["tokens"]
        self.offsets = np.array(meta["offsets"], np.int64)
        self.size = int(self.offsets[-1])

    def shard(self, level: str, k: int) -> dict:
        if (level, k) not in self.levels:
            a = load(f"{self.folder}/{level}-{k}")
            names = {"words": ["hashes"], "pairs": ["pointers", "successors"]}[level]
            self.levels[level, k] = a | {n: EliasFano.of(a, n) for n in names}
        return self.levels[level, k]

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of each of some sorted hashes."""
        out, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        bounds = [shard_start(k, self.shards) for k in range(1, self.shards)]
        cuts = np.searchsorted(hashes, np.array(bounds, np.uint64)) if bounds else np.empty(0, int)
        for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(hashes)], strict=True)):
            if a < b and self.offsets[k] < self.offsets[k + 1]:
                s = self.shard("words", k)
                at = s["hashes"].find(hashes[a:b] - np.uint64(shard_start(k, self.shards)))
                out[a:b] = np.where(at >= 0, at + self.offsets[k], -1)
                counts[a:b] = np.where(at >= 0, self._count(s, np.maximum(at, 0)), 0)
        return out, counts

    @staticmethod
    def _count(s: dict, at: np.ndarray) -> np.ndarray:
        n = s["small"][at].astype(np.int64)
        big = n == 255
        if big.any():
            n[big] = s["big"][np.searchsorted(s["big_at"], at[big])]
        return n

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        shard = np.searchsorted(self.offsets, ids, side="right") - 1
        for k in np.unique(shard):
            out[shard == k] = self._count(self.shard("words", int(k)), ids[shard == k] - self.offsets[k])
        return out

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the smoothed probability of words with these counts, 0 for unknown ones."""
        return np.log10((counts + ADD) / (self.tokens + ADD * (self.size + 1)))

    def pairs(self, context: np.ndarray, word: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """log10 p(word | context). plain: the words' unigram values; ids of -1 are unknown words; sorted by context."""
        out = plain.copy()
        home = context % self.shards
        home[context < 0] = -1
        order = np.argsort(home, kind="stable")
        cuts = np.searchsorted(home[order], np.arange(self.shards + 1))
        for k in range(self.shards):
            at = order[cuts[k] : cuts[k + 1]]
            if not len(at):
                continue
            s = self.shard("pairs", k)
            c = context[at] // self.shards
            start, end = s["pointers"][c].astype(np.int64), s["pointers"][c + 1].astype(np.int64)
            some = start < end
            at, start, end, c = at[some], start[some], end[some], c[some]
            if not len(at):
                continue
            out[at] += s["weight_book"][s["weights"][c]]
            base = np.where(start > 0, s["successors"][np.maximum(start - 1, 0)] + _ONE, np.uint64(0))
            known = word[at] >= 0
            at, end, base, start = at[known], end[known], base[known], start[known]
            found = s["successors"].find(base + word[at].astype(np.uint64))
            ok = (found >= start) & (found < end)
            out[at[ok]] = s["pair_book"][s["pairs"][found[ok]]]
        return out


@lru_cache(maxsize=2)
def trie_at(folder: str) -> Trie:
    return Trie(folder)


def shard_start(k: int, shards: int) -> int:
    return -(-(k << 64) // shards)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Token hashes of texts, some documents at a time."""
    held: list[np.ndarray] = []
    size = 0
    for b in batches:
        for t in b["t"]:
            held.append(token_hashes(t.as_py()))
            size += len(held[-1])
            if size >= FLUSH:
                yield held
                held, size = [], 0
    if held:
        yield held


_BLOB = "shard int, keys binary, counts binary"


def _blobs(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """A row for each shard: sorted keys as differences, byte plane by byte plane, and counts likewise."""
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    rows = []
    for k in range(shards):
        at = order[cuts[k] : cuts[k + 1]]
        if len(at):
            rows.append((k, planes(np.diff(keys[at], prepend=np.uint64(0))), planes(counts[at].astype(np.uint64))))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["shard", "keys", "counts"])


def planes(x: np.ndarray) -> bytes:
    used = max(1, -(-int(x.max()).bit_length() // 8))
    return bytes([used]) + x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :used].T.tobytes()


def unplaned(data: bytes) -> np.ndarray:
    used = data[0]
    a = np.frombuffer(data, np.uint8, offset=1).reshape(used, -1)
    out = np.zeros((a.shape[1], 8), np.uint8)
    out[:, :used] = a.T
    return out.view("<u8").ravel()


def _merge_blobs(t: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    keys = np.concatenate([np.cumsum(unplaned(x), dtype=np.uint64) for x in t["keys"].to_pylist()])
    counts = np.concatenate([unplaned(x) for x in t["counts"].to_pylist()]).astype(np.int64)
    return t["shard"][0].as_py(), *merged(keys, counts)


def train(texts: DataFrame, shards: int | None = None, least: int = LEAST) -> str:
    """Builds the trie of texts' column t; returns its folder."""
    spark = texts.sparkSession
    root = shared_dir(spark)
    if ":" in root and not root.startswith("file:"):
        raise ValueError(f"the shared folder must be mounted to be mapped into memory: {root}")
    folder = f"{'/' + root.removeprefix('file:').lstrip('/')}/trie-{uuid.uuid4().hex}"
    os.makedirs(folder)
    shards = shards or shuffle_partitions(spark)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(batches):
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            starts = np.array([shard_start(k, shards) for k in range(1, shards)], np.uint64)
            yield from _blobs(keys, counts, np.searchsorted(starts, keys, side="right"), shards)

    def build_words(t: pa.Table) -> pa.Table:
        k, keys, counts = _merge_blobs(t)
        first = shard_start(k, shards)
        large = np.flatnonzero(counts >= 255)
        coded_keys = EliasFano.encode(keys - np.uint64(first), shard_start(k + 1, shards) - first)
        save(f"{folder}/words-{k}", {f"hashes.{n}": a for n, a in coded_keys.items()} | {"small": np.minimum(counts, 255).astype(np.uint8), "big_at": large, "big": counts[large]})
        return pa.table({"shard": pa.array([k], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64())})

    built = texts.mapInArrow(words, _BLOB).groupBy("shard").applyInArrow(build_words, "shard int, n long, tokens long").collect()
    sizes = {r["shard"]: r["n"] for r in built}
    offsets = [0]
    for k in range(shards):
        offsets.append(offsets[-1] + sizes.get(k, 0))
    if offsets[-1] >= (1 << 32) - 2:
        raise ValueError("pairs hold words in 32 bits each: the texts have more distinct words")
    Path(folder, "words.json").write_text(json.dumps({"shards": shards, "offsets": offsets, "tokens": sum(r["tokens"] for r in built)}))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_at(folder)
        for held in _gathered(batches):
            distinct, back = np.unique(np.concatenate(held), return_inverse=True)
            ids = trie.ids(distinct)[0][back]
            before = contexts(ids, held, trie.size)
            keys, counts = np.unique((before.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64), return_counts=True)
            yield from _blobs(keys, counts, (keys >> np.uint64(32)).astype(np.int64) % shards, shards)

    def build_pairs(t: pa.Table) -> pa.Table:
        k, keys, counts = _merge_blobs(t)
        trie = trie_at(folder)
        context, word = (keys >> np.uint64(32)).astype(np.int64) // shards, (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        all_contexts = (trie.size - k) // shards + 1 if trie.size >= k else 0
        sums = np.bincount(context, counts, all_contexts)
        kept = counts >= least
        context, word, counts = context[kept], word[kept], counts[kept]
        share = (counts - DISCOUNT) / sums[context]
        weight = 1 - np.bincount(context, share, all_contexts)
        p = share + weight[context] * 10 ** trie.unigram(trie.counts_of(word))
        starts = np.searchsorted(context, np.arange(all_contexts + 1))
        # A context's base is one more than the last value before it: its own last word adds to what came before.
        has = np.flatnonzero(np.diff(starts))
        last = word[starts[has + 1] - 1] if len(has) else np.empty(0, np.int64)
        base = np.zeros(all_contexts, np.int64)
        base[has] = np.r_[0, np.cumsum(last + 1)[:-1]] if len(has) else 0
        pair_codes, pair_book = coded(np.log10(p))
        weight_codes, weight_book = coded(np.log10(weight[has]))
        weights = np.zeros(all_contexts, np.uint8)
        weights[has] = weight_codes
        arrays = {f"pointers.{n}": a for n, a in EliasFano.encode(starts).items()} | {f"successors.{n}": a for n, a in EliasFano.encode(base[context] + word).items()}
        save(f"{folder}/pairs-{k}", arrays | {"pairs": pair_codes, "pair_book": pair_book, "weights": weights, "weight_book": weight_book})
        return pa.table({"shard": pa.array([k], pa.int32()), "n": pa.array([len(word)], pa.int64())})

    if offsets[-1]:
        done = {r["shard"] for r in texts.mapInArrow(pairs, _BLOB).groupBy("shard").applyInArrow(build_pairs, "shard int, n long").collect()}
    else:
        done = set()
    for k in set(range(shards)) - done:
        contexts_here = (offsets[-1] - k) // shards + 1 if offsets[-1] >= k else 0
        none = np.zeros(0, np.int64)
        arrays = {f"pointers.{n}": a for n, a in EliasFano.encode(np.zeros(contexts_here + 1, np.int64)).items()} | {f"successors.{n}": a for n, a in EliasFano.encode(none).items()}
        save(f"{folder}/pairs-{k}", arrays | {"pairs": none.astype(np.uint8), "pair_book": np.zeros(256, np.float32), "weights": np.zeros(contexts_here, np.uint8), "weight_book": np.zeros(256, np.float32)})
    return folder


def contexts(ids: np.ndarray, held: list[np.ndarray], begin: int) -> np.ndarray:
    """The id before each token; `begin` before a document's first."""
    out = np.r_[begin, ids[:-1]]
    out[np.r_[0, np.cumsum([len(x) for x in held])[:-1]]] = begin
    return out


def score(texts: DataFrame, folder: str) -> DataFrame:
    """texts' columns but t, with n_tokens, n_known, train_tokens, base_score, score."""
    keep = [c for c in texts.columns if c != "t"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_at(folder)
        for b in batches:
            out: list[np.ndarray] = []
            for held in _gathered([b]):
                sizes = np.array([len(x) for x in held])
                distinct, back = np.unique(np.concatenate(held), return_inverse=True)
                ids, counts = trie.ids(distinct)
                plain = trie.unigram(counts)
                token = ids[back]
                context = contexts(token, held, trie.size)
                # Unknown words are told apart from each other by nothing, so pairs are looked up once each.
                key = ((context + 1).astype(np.uint64) << np.uint64(32)) | (token + 1).astype(np.uint64)
                _, first, where = np.unique(key, return_index=True, return_inverse=True)
                p = trie.pairs(context[first], token[first], plain[back][first])[where]
                at = np.r_[0, np.cumsum(sizes)[:-1]]
                out.append(np.stack([sizes, np.add.reduceat((token >= 0).astype(float), at), np.add.reduceat(plain[back], at), np.add.reduceat(p, at)]))
            if not out:
                continue
            n, known, base, total = np.concatenate(out, axis=1)
            cols = [pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(n), trie.tokens, np.int64)), pa.array(base), pa.array(total)]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), *cols], [*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return texts.mapInArrow(run, f"{schema}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out_scores(docs: DataFrame, folds: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    The model learns from rows whose crc32 of the id (as text) isn't 0 modulo folds. A null text is empty: its one
    token is the end. A row without an id is trained on. Rows that repeat count as often as they occur. Extra columns
    are ignored. Empty tables give no rows.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))
    texts = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("t"))
    folder = train(texts.filter(~F.col("held_out")).select("t"))
    return score(texts, folder)
