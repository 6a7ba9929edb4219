"""Encoding and decoding with the merge-type vocabularies of sentencepiece models.

A word's symbols are merged by an agenda: all adjacent pairs that make up a piece lie in a heap, the best score first
and of equal scores the leftmost, and a merge puts the two pairs with its neighbours on the agenda. An entry whose
symbols have changed meanwhile is passed over. Many short words are merged together: each has its agenda in a row of an
array, and all take their first entries at once. Since no piece has a space mark after another character, and none a line
feed, what stands before a space mark or around a line feed merges by itself: texts are cut there into words. Each distinct word of a slice of
text is merged once, and checked against the library before its ids are used.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

#: The mark that stands for a space, as the models have it (fixed).
MARK = "▁"
#: Kinds of pieces in a model file (fixed).
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Characters of a section of a text, and of the sections that are encoded together; words whose ids a worker keeps.
SECTION, SLICE, KEPT_WORDS = 1 << 20, 4 << 20, 400_000
#: Symbols of the words that are merged together; longer words have a heap each.
WIDTHS = (6, 9, 12, 16, 24, 40)
NEVER = np.iinfo(np.int32).max

_words = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
_seam = re.compile(f"(?<=[^{MARK}])(?={MARK})|(?<=\n)|(?=\n)")


class Vocabulary:
    """The pieces and scores of a model of merges, with encoding and decoding by their definition."""

    def __init__(self, path: str):
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules, trained, kinds = model.normalizer_spec, model.trainer_spec, {p.type for p in model.pieces}
        if trained.model_type != 2 or not trained.byte_fallback or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("this takes models of merges with bytes for what is unknown, and without pieces of users")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or trained.treat_whitespace_as_suffix:
            raise ValueError("this takes models that keep the text as it is and put one space before it")
        self.score = {p.piece: (p.score, i) for i, p in enumerate(model.pieces) if p.type == NORMAL}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.score):
            raise ValueError("this takes models whose pieces have spaces only at their start, and no line feeds")
        self.bos, self.eos = trained.bos_id, trained.eos_id
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.is_byte = [p.type == BYTE for p in model.pieces]
        self.controls = [i for i, p in enumerate(model.pieces) if p.type == CONTROL]
        #: What each id stands for, before the first space mark is taken off.
        self.bytes = [
            b"" if p.type == CONTROL else trained.unk_surface.encode() if p.type == UNKNOWN
            else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(MARK, " ").encode()
            for p in model.pieces
        ]
        #: For merging many words: symbols by number, the pairs that make a piece, the number of the piece, and its rank by score.
        self.symbols = sorted({c for p in self.score for c in p} | set(self.score))
        self.number = {s: k for k, s in enumerate(self.symbols)}
        ranks = {x: k for k, x in enumerate(sorted({-score for score, _ in self.score.values()}))}
        pairs = sorted(
            (self.number[a] * len(self.symbols) + self.number[b], self.number[p], ranks[-score])
            for p, (score, _) in self.score.items() for k in range(1, len(p)) if (a := p[:k]) in self.number and (b := p[k:]) in self.number
        )
        self.pairs, self.made, self.rank = (np.array(x, t) for x, t in zip(zip(*pairs, strict=True), (np.int64, np.int32, np.int32), strict=True))
        ids = [self._ids(s) for s in self.symbols]
        self.id_counts, self.id_table = np.array(list(map(len, ids))), np.array([i for x in ids for i in x], "<u4")
        self.unknown = next((i for i, p in enumerate(model.pieces) if p.type == UNKNOWN), None)

    def merge(self, word: str) -> list[str]:
        """The pieces of a word by the agenda; unknown characters stay by themselves."""
        symbols, n = list(word), len(word)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, str]] = []

        def meet(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (found := self.score.get(symbols[a] + symbols[b])):
                heapq.heappush(agenda, (-found[0], a, b, symbols[a] + symbols[b]))

        for k in range(n - 1):
            meet(k, k + 1)
        while agenda:
            _, a, b, piece = heapq.heappop(agenda)
            if not symbols[a] or not symbols[b] or len(symbols[a]) + len(symbols[b]) != len(piece):
                continue
            symbols[a], symbols[b] = piece, ""
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            meet(before[a], a)
            meet(a, after[a])
        return [s for s in symbols if s]

    def _ids(self, symbol: str) -> list[int]:
        found = self.score.get(symbol)
        return [found[1]] if found else [self.byte[b] for b in symbol.encode()]

    def encode(self, word: str) -> list[int]:
        return [i for s in self.merge(word) for i in self._ids(s)]

    def encode_all(self, words: list[str]) -> list[bytes]:
        """The ids (little-endian, unsigned, 32 bits) of many words."""
        out: list[bytes] = [b""] * len(words)
        number, narrow = self.number.get, np.searchsorted(WIDTHS, [len(w) for w in words])
        for k, width in enumerate(WIDTHS):
            of = np.flatnonzero(narrow == k)
            rows = [[number(c, -2) for c in words[i]] for i in of.tolist()]
            strange = {j for j, r in enumerate(rows) if -2 in r}  # characters in no piece have no number
            for j in strange:
                out[of[j]] = np.asarray(self.encode(words[of[j]]), "<u4").tobytes()
            known = [j for j in range(len(rows)) if j not in strange]
            if known:
                symbols = np.full((len(known), width), -1, np.int64)
                lengths = np.array([len(rows[j]) for j in known])
                symbols[np.arange(width) < lengths[:, None]] = [x for j in known for x in rows[j]]
                for j, ids in zip(known, self._ids_of(self._merged(symbols)), strict=True):
                    out[of[j]] = ids
        for i in np.flatnonzero(narrow == len(WIDTHS)).tolist():
            out[i] = np.asarray(self.encode(words[i]), "<u4").tobytes()
        return out

    def _entries(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs, and what they make; NEVER for pairs that make no piece."""
        key = np.where((a >= 0) & (b >= 0), a * len(self.symbols) + b, -1)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        hit = self.pairs[at] == key
        return np.where(hit, self.rank[at], NEVER), self.made[at]

    def _merged(self, symbols: np.ndarray) -> np.ndarray:
        """Rows of symbols, -1 after the last, with all merges done: in each step, every row's entry of least rank, the leftmost."""
        out, left = symbols.copy(), np.arange(len(symbols))
        rank, made = self._entries(symbols[:, :-1], symbols[:, 1:])
        place = np.arange(symbols.shape[1])
        while True:
            first = rank.argmin(axis=1)
            on = rank[np.arange(len(rank)), first] < NEVER
            out[left[~on]] = symbols[~on]
            if not on.any():
                return out
            symbols, rank, made, first, left = symbols[on], rank[on], made[on], first[on], left[on]
            row = np.arange(len(first))
            symbols[row, first] = made[row, first]
            # What comes after the merged pair moves up by one.
            from_ = np.minimum(place + (place > first[:, None]), len(place) - 1)
            symbols = np.take_along_axis(symbols, from_, 1)
            symbols[:, -1] = -1
            from_ = np.minimum(from_[:, :-1], len(place) - 2)
            rank, made = np.take_along_axis(rank, from_, 1), np.take_along_axis(made, from_, 1)
            rank[:, -1] = NEVER
            for k in (first - 1, first):
                ok = (k >= 0) & (k < len(place) - 1)
                r, k = row[ok], k[ok]
                rank[r, k], made[r, k] = self._entries(symbols[r, k], symbols[r, k + 1])

    def _ids_of(self, symbols: np.ndarray) -> list[bytes]:
        flat, held = symbols[symbols >= 0], (symbols >= 0).sum(axis=1)
        sizes = self.id_counts[flat]
        begins, ends = (np.cumsum(self.id_counts) - self.id_counts)[flat], np.cumsum(sizes)
        blob = self.id_table[np.repeat(begins - (ends - sizes), sizes) + np.arange(int(sizes.sum()))].tobytes()
        edges = 4 * np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(held)])]
        return [blob[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    def decode(self, ids: list[int], first: bool = True) -> bytes:
        """The text of ids, in UTF-8. first: these are a text's first ids, so that the space put before it goes."""
        begin, end = 0, len(ids)
        while begin < end and ids[begin] in self.controls:
            begin += 1
        while end > begin and ids[end - 1] in self.controls:
            end -= 1
        ids = ids[begin:end]
        if any(c in ids for c in self.controls):  # these end a run of bytes
            return self._mended(ids, first)
        out = b"".join(map(self.bytes.__getitem__, ids))
        if first and out[:1] == b" " and not self.is_byte[start := next(i for i in ids if self.bytes[i])] and start != self.unknown:
            out = out[1:]
        try:
            out.decode()
        except UnicodeDecodeError:
            return self._mended(ids, first)
        return out

    def _mended(self, ids: list[int], first: bool) -> bytes:
        """As decode(), with each byte of a run of bytes that is in no character replaced."""
        out, k = [], 0
        while k < len(ids):
            if not self.is_byte[ids[k]]:
                text = self.bytes[ids[k]]
                if first and text:
                    text = text[1:] if text[:1] == b" " and ids[k] != self.unknown else text
                    first = False
                out.append(text)
                k += 1
                continue
            end = next((e for e in range(k, len(ids)) if not self.is_byte[ids[e]]), len(ids))
            run, at = b"".join(self.bytes[i] for i in ids[k:end]), 0
            while at < len(run):
                size = next((s for s in range(1, 5) if _whole(run[at : at + s])), 0)
                out.append(run[at : at + size] if size else "�".encode())
                at += size or 1
            first, k = False, end
        return b"".join(out)


def _whole(part: bytes) -> bool:
    try:
        return len(part.decode()) == 1
    except UnicodeDecodeError:
        return False


class Encoder:
    """Ids of many texts: distinct words are merged once, checked, and kept while there is room."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known: dict[str, bytes] = {}

    def new(self, words: list[str]) -> dict[str, bytes]:
        """The ids (little-endian, unsigned, 32 bits) of words by the agenda, each held against the library's."""
        out = dict(zip(words, self.vocabulary.encode_all(words), strict=True))
        # A line feed keeps the space that the library puts before a text from the word: ids of that space and of the line feed come first.
        for w, ids in zip(words, self.library.encode(["\n" + w.replace(MARK, " ") for w in words], num_threads=1), strict=True):
            if array("I", ids[2:]).tobytes() != out[w]:
                raise ValueError(f"the agenda's ids differ from the library's for {w[:100]!r}")
        return out

    def words(self, words: list[str], counts: list[int]) -> list[bytes]:
        """The ids of distinct words that occur so often; words that occur once aren't kept."""
        known = self.known
        new = self.new([w for w in words if w not in known])
        out = [known[w] if w in known else new[w] for w in words]
        often = {w: i for w, i, n in zip(words, out, counts, strict=True) if n > 1}
        if len(known) + len(often) > KEPT_WORDS:
            self.known = often
        else:
            known.update(often)
        return out

    def sections(self, sections: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of sections one after another, and where each begins, and the last ends."""
        found = [_words.findall(s) for s in sections]
        coded = pa.array([w for f in found for w in f], pa.string()).dictionary_encode()
        at = coded.indices.to_numpy()
        words = self.words(coded.dictionary.to_pylist(), np.bincount(at, minlength=len(coded.dictionary)).tolist())
        sizes = np.fromiter(map(len, words), np.int64, len(words)) // 4
        begins, n = np.cumsum(sizes) - sizes, sizes[at]
        ends = np.cumsum(n)
        where = np.repeat(begins[at] - (ends - n), n) + np.arange(int(n.sum()))
        edges = np.concatenate([[0], ends])[np.cumsum([0, *map(len, found)])]
        return np.frombuffer(b"".join(words), "<u4")[where], edges


def sections(text: str, size: int = SECTION) -> Iterator[str]:
    """A text with its marks, cut between words into sections of about this size; one word isn't cut."""
    marked = MARK + text.replace(" ", MARK) if text else ""
    start = 0
    while start < len(marked):
        seam = _seam.search(marked, start + size)
        end = seam.start() if seam else len(marked)
        yield marked[start:end]
        start = end


@lru_cache(maxsize=2)
def encoder_for(path: str) -> Encoder:
    return Encoder(path)


def encoded(texts: list[str], path: str) -> Iterator[tuple[int, bool, np.ndarray]]:
    """(number of the text, whether this is its first section, ids) for all sections of texts, in order; without begin and end."""
    encoder = encoder_for(path)
    held: list[tuple[int, bool, str]] = []
    room = SLICE

    def flush() -> Iterator[tuple[int, bool, np.ndarray]]:
        ids, edges = encoder.sections([s for _, _, s in held])
        for (k, first, _), a, b in zip(held, edges[:-1], edges[1:], strict=True):
            yield k, first, ids[a:b]

    for k, text in enumerate(texts):
        for j, s in enumerate(sections(text)):
            held.append((k, j == 0, s))
            room -= len(s)
            if room <= 0:
                yield from flush()
                held, room = [], SLICE
    if held:
        yield from flush()


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: its ids with begin and end, and what they decode to.

    model: the path of a model file, as executors have it. A null text is empty: its ids are begin and end. Rows with
    the same id or none are encoded each by itself. Extra columns are ignored. An empty table gives no rows. Digests are
    taken section by section, so a very long text needs no more memory than its own and a section's.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder_for(model).vocabulary
        begin, end = (np.asarray([i], "<u4").tobytes() for i in (vocabulary.bos, vocabulary.eos))
        for b in batches:
            n = [2] * b.num_rows
            ids = [hashlib.sha256(begin) for _ in n]
            decoded = [hashlib.sha256() for _ in n]
            for k, first, part in encoded(b["t"].to_pylist(), model):
                n[k] += len(part)
                ids[k].update(part.tobytes())
                decoded[k].update(vocabulary.decode(part.tolist(), first))
            for h in ids:
                h.update(end)
            digests = [pa.array([h.hexdigest() for h in hs], pa.string()) for hs in (ids, decoded)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), *digests], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(whole, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def ids(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids of every row, with begin and end. Cases as in round_trip()."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder_for(model).vocabulary
        for b in batches:
            out = [[vocabulary.bos] for _ in range(b.num_rows)]
            for k, _, part in encoded(b["t"].to_pylist(), model):
                out[k] += part.tolist()
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([[*x, vocabulary.eos] for x in out], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return rows.mapInArrow(whole, f"doc_id {kind}, ids array<int>")


def decoded(coded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of every row of ids. Null ids give an empty text; bytes that are no characters give U+FFFD."""
    rows = coded.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder_for(model).vocabulary
        for b in batches:
            texts = [vocabulary.decode(x).decode() for x in b["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(whole, f"doc_id {kind}, text string")
