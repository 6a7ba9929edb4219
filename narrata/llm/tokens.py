"""Token counts by finite-state compilation of a BPE tokenizer.

`Transducer` compiles merges into a deterministic transducer over the symbols of a word. Its states stand for all
that later symbols can depend on: the last tokens of the encodings of the word's prefixes, as far back as a token can
still reach. Each transition carries the change of the number of tokens, so a path's sum is the count. States and
transitions are built when a word first needs them, and kept.

Why that works: a sequence of tokens is what BPE makes of a text if, and only if, that holds for each two neighbours
alone. So the encoding of a prefix that ends in token t is the encoding of what comes before t, with t after it, and
just one t that fits its neighbour exists for each prefix.

White space resets the automaton, whatever state it was in, so a chunk of text maps any state to a state by three
things: the count between its first and last white space, and the pieces at both ends, which join with the neighbours'.
Such maps compose associatively (`compose`), and the chunks of a long text are composed in a scan over all chunks.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points of a chunk, chunks that one step of the scan composes, and words whose counts a worker keeps.
CHUNK, FAN, KEPT_WORDS = 1 << 15, 64, 600_000
#: States that a worker keeps; beyond it, it compiles anew.
KEPT_STATES = 200_000

#: Which characters make up the pieces of a word, as the tokenizer file has it (fixed).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White space by the Unicode property, as the tokenizer library's patterns take it (fixed).
BLANK = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_blank, _held = re.compile(f"[{BLANK}]+"), re.compile(f"[^{BLANK}]+")


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: printable Latin-1 characters for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Transducer:
    """Counts the tokens of words given as tuples of symbols, the last of which bears the end mark."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.rank = {tuple(m): r for r, m in enumerate(merges)}
        self.parts: dict[str, tuple[str, str]] = {}
        for a, b in merges:
            self.parts.setdefault(a + b, (a, b))
        self.vocab = vocab
        self.prefixes = {t[:k] for t in vocab for k in range(1, len(t.removesuffix("</w>")))}
        self.fits: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.steps: list[dict[str, tuple[int, int]]] = []
        self.newest: list[tuple[bytes, int]] = []
        self.start = self._state(())

    def merge(self, symbols: tuple[str, ...]) -> list[str]:
        """BPE by its definition: again and again, the pair of least rank, the leftmost first."""
        out = list(symbols)
        while len(out) > 1:
            r, k = min((self.rank.get((a, b), sys.maxsize), k) for k, (a, b) in enumerate(zip(out, out[1:])))
            if r == sys.maxsize:
                break
            out[k : k + 2] = [out[k] + out[k + 1]]
        return out

    def _symbols(self, token: str) -> tuple[str, ...]:
        stem = token.removesuffix("</w>")
        return (*stem[:-1], stem[-1] + "</w>") if stem != token and stem else tuple(token)

    def _real(self, token: str) -> bool:
        """Whether BPE makes this token of its own symbols."""
        if token not in self.whole:
            self.whole[token] = token in self.vocab and self.merge(self._symbols(token)) == [token]
        return self.whole[token]

    def _fit(self, a: str, b: str) -> bool:
        if (a, b) not in self.fits:
            self.fits[a, b] = self.merge(self._symbols(a) + self._symbols(b)) == [a, b]
        return self.fits[a, b]

    def _state(self, key: tuple) -> int:
        if key not in self.states:
            self.states[key] = len(self.keys)
            self.keys.append(key)
            self.steps.append({})
            token = key[-1][1] if key else ""
            self.newest.append((self.vocab.get(token, 0).to_bytes(4, "little"), len(self._symbols(token))))
        return self.states[key]

    def _step(self, state: int, symbol: str) -> tuple[int, int]:
        """A state's key lists (symbol, last token, tokens so far relative to the newest) of the latest prefixes."""
        key = self.keys[state]
        tail, found = symbol, None
        for back in range(len(key) + 1):
            if back:
                tail = key[-back][0] + tail
            if back == len(key) and (not key or key[0][3]):  # the token starts the word
                if self._real(tail):
                    found = (tail, 1 - (key[-1][2] if key else 0))
            elif back < len(key):
                before = key[-back - 1]
                if self._real(tail) and self._fit(before[1], tail):
                    found = (tail, before[2] + 1 - key[-1][2])
            if found:
                break
        if not found:
            raise ValueError(f"no encoding for {symbol!r} after {[k[0] for k in key]}")
        token, change = found
        longer = [*key, (symbol, token, (key[-1][2] if key else 0) + change, not key)]
        # Forget prefixes after which no token can start that reaches beyond this symbol.
        tail, keep = "", 1
        for back in range(1, len(longer) + 1):
            tail = longer[-back][0] + tail
            if tail in self.prefixes:
                keep = back + 1
        longer = longer[-keep:]
        base = 0 if longer[0][3] else longer[0][2]
        keep = [(s, t, n - base, first) for s, t, n, first in longer]
        return self._state(tuple(keep)), change

    def encode(self, word: list[str]) -> bytes:
        """The ids (little-endian, 32 bits) of a word: its last token, then that of what comes before it, and so on."""
        state, steps, newest, last = self.start, self.steps, self.newest, []
        for symbol in word:
            step = steps[state].get(symbol)
            if step is None:
                step = steps[state][symbol] = self._step(state, symbol)
            state = step[0]
            last.append(newest[state])
        out, at = [], len(word)
        while at:
            token, size = last[at - 1]
            out.append(token)
            at -= size
        out.reverse()
        return b"".join(out)

    def count(self, word: list[str]) -> int:
        state, total = self.start, 0
        for symbol in word:
            step = self.steps[state].get(symbol)
            if step is None:
                step = self.steps[state][symbol] = self._step(state, symbol)
            state, more = step
            total += more
        return total


def lowered(text: str) -> str:
    """Composed, then lower case of each character by itself."""
    return text.lower() if text.isascii() else "".join(map(str.lower, unicodedata.normalize("NFC", text)))


class Counter:
    """Counts the tokens of texts without a word-piece model's help: normaliser, pieces and transducer."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        splits = [x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or [x["pattern"]["Regex"] for x in splits] != [PIECES]:
            raise ValueError("this compiles word-end BPE with the known pieces only")
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, self.specials)))
        self.bytes = byte_symbols()
        self.pieces = regex.compile(PIECES)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.transducer = Transducer(model["vocab"], merges)
        self.known: dict[str, int] = {}

    def split(self, part: str) -> list[str]:
        part = lowered(part)
        return [part] if part.isalpha() else self.pieces.findall(part)

    def symbols(self, piece: str) -> list[str]:
        out = list(piece) if piece.isascii() and piece.isprintable() else [self.bytes[b] for b in piece.encode()]
        out[-1] += "</w>"
        return out

    def _piece(self, piece: str) -> int:
        return self.transducer.count(self.symbols(piece))

    def word(self, word: str) -> int:
        """Tokens of a string without white space."""
        n = self.known.get(word)
        if n is None:
            parts = self.special.split(word) if "<|" in word else [word]
            n = len(parts) - 1
            for part in parts:
                n += sum(map(self._piece, self.split(part)))
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            if len(self.transducer.keys) > KEPT_STATES:
                self.transducer.forget()
            self.known[word] = n
        return n

    def ids(self, word: str) -> bytes:
        """Token ids (little-endian, 32 bits) of a string without white space."""
        out = []
        parts = self.special.split(word) if "<|" in word else [word]
        marks = self.special.findall(word) if len(parts) > 1 else []
        for k, part in enumerate(parts):
            if k:
                out.append(self.specials[marks[k - 1]].to_bytes(4, "little"))
            out += [self.transducer.encode(self.symbols(x)) for x in self.split(part)]
        if len(self.transducer.keys) > KEPT_STATES:
            self.transducer.forget()
        return b"".join(out)

    def words(self, words: list[str]) -> int:
        known = self.known.get
        counts = [known(w) for w in words]
        if None in counts:
            counts = [self.word(w) if n is None else n for n, w in zip(counts, words, strict=True)]
        return sum(counts)

    def chunk(self, text: str) -> tuple[bool, str, int, str]:
        """The chunk's map: (whether it has white space, what comes before it, tokens between, what comes after)."""
        first = _blank.search(text)
        if not first:
            return False, text, 0, ""
        tail = text
        head = text[: first.start()]
        at = len(text)
        while at and not _blank.match(text[at - 1]):
            at -= 1
        tail = text[at:]
        return True, head, self.words(words_of(text[first.end() : at])), tail


def words_of(text: str) -> list[str]:
    # str.split also splits at four control characters that aren't white space here.
    return _held.findall(text) if re.search("[\x1c-\x1f]", text) else text.split()


def compose(counter: Counter, maps: Iterator[tuple[bool, str, int, str]]) -> tuple[bool, str, int, str]:
    """The map of chunks one after another."""
    cut, head, count, tails = False, [], 0, []
    for has, h, n, t in maps:
        (tails if cut else head).append(h)
        if has:
            if cut:
                count += counter.word("".join(tails))
            cut, tails, count = True, [t], count + n
    return cut, "".join(head), count, "".join(tails)


def total(counter: Counter, m: tuple[bool, str, int, str]) -> int:
    """The tokens of the whole text with this map."""
    return m[2] + sum(counter.word(x) for x in (m[1], m[3]) if x)


@lru_cache(maxsize=2)
def counter_for(path: str) -> Counter:
    return Counter(path)


MAP = "cut boolean, head string, n long, tail string"


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row. tokenizer: the path of a tokenizer file, as executors have it.

    A null text is empty and has no tokens. Rows with the same id or none are counted each by itself. Extra columns
    are ignored. Empty tables give no rows.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    out = "doc_id, n_bytes, n_tokens, over_limit".split(", ")
    kind = texts.schema["doc_id"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(tokenizer)
        for b in batches:
            n = [total(counter, compose(counter, (counter.chunk(t[k : k + CHUNK]) for k in range(0, len(t), CHUNK)))) for t in b["t"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_bytes"], pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    sized = texts.withColumn("n_bytes", F.octet_length("t").cast("long"))
    counted = sized.filter(F.length("t") <= CHUNK).mapInArrow(whole, f"doc_id {kind}, n_bytes long, n_tokens long")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(tokenizer)
        for b in batches:
            maps = [counter.chunk(t) for t in b["t"].to_pylist()]
            cols = [pa.array(c, k) for c, k in zip(zip(*maps, strict=True), (pa.bool_(), pa.string(), pa.int64(), pa.string()), strict=True)] if maps else []
            if maps:
                yield pa.RecordBatch.from_arrays([*(b[c] for c in ("row", "doc_id", "n_bytes", "k")), *cols], ["row", "doc_id", "n_bytes", "k", "cut", "head", "n", "tail"])

    def fold(batch: pa.Table) -> pa.Table:
        counter = counter_for(tokenizer)
        rows = sorted(batch.to_pylist(), key=lambda r: r["k"])
        m = compose(counter, ((r["cut"], r["head"], r["n"], r["tail"]) for r in rows))
        first = rows[0]
        row = {"row": first["row"], "doc_id": first["doc_id"], "n_bytes": first["n_bytes"], "k": first["k"] // FAN} | dict(zip(("cut", "head", "n", "tail"), m, strict=True))
        return pa.Table.from_pylist([row], schema=batch.schema)

    # A row is told by its id and text, with a number among rows that are alike in both.
    long = sized.filter(F.length("t") > CHUNK).withColumn("row", F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("t")).cast("binary"), 256))
    alike = long.groupBy("row").agg(F.count(F.lit(1)).alias("copies"), F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.first("t").alias("t"))
    starts = F.sequence(F.lit(0), F.floor((F.length("t") - 1) / CHUNK).cast("int"))
    pieces = alike.select("row", "copies", "doc_id", "n_bytes", "t", F.explode(starts).alias("k"))
    pieces = pieces.select("row", "doc_id", "n_bytes", F.col("k").cast("long").alias("k"), F.substring("t", F.col("k") * CHUNK + 1, F.lit(CHUNK)).alias("t"))
    schema = f"row string, doc_id {kind}, n_bytes long, k long, {MAP}"
    maps = pieces.mapInArrow(chunks, schema)
    for _ in range(2):
        maps = maps.groupBy("row", F.floor(F.col("k") / FAN)).applyInArrow(fold, schema)
    maps = maps.groupBy("row").applyInArrow(fold, schema)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(tokenizer)
        for b in batches:
            n = [total(counter, (r["cut"], r["head"], r["n"], r["tail"])) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b["row"], b["doc_id"], b["n_bytes"], pa.array(n, pa.int64())], ["row", "doc_id", "n_bytes", "n_tokens"])

    scanned = maps.mapInArrow(finish, f"row string, doc_id {kind}, n_bytes long, n_tokens long")
    copies = long.groupBy("row").agg(F.count(F.lit(1)).alias("copies"))
    scanned = scanned.join(copies, "row").withColumn("_", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    both = counted.unionByName(scanned.select("doc_id", "n_bytes", "n_tokens"))
    return both.withColumn("over_limit", F.col("n_tokens") > limit).select(*out)
