"""N-gram Jaccard self-join by vertical partitioning, and the components of its links.

The global order of n-grams is that of a 64-bit hash, and it is cut into fragments twice. Documents with the same set
are one class from the start.

Wide fragments count: each class has one row for each wide fragment that it has n-grams in. Candidate pairs meet their
rows fragment by fragment, the overlap in each is counted by itself, and the counts are summed for the pair.

Narrow fragments find the candidates. Two classes whose sets differ in at most D n-grams agree in all but D fragments,
so with more than D, some fragment is the same in both, and its n-grams are a key that both have. How many fragments
there are depends on the size band, and D on the threshold. Fragments form blocks of bounded size. As D n-grams are
spread over all blocks, some block of k of the F fragments differs in at most D * k / F n-grams, and in that block at least one
fragment agrees. So a key counts only if the parity sketches of its block don't show a larger difference: a sketch
holds, for each bit, whether an odd number of the block's n-grams falls on it, so sketches differ in no more bits than
blocks differ in n-grams. Where a block has so many empty fragments that the agreeing ones might all be empty, its
first n-grams in the global order are keys too, enough that blocks which are alike share one.

Not every candidate pair is needed for the components. First all rows of a key meet one of them (a star). What the links
so found connect is contracted. In keys that still hold several components, the rows outside the largest one meet one of
that, and are contracted again; then those that are still outside meet all rows of the key. So no link between different
components stays unseen, and a group of near copies isn't expanded.
Before a pair is given its fragments, sketches are compared that are four times as wide as its sets are large.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.llm.common import named, shuffle_partitions, stash, unused

#: Fragments in which overlaps are counted, n-grams of a block, 64-bit words of its sketch, growth of the size bands.
WIDE, BLOCK, SKETCH_WORDS, BAND = 8, 192, 8, 1.4
#: Classes that a task remembers, so as to give each once; orders by which keys choose the centre of their star, at first
#: and in contracted keys.
KEPT_CLASSES, ORDERS, MORE_ORDERS = 200_000, 4, 16
#: Texts whose sets are made before they are sent on.
ROWS = 256
_M1, _GOLD = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_S32, _M64 = np.uint64(32), (1 << 64) - 1


@dataclass(frozen=True)
class Likeness:
    """Links sets with 100 * intersection >= percent * union; n: words of an n-gram."""

    n: int = 5
    percent: int = 80

    def most_apart(self, total: int) -> int:
        """The largest symmetric difference of two linked sets with total elements together."""
        return (100 - self.percent) * total // (100 + self.percent)

    def bands(self) -> list[int]:
        """Lower bounds of the size bands. Below the first, only equal sets are linked."""
        out = [1]
        while self.most_apart(2 * out[0] + 1) < 1:
            out[0] += 1
        while out[-1] < 1 << 40:
            out.append(max(out[-1] + 1, int(out[-1] * BAND)))
        return out


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S32)) * _M1
    x = (x ^ (x >> _S32)) * _M1
    return x ^ (x >> _S32)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the text's n-grams of words; of all its words, if they are fewer; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    m = len(h) - n + 1
    out = mix(h[:m])
    for k in range(1, n):
        out = mix(out + h[k : m + k] + _GOLD)
    return np.unique(out)


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


@dataclass(frozen=True)
class Cut:
    """The narrow fragments of one size band, and their blocks."""

    level: int
    apart: int
    fragments: int
    blocks: int

    @classmethod
    def of(cls, level: int, like: Likeness, bands: list[int]) -> Cut:
        most = bands[level] - 1
        apart = like.most_apart(2 * most)
        return cls(level, apart, apart + 2 + apart // 8, max(1, most // BLOCK))

    def fragment(self, s: np.ndarray) -> np.ndarray:
        return (((s >> _S32) * np.uint64(self.fragments)) >> _S32).astype(np.int64)

    def block(self, fragment: np.ndarray) -> np.ndarray:
        return fragment * self.blocks // self.fragments

    def widths(self) -> np.ndarray:
        """The fragments of each block."""
        edges = -(-np.arange(self.blocks + 1) * self.fragments // self.blocks)
        return edges[1:] - edges[:-1]

    def spot(self, block: np.ndarray) -> np.ndarray:
        return (np.int64(self.level) << 48) + block


#: The spot of keys that stand for no block.
EVERYWHERE = -1


def cuts_for(size: int, like: Likeness, bands: list[int]) -> list[Cut]:
    """The cuts under which sets of this size meet the sets that they may be linked with."""
    level = int(np.searchsorted(bands, size, side="right"))
    levels = [level]
    while 100 * size >= like.percent * bands[level]:  # some set of the next band may be linked
        level += 1
        levels.append(level)
    return [Cut.of(x, like, bands) for x in levels]


def fragment_keys(s: np.ndarray, like: Likeness, bands: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and their spots (band and block). Linked sets share a key in a block that their link allows to differ so far."""
    size = len(s)
    if size < bands[0]:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keys, spots, void = [], [], False
    mixed = mix(s)
    for cut in cuts_for(size, like, bands):
        f = cut.fragment(s)
        first = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
        salt = np.uint64(cut.level)
        keys.append(mix(np.add.reduceat(mixed, first) + (f[first].astype(np.uint64) + _GOLD) * _M1 + salt))
        spots.append(cut.spot(cut.block(f[first])))
        may = cut.apart * cut.widths() // cut.fragments
        filled = np.bincount(cut.block(f[first]), minlength=cut.blocks)
        thin = filled <= may
        if thin.any():
            of = cut.block(f)
            start = np.searchsorted(of, np.arange(cut.blocks))
            early = thin[of] & (np.arange(size) - start[of] <= may[of])
            keys.append(mix(mix(s[early] ^ _GOLD) + salt))
            spots.append(cut.spot(of[early]))
            void |= bool((np.bincount(of, minlength=cut.blocks) <= may).any())
    if void:
        overlap = -(-like.percent * size // 100)
        keys.append(mix(s[: size - overlap + 1] ^ _GOLD))
        spots.append(np.full(len(keys[-1]), EVERYWHERE, np.int64))
    return np.concatenate(keys), np.concatenate(spots)


def block_sketches(s: np.ndarray, like: Likeness, bands: list[int]) -> tuple[np.ndarray, ...]:
    """spot, k, F, sketch of every block that holds n-grams: a link allows it to differ in D * k / F of them."""
    if len(s) < bands[0]:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty((0, SKETCH_WORDS), np.uint64)
    bits = SKETCH_WORDS * 64
    at = (mix(s) % np.uint64(bits)).astype(np.int64)
    one = np.ones(1, np.int64)
    out = [(np.array([EVERYWHERE]), one, one, sketch_of(s).reshape(1, -1))]
    for cut in cuts_for(len(s), like, bands):
        of = cut.block(cut.fragment(s))
        odd = np.bincount(of * bits + at, minlength=cut.blocks * bits) & 1
        held = np.unique(of)
        sketches = np.packbits(odd.astype(np.uint8)).view(np.uint64).reshape(-1, SKETCH_WORDS)[held]
        out.append((cut.spot(held), cut.widths()[held], np.full(len(held), cut.fragments), sketches))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def sketch_of(s: np.ndarray, bits: int = SKETCH_WORDS * 64) -> np.ndarray:
    """The parity sketch of a set; bits is a power of two of at least 64."""
    odd = np.bincount((mix(s) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def wide_sketch_of(s: np.ndarray) -> np.ndarray:
    """The sketch with the least power of two of bits that is no less than four times the set's size."""
    return sketch_of(s, max(64, 4 << (len(s) - 1).bit_length()))


def least_apart(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the symmetric difference of two sets, from their sketches of any two widths."""
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):  # bit k of the narrower is the parity of bits k and k + width of the wider
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def classes(docs: DataFrame, like: Likeness, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (a hash of the text), n, cls, wide (the wide sketch), spots (sketches of blocks) for every row.

    cls is null for an empty set.
    """
    rows = _texts(docs, id_col, text_col).withColumn("th", text_hash(F.col("t")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    bands = like.bands()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                sets = [shingle_set(t.as_py(), like.n) for t in b["t"]]
                blocks = [block_sketches(s, like, bands) for s in sets]
                ends = np.cumsum([0, *(len(x[0]) for x in blocks)])
                spot, k, f, sketch = (np.concatenate(x) for x in zip(*blocks, strict=True))
                columns = [spot, k, f, *sketch.view(np.int64).reshape(-1, SKETCH_WORDS).T]
                spots = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], fields=list(_SPOT)))
                wide = pa.array([wide_sketch_of(s).tobytes() if len(s) else None for s in sets], pa.binary())
                cls = pa.array([class_of(s) if len(s) else None for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["th"], pa.array([len(s) for s in sets], pa.int64()), cls, wide, spots], ["doc_id", "th", "n", "cls", "wide", "spots"])

    spot = ", ".join(f"{c}: bigint" for c in ("spot", "k", "f", *_SKETCH))
    return rows.mapInArrow(run, f"doc_id {kind}, th long, n long, cls long, wide binary, spots array<struct<{spot}>>")


def keyed(docs: DataFrame, like: Likeness, text_col: str = "text") -> DataFrame:
    """key, cls, spot for the classes of docs; a task gives each class seldom more than once."""
    bands = like.bands()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in batches:
            keys, spots, cls, held = [], [], [], 0
            for t in b["t"]:
                s = shingle_set(t.as_py(), like.n)
                c = class_of(s)
                if not len(s) or c in done:
                    continue
                if len(done) >= KEPT_CLASSES:
                    done.clear()
                done.add(c)
                k, spot = fragment_keys(s, like, bands)
                keys.append(k)
                spots.append(spot)
                cls.append(np.full(len(k), c, np.int64))
                held += len(k)
                if held > 1 << 18:
                    yield _keys(keys, spots, cls)
                    keys, spots, cls, held = [], [], [], 0
            if keys:
                yield _keys(keys, spots, cls)

    return docs.select(F.col(text_col).alias("t")).mapInArrow(run, "key long, cls long, spot long")


def _keys(keys: list[np.ndarray], spots: list[np.ndarray], cls: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(cls)), pa.array(np.concatenate(spots))], ["key", "cls", "spot"])


_SKETCH = [f"s{k}" for k in range(SKETCH_WORDS)]
_SPOT = pa.struct([("spot", pa.int64()), ("k", pa.int64()), ("f", pa.int64()), *((c, pa.int64()) for c in _SKETCH)])
_PART = pa.struct([("part", pa.int32()), ("grams", pa.list_(pa.int64()))])


def parts_of(docs: DataFrame, like: Likeness, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """cls, n, parts (the set by wide fragments) of the wanted classes; wanted: rep, th, by which a row of each is found."""
    texts = _texts(docs, id_col, text_col).withColumn("th", text_hash(F.col("t")))
    named = texts.join(wanted.filter("rep IS NOT NULL").withColumnRenamed("rep", "doc_id"), ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"])
    nameless = texts.filter("doc_id IS NULL").join(wanted.filter("rep IS NULL").select("th"), "th", "left_semi").dropDuplicates(["th"])
    rows = named.select("t").unionByName(nameless.select("t"))
    edges = [np.uint64((k << 64) // WIDE) for k in range(1, WIDE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                cls, n, parts = [], [], []
                for t in b["t"].slice(at, ROWS):
                    s = shingle_set(t.as_py(), like.n)
                    if len(s):
                        cls.append(class_of(s))
                        n.append(len(s))
                        parts.append([{"part": k, "grams": x.view(np.int64)} for k, x in enumerate(np.split(s, np.searchsorted(s, edges))) if len(x)])
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(n, pa.int64()), pa.array(parts, pa.list_(_PART))], ["cls", "n", "parts"])

    return rows.mapInArrow(run, "cls long, n long, parts array<struct<part: int, grams: array<bigint>>>")


def _may_link(a: str, b: str, like: Likeness) -> Column:
    """Whether sizes and sketches of two rows of a key leave a link open. a, b: prefixes of their columns."""
    c = lambda side, name: F.col(f"{side}{name}")
    total = c(a, "n") + c(b, "n")
    most = F.floor(total * (100 - like.percent) / (100 + like.percent))
    apart = sum((F.bit_count(c(a, x).bitwiseXOR(c(b, x))) for x in _SKETCH[1:]), F.bit_count(c(a, _SKETCH[0]).bitwiseXOR(c(b, _SKETCH[0]))))
    sizes = 100 * F.least(c(a, "n"), c(b, "n")) >= like.percent * F.greatest(c(a, "n"), c(b, "n"))
    return sizes & (apart * c(a, "f") <= most * c(a, "k"))


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def star_pairs(rows: DataFrame, like: Likeness) -> DataFrame:
    """a < b: the rows of a key with one of its rows, where a link is open. rows: key, cls, n, k, f and the sketch.

    If rows have comp and most (the key's largest component), that one is of the largest component, and rows of other
    components meet it. Keys choose by one of a few orders, so that a group which shares many keys has a few centres.
    """
    contracted = "most" in rows.columns
    order = F.xxhash64(F.pmod("key", F.lit(MORE_ORDERS if contracted else ORDERS)), "cls", F.lit(contracted))
    if contracted:
        order = F.when(F.col("comp") == F.col("most"), order)
    head = F.min_by(F.struct("cls", "n", *_SKETCH), order).over(Window.partitionBy("key"))
    both = rows.withColumn("_h", head).select("*", *(F.col(f"_h.{c}").alias(f"_h{c}") for c in ("cls", "n", *_SKETCH)))
    met = F.col("comp") != F.col("most") if contracted else F.col("cls") != F.col("_hcls")
    return both.filter(met & _may_link("", "_h", like)).select(*_pair("cls", "_hcls")).distinct()


def still_open(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """The rows of keys that hold several components, with comp and most, the key's largest component.

    rows: key, cls and others; comp: cls, comp of the classes that have links so far.
    """
    marked = rows.join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    sizes = marked.groupBy("key", "comp").count().groupBy("key").agg(F.max_by("comp", F.struct("count", "comp")).alias("most"), F.count(F.lit(1)).alias("several"))
    return marked.join(sizes.filter("several > 1").drop("several"), "key")


def open_pairs(rows: DataFrame, like: Likeness) -> DataFrame:
    """a < b: the pairs of a key that lie in different components, where a link is open; rows as of still_open().

    Each such pair has a row outside the key's largest component, so only those rows meet all.
    """
    side = lambda df, p: df.select("key", *(F.col(c).alias(f"{p}{c}") for c in ("cls", "comp", "n", "k", "f", *_SKETCH)), *(["most"] if p == "y" else []))
    both = side(rows.filter("comp <> most"), "x").join(side(rows, "y"), "key")
    once = (F.col("ycomp") == F.col("most")) | (F.col("xcls") < F.col("ycls"))
    return both.filter((F.col("xcomp") != F.col("ycomp")) & once & _may_link("x", "y", like)).select(*_pair("xcls", "ycls")).distinct()


def _spots(sets: DataFrame) -> DataFrame:
    return sets.select("cls", "n", F.explode("spots").alias("_s")).select("cls", "n", "_s.*")


def plausible(pairs: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """The pairs a, b that their wide sketches don't rule out."""
    side = lambda c: sets.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("wide").alias(f"w{c}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [
                (100 + like.percent) * least_apart(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) <= (100 - like.percent) * (m + n)
                for x, y, m, n in zip(*(b[c].to_pylist() for c in ("wa", "wb", "na", "nb")), strict=True)
            ]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """The linked ones of pairs: overlaps counted in each wide fragment separately, then summed for the pair."""
    parts = sets.select("cls", "n", F.explode("parts").alias("_p"))
    side = lambda c: parts.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("_p.part").alias("part"), F.col("_p.grams").alias(f"g{c}"))
    partial = pairs.select("a", "b").join(side("a"), "a").join(side("b"), ["b", "part"])
    partial = partial.select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).cast("long").alias("overlap"))
    counted = partial.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("overlap").alias("both"))
    return counted.filter(100 * F.col("both") >= like.percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node, comp for every node of links (a, b): comp is the least node that it is connected with.

    Large star and small star in turn until nothing changes, each written to the shared folder.
    """
    edges = stash(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    seen = None
    while True:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = stash(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first()
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)


def _resolved(docs: DataFrame, like: Likeness, id_col: str, text_col: str) -> DataFrame:
    """doc_id, th, n, cls, comp (the same for the classes of a component), component_id (null: none) for every row."""
    rows = stash(classes(docs, like, id_col, text_col), "classes")
    # Of rows with an id, if there are any, the least one.
    least_row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    reps = rows.filter(F.col("cls").isNotNull()).groupBy("cls").agg(least_row.alias("_r"), F.first("n").alias("n"))
    reps = stash(reps.select("cls", F.col("_r.doc_id").alias("rep"), F.col("_r.th").alias("th"), "n"), "representatives")
    links = class_links(docs, rows, reps, like, id_col, text_col)
    comp = components(links).join(reps.select(F.col("cls").alias("node"), "rep"), "node")
    least = comp.groupBy("comp").agg(F.min("rep").alias("least"))
    of = comp.join(least, "comp").select(F.col("node").alias("cls"), F.col("least").alias("linked"), "comp")
    # Classes without links and with one row, most of all, need no shuffle of their rows but this one.
    rows = rows.drop("wide", "spots")
    known = reps.join(of, "cls", "left").select(F.col("cls").alias("_cls"), F.coalesce("comp", "cls").alias("comp"), F.coalesce("linked", "rep").alias("component_id"))
    return rows.join(known, F.col("cls") == F.col("_cls"), "left").drop("_cls")


def near_duplicates(docs: DataFrame, like: Likeness = Likeness(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) for every row of docs.

    A text without words, or null, has an empty set, is linked with nothing and is its own component. Equal sets are
    linked. A row without an id has the component of its links; alone, none. Rows that share an id are linked only if
    their texts are. Extra columns are ignored. Empty tables give no rows.
    """
    out = _resolved(docs, like, id_col, text_col)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def class_links(docs: DataFrame, rows: DataFrame, reps: DataFrame, like: Likeness, id_col: str, text_col: str) -> DataFrame:
    """Links a, b of classes, enough that linked classes are connected.

    rows: of classes(); reps: cls, and rep, th of one of its rows. Sets are made again for the classes of those pairs
    only that sketches don't rule out.
    """
    spark = docs.sparkSession
    all_keys = keyed(docs, like, text_col).repartition(shuffle_partitions(spark), "key")
    w = Window.partitionBy("key")
    shared = all_keys.withColumns({"lo": F.min("cls").over(w), "hi": F.max("cls").over(w)}).filter("lo <> hi").select("key", "cls", "spot").distinct()
    shared = stash(shared, "shared-keys")
    sketches = rows.select("cls", "n", "wide", "spots").join(shared.select("cls").distinct(), "cls", "left_semi").dropDuplicates(["cls"])
    sketches = stash(sketches, "sketches")

    def linked(pairs: DataFrame, label: str) -> DataFrame:
        close = stash(plausible(pairs, sketches, like), f"{label}-pairs")
        ends = close.select(F.col("a").alias("cls")).unionByName(close.select(F.col("b").alias("cls"))).distinct()
        wanted = stash(reps.join(ends, "cls", "left_semi").select("rep", "th"), f"{label}-rows")
        parts = stash(parts_of(docs, like, wanted, id_col, text_col), f"{label}-parts")
        return stash(verified(close, parts, like), label)

    def sketched(keys: DataFrame) -> DataFrame:
        return keys.join(_spots(sketches), ["cls", "spot"]).drop("spot")

    first = stash(star_pairs(sketched(shared), like), "star-candidates")
    found = linked(first, "star")
    open_keys = stash(sketched(still_open(shared, _of(components(found)))), "open-keys")
    second = stash(star_pairs(open_keys, like).join(first, ["a", "b"], "left_anti"), "second-candidates")
    found = stash(found.unionByName(linked(second, "second")), "links-so-far")
    open_keys = stash(still_open(open_keys.drop("comp", "most"), _of(components(found))), "open-keys")
    rest = open_pairs(open_keys, like).join(first.unionByName(second), ["a", "b"], "left_anti")
    return stash(found.unionByName(linked(rest, "rest")), "links")


def _of(comp: DataFrame) -> DataFrame:
    return comp.select(F.col("node").alias("cls"), "comp")


def keep_one(docs: DataFrame, like: Likeness = Likeness(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those of a component but its first: one row of each component stays.

    That is the row with the smallest id, and of rows that repeat it, one. Rows are told apart by id and text, so a
    row doesn't go because another one with its id does. Rows without an id come after the others of their component.
    Rows without words all stay.
    """
    rows = stash(_resolved(docs, like, id_col, text_col).filter(F.col("cls").isNotNull()).select("doc_id", "th", "cls", "comp"), "rows-of-components")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cls", "th")
    first = rows.groupBy("comp").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    own_id, own_th, row = unused("_id", docs), unused("_th", docs), unused("_row", docs)
    marked = rows.join(first, "comp").groupBy(F.col("doc_id").alias(own_id), F.col("th").alias(own_th), stays.alias("_stays")).agg(F.count(F.lit(1)).alias("_rows"))
    # What isn't marked stays as it is.
    marked = stash(marked.filter("NOT _stays OR _rows > 1"), "marked-rows")
    same = F.col(id_col).eqNullSafe(F.col(own_id)) & (text_hash(F.col(text_col)) == F.col(own_th))
    out = docs.join(marked.select(own_id, own_th), same, "left_anti")
    repeated = marked.filter("_stays").select(own_id, own_th)
    if repeated.isEmpty():
        return out
    copies = docs.join(repeated, same).groupBy(own_id, own_th).agg(F.min_by(F.struct(*named(docs)), F.xxhash64(*named(docs))).alias(row))
    return out.unionByName(copies.select(f"{row}.*"))
