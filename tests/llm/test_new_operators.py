"""Filter audits, periodic runs and sentencepiece encoding against plain Python and the library."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from narrata.llm import audit, periodic, piece_bpe

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, `_h` long, `meta.part` string, word string, t string"
OTHERS = (1, "m", "w", "t")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def corpus():
    r = random.Random(11)
    texts = []
    for _ in range(80):
        vocab = [f"{r.choice('abcdefgé日')}{k}" for k in range(r.choice([2, 40, 300]))]
        t = " ".join(r.choice(vocab) for _ in range(r.choice([1, 20, 199, 200, 201, 400])))
        texts.append("".join(c.upper() if r.random() < 0.03 else c for c in t) + r.choice(["", "", "#", " $ "]))
    texts += [None, "", "", " \t\n ", "a b " * 300, "x " * 13, "one\ntwo " * 5000, texts[0], texts[0], texts[1], "A\x1cB\x85C " * 200, "é" * 3000, " ".join(map(str, range(3000)))]
    rows = [(k, t, r.choice(["en", "fr", None, ""]), *OTHERS) for k, t in enumerate(texts)]
    return [*rows, rows[0], rows[0], rows[5], (3, "another text of this id", "en", *OTHERS), (None, texts[0], "en", *OTHERS), (None, None, None, *OTHERS), (0, texts[0], "zz", *OTHERS)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def audited(rows, labels):
    """(part, order, step) -> counts, by applying each order's filters one after another."""
    lowest = {}
    for r in rows:
        if r[0] is not None:
            lowest[r[1] or ""] = min(r[0], lowest.get(r[1] or "", r[0]))
    failed = []
    for r in rows:
        t, w = r[1] or "", words(r[1])
        own = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t))
        own += "D" * bool(re.search("[#$%&*|]", t)) + "E" * (r[0] is not None and lowest[t] < r[0])
        failed.append((r[2] or "", own, any(x[0] == r[0] and x[1] == 1 for x in labels if x[0] is not None), any(x[0] == r[0] and x[2] == 1 for x in labels if x[0] is not None)))
    out, shapley = {}, collections.Counter()
    for part in {f[0] for f in failed}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left, gone = [f for f in failed if f[0] == part], []
            for k, f in enumerate(order):
                removed = [x for x in left if f in x[1]]
                redundant = sum(f in x[1] for x in gone)
                left, gone = [x for x in left if f not in x[1]], gone + removed
                alone = sum(x[0] == part and x[1] == f for x in failed)
                out[part, order, k + 1] = [len(left), len(removed), redundant, alone, sum(x[2] for x in removed), sum(x[3] for x in removed)]
                shapley[part, f] += len(removed)
    return {(p, o, k): (*v, shapley[p, o[k - 1]]) for (p, o, k), v in out.items()}


def test_audit_against_filters_in_order(spark, docs, rows):
    marks = [(0, 1, 0), (0, 0, 1), (0, 1, 0), (3, 1, 1), (7, None, 1), (12, 1, None), (999, 1, 1), (None, 1, 1), *[(k, k % 2, k % 3 == 0) for k in range(20, 60)]]
    labels = spark.createDataFrame([(a, b, None if c is None else int(c), 1) for a, b, c in marks], "doc_id long, quality int, toxic int, good int")
    got = {(x.part, x.filter_order, x.step): tuple(x)[3:] for x in audit.audit(docs, labels).collect()}
    assert got == audited(rows, [(a, b, c) for a, b, c in marks])


def test_audit_of_string_ids_and_empty_tables(spark):
    df = spark.createDataFrame([("b", "x", "en"), ("a", "x", "en"), (None, "x", None)], "key string, body string, lang string")
    labels = spark.createDataFrame([("b", 1, 0)], "key string, quality int, toxic int")
    got = {(x.part, x.filter_order, x.step): x for x in audit.audit(df, labels, "key", "body").collect()}
    assert len(got) == 2 * 600 and got["en", "EABCD", 1].removed == 1 and got["en", "EABCD", 1].good_lost == 1 and got["", "EABCD", 1].removed == 0
    assert audit.audit(df.limit(0), labels, "key", "body").count() == 0
    assert audit.audit(df, labels.limit(0), "key", "body").agg(F.sum("good_lost")).first()[0] == 0


def brute(w, least=12):
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(least, 2 * p) and i > s:
                found.setdefault((s, i + p), p)
            i += i == s
    return sorted((s, e - s, p) for (s, e), p in found.items())


def kept(w, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_random_words(monkeypatch):
    r = random.Random(5)
    for _ in range(150):
        texts = []
        for _ in range(r.randint(1, 8)):
            w = [r.randrange(r.choice([1, 2, 3, 50])) for _ in range(r.randint(0, 90))]
            if w and r.random() < 0.5:
                a, p = r.randrange(len(w)), r.randint(1, 10)
                w = [w[min(a + (i - a) % p, len(w) - 1)] if i >= a else w[i] for i in range(len(w))]
            texts.append(w)
        monkeypatch.setattr(periodic, "GRID", r.choice([1, 7, 1000]))
        least, edges = r.choice([2, 5, 12]), np.cumsum([0, *map(len, texts)])
        t, *found = periodic.runs(np.array([x for w in texts for x in w], np.int64), edges, least)
        for k, w in enumerate(texts):
            assert list(zip(*(x[t == k].tolist() for x in found), strict=True)) == brute(w, least), w


def test_find_runs(docs, rows, monkeypatch):
    want = collections.Counter((r[0], tuple(f := brute(words(r[1])[:4000])), kept(words(r[1]), f)) for r in rows if len(words(r[1])) <= 4000)
    got = periodic.find_runs(docs).collect()
    assert collections.Counter((x.doc_id, tuple(map(tuple, x.runs)), x.collapsed) for x in got if len(words(next(r[1] for r in rows if r[0] == x.doc_id))) <= 4000) == want
    long = next(x for x in got if x.doc_id == 86)
    assert long.runs == [(0, 10_000, 2)] and long.collapsed == "one two" and len(got) == len(rows)
    monkeypatch.setattr(periodic, "SLICE", 1)
    assert periodic.find_runs(docs.limit(0)).count() == 0


def test_planted_periods(docs, rows):
    want, periods = collections.Counter(), 0
    for r in rows:
        w = words(r[1])
        h = None if r[0] is None else zlib.crc32(str(r[0]).encode())
        if h is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w, periods = [w[a + (i - a) % p] if i >= a else w[i] for i in range(len(w))], periods + 1
        if len(w) > 4000:
            continue
        found = brute(w)
        best = min(found, key=lambda f: (-f[1], f[0], f[2]), default=None)
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        want[r[0], len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(listed), sha(kept(w, found))] += 1
    assert periods > 3
    got = periodic.digests(periodic.find_runs(periodic.with_planted_periods(docs))).collect()
    assert collections.Counter(tuple(x) for x in got if x.doc_id != 86) == want


def coded():
    r = random.Random(2)
    texts = ["", "  a  b ", "Ａ ｆ▁x\n\ty", "<s> </s> <0x0A> \x00", " " * 100 + "x" + " " * 37, "\n\n \n", "\r\n{\r\n }\r", "é é ﬁ 　x", "😀" * 50, "a" * 3000, "▁▁ ▁", "⁇ ⁇"]
    return texts + ["".join(r.choice(" \n\tab▁e\r{}é日😀0") for _ in range(r.randint(0, 60))) for _ in range(500)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_round_trip_against_the_library(spark, docs, rows, library):
    texts = [(k, t, 1) for k, t in enumerate(coded())] + [(r[0], r[1], 1) for r in rows]
    df = spark.createDataFrame(texts, "doc_id long, text string, n_tokens int")
    want = collections.Counter()
    for k, t, _ in texts:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want[k, len(ids), sha(np.asarray(ids, "<u4").tobytes()), sha(library.decode(ids))] += 1
    assert collections.Counter(map(tuple, piece_bpe.round_trip(df, PIECES).collect())) == want
    both = piece_bpe.decoded(piece_bpe.ids(df, PIECES), PIECES)
    assert collections.Counter(map(tuple, both.collect())) == collections.Counter((k, library.decode(library.encode(t or ""))) for k, t, _ in texts)
    assert piece_bpe.round_trip(df.limit(0), PIECES).count() == 0


def test_given_documents_against_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = piece_bpe.round_trip(docs, PIECES).collect()
    assert len(got) == len(texts)
    for x in got:
        ids = library.encode(texts[x.doc_id], add_bos=True, add_eos=True)
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(ids), sha(np.asarray(ids, "<u4").tobytes()), sha(library.decode(ids)))


def test_decoding_of_any_ids(library):
    vocabulary, r = piece_bpe.Vocabulary(PIECES), random.Random(7)
    for _ in range(5000):
        ids = [r.choice([0, 1, 2, 3 + r.randrange(256), 131 + r.randrange(128), 28705, r.randrange(259, 32000)]) for _ in range(r.randint(0, 8))]
        assert vocabulary.decode(ids).decode() == library.decode(ids), ids


@pytest.mark.parametrize("size", [1, 7, 30])
def test_sections_change_nothing(size, library):
    encoder = piece_bpe.Encoder(PIECES)
    for t in coded()[:300]:
        parts = list(piece_bpe.sections(t, size))
        ids = [i for s in parts for i in encoder.sections([s])[0].tolist()]
        assert ids == library.encode(t)


def test_a_difference_from_the_library_is_told(monkeypatch):
    encoder = piece_bpe.Encoder(PIECES)
    monkeypatch.setattr(encoder.vocabulary, "encode_all", lambda words: [b"five"] * len(words))
    with pytest.raises(ValueError, match="differ from the library"):
        encoder.sections(["▁word"])


def test_words_merged_together_are_as_by_heaps():
    vocabulary, r = piece_bpe.Vocabulary(PIECES), random.Random(8)
    long = [p.replace("▁", "") for p in list(vocabulary.score)[:9000]]
    words = ["".join(r.choice(long) for _ in range(r.randint(1, 6))) for _ in range(800)] + ["".join(r.choice("▁etaoinshrdlué日😀") for _ in range(r.randint(1, 45))) for _ in range(800)]
    got = vocabulary.encode_all(words)
    assert all(x == np.asarray(vocabulary.encode(w), "<u4").tobytes() for w, x in zip(words, got, strict=True))
