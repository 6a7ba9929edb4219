"""The scanner against a walk over every character, and ingestion of texts and bytes, by hand-made and random cases."""

import random
import time

import pytest
from pyspark.sql import functions as F

from narrata.operators import text
from narrata.operators.text import CEILING, MAX_DEPTH, MAX_LENGTH, MAX_LINES, PAIRS, scan
from narrata.plans.registry import QUERIES
from narrata.sources import files


def by_character(t, closes=()):
    """Quotes and counts of warnings by cause, one character after another."""
    opener = {c: o for o, c in PAIRS.items()}
    ends = {}
    causes = []
    for o, e in closes:
        if o < e <= len(t):
            ends.setdefault(e, []).append(o)
        else:
            causes.append("range")
    stack, found = [], []
    for i, ch in enumerate(t):
        for o in sorted(ends.get(i, []), reverse=True):
            at = [k for k, x in enumerate(stack) if x == ("“", o)]
            if not at:
                causes.append("unmatched")
                continue
            causes += ["outer"] * (len(stack) - at[0] - 1)
            del stack[at[0] :]
            found.append((o, i, "“", len(stack), stack[-1][1] if stack else None, True))
        while stack and i - stack[-1][1] > CEILING:
            stack.pop(0)
            causes.append("ceiling")
        if ch in PAIRS:
            if len(stack) >= MAX_DEPTH:
                causes.append("depth")
            else:
                stack.append((ch, i))
        elif ch in opener:
            at = [k for k, x in enumerate(stack) if x[0] == opener[ch]]
            if not at:
                causes.append("stray")
                continue
            causes += ["outer"] * (len(stack) - at[-1] - 1)
            start = stack[at[-1]][1]
            del stack[at[-1] :]
            found.append((start, i + 1, opener[ch], len(stack), stack[-1][1] if stack else None, False))
    causes += ["end"] * len(stack)
    kept = []
    for q in found:
        if q[1] - q[0] > MAX_LENGTH:
            causes.append("length")
        elif t[q[0] : q[1]].count("\n") > MAX_LINES:
            causes.append("lines")
        else:
            kept.append(q)
    starts = {q[0] for q in kept}
    return sorted((*q[:4], q[4] if q[4] in starts else None, q[5]) for q in kept), sorted(causes)


def test_scan_by_hand():
    assert scan("a「b『c』d」e")[0] == [(1, 8, "「", 0, None, False), (3, 6, "『", 1, 1, False)]
    assert scan("「a") == ([], [("unclosed_quote", 0, "「", "end")])
    assert scan("」「x」") == ([(1, 4, "「", 0, None, False)], [("stray_close", 0, "「", "stray")])
    assert scan("「" + "x" * 1300 + "」")[1] == [("quote_too_long", 0, "「", "length")]
    assert scan("「" + "x" * 6000 + "『a』")[0] == [(6001, 6004, "『", 0, None, False)]  # the old opening is given up
    assert scan("「\n\n\n\n」")[1] == [("quote_spans_too_many_paragraphs", 0, "「", "lines")]
    assert scan("「『a」")[1] == [("unclosed_quote", 1, "『", "outer")]
    assert [w[0] for w in scan("「" * 9)[1]].count("nesting_too_deep") == 1
    assert scan("𠮷「😀」")[0] == [(1, 4, "「", 0, None, False)]
    assert scan("“ab\n“c”", [(0, 3)])[0] == [(0, 3, "“", 0, None, True), (4, 7, "“", 0, None, False)]
    assert scan("“ab", [(0, 3)])[1] == [("unclosed_quote", 0, "“", "end")]  # a close at the very end never comes
    assert scan("ab", [(1, 1)])[1] == [("invalid_auto_close", 1, "“", "range")]
    assert scan("") == ([], [])


@pytest.mark.parametrize("seed", range(30))
def test_scan_at_random(seed):
    r = random.Random(seed)
    t = "".join(r.choice("「」『』“”（）\nab") for _ in range(r.choice([40, 300])))
    if seed % 3 == 0:
        t = t[:20] + "x" * r.choice([4700, 4801, 5200]) + t[20:]
    closes = [(k, r.randint(k, len(t) + 2)) for k, c in enumerate(t) if c == "“" and r.random() < 0.5] + [(3, 9)] * (seed % 2)
    quotes, warnings = scan(t, closes)
    want, causes = by_character(t, closes)
    assert quotes == want
    assert sorted(w[3] for w in warnings) == causes


def test_scans_in_frames(spark):
    df = spark.createDataFrame([(1, "“ab\n“c”", [(0, 3)]), (2, None, []), (3, "『a『b』c』", None)], "book long, text string, closes array<struct<opening_cp: bigint, close_cp: bigint>>")
    got = sorted(tuple(x) for x in text.scan_quotes(df).select("book", "start_cp", "end_cp", "depth", "kind_hint", "normalized").collect())
    assert got == [(1, 0, 3, 0, None, True), (1, 4, 7, 0, None, False), (3, 0, 7, 0, None, False), (3, 2, 5, 1, "quotation", False)]
    stats = {x.book: x for x in text.scan_stats(df).collect()}
    assert (stats[1].quotes, stats[1].normalized_closes, stats[2].quotes, stats[3].top_level_quotes) == (2, 1, 0, 1)
    assert text.scan_quotes(df.limit(0)).count() == 0


def noisy(r, n):
    t = "".join(r.choice("「」『』“”（）《》\n") if r.random() < 0.3 else r.choice("ab日😀") for _ in range(n))
    for _ in range(r.randint(0, 3)):
        k = r.randrange(len(t) + 1)
        t = t[:k] + "x" * r.choice([4700, 4801, 9000]) + t[k:]
    return t


@pytest.mark.parametrize("seed", range(30))
def test_pieces_in_a_row(seed):
    """Pieces that hand on what is open give what a scan of the whole text gives."""
    r = random.Random(seed)
    t = noisy(r, r.choice([30, 400, 1500]))
    size = r.choice([1, 3, 17, 200])
    quotes, warnings, held = [], [], []
    for base in range(0, len(t), size):
        q, w, held = text.scan_piece(t[base : base + size], base, held, last=base + size >= len(t))
        quotes, warnings = quotes + q, warnings + w
    starts = {q[0] for q in quotes}
    want, causes = scan(t)
    assert sorted((*q[:4], q[4] if q[4] in starts else None, q[5]) for q in quotes) == want
    assert sorted(warnings, key=repr) == sorted(causes, key=repr)


def test_long_texts_in_many_tasks(spark):
    """Texts, and segments of texts, cut into pieces: quotes, parents, closes and counters as of the whole text."""
    r, size = random.Random(4), 5000
    texts = {1: noisy(r, 9000), 2: noisy(r, 12_000) + "「" * 3 + "x" * 4000, 3: "", 4: "「" * 20 + "」" * 20, 5: noisy(r, 60)}
    closes = {k: [(i, r.randint(i, len(t) + 2)) for i, c in enumerate(t) if c == "“" and r.random() < 0.3][:20] for k, t in texts.items()}
    rows = [(k, t, closes[k]) for k, t in texts.items()]
    want = {(k, *q[:4], q[4], q[5]) for k, t, cs in rows for q in scan(t, cs)[0]}
    columns = ("book", "start_cp", "end_cp", "opening", "depth", "parent_start", "normalized")
    kind = "closes array<struct<opening_cp: bigint, close_cp: bigint>>"
    df = spark.createDataFrame(rows, f"book long, text string, {kind}")
    assert {tuple(x) for x in text.scan_quotes(df, size=size).select(*columns).collect()} == want
    warned = [(x.book, w.cause) for x in text.scanned(df, size).collect() for w in x.warnings]
    assert sorted(warned) == sorted((k, w[3]) for k, t, cs in rows for w in scan(t, cs)[1])
    segments = []
    for k, t, cs in rows:
        at = 0
        for turn in range(10_000):
            n = r.choice([0, 1, 40, 900])
            segments.append((k, turn, t[at : at + n], at, cs))
            at += n
            if at >= len(t):
                break
    cut = spark.createDataFrame(segments, f"book long, turn long, seg string, start_cp long, {kind}").repartition(3)
    assert {tuple(x) for x in text.scan_quotes(cut, size=size).select(*columns).collect()} == want


def test_lines_and_chapters(spark):
    t = "intro\r\n\r第1章 a\n\n第2章，prose\r序章\r\n  \n序章\nend"
    df = spark.createDataFrame([(1, t), (2, ""), (3, "no heading\nat all")], "book long, text string")
    rows = text.chaptered(text.split_lines(df)).orderBy("book", "line").collect()
    mine = [r for r in rows if r.book == 1]
    assert [r.body for r in mine] == ["intro", "", "第1章 a", "", "第2章，prose", "序章", "  ", "序章", "end"]
    for r in mine:
        assert t[r.source_start_cp : r.source_end_cp] == r.body
        assert r.end_cp - r.start_cp == len(r.body) + (1 if r.sep else 0)
    assert [r.synthetic for r in mine] == [True, True, False, False, True, True, False, False, False]
    assert [r.ordinal for r in mine] == [0, 0, 1, 1, 1, 2, 2, 2, 2] and [r.opens for r in mine].count(True) == 2
    assert {r.ordinal for r in rows if r.book == 3} == {0} and not [r for r in rows if r.book == 2]


def test_decoding():
    assert files.detect("漢字です".encode())[1] == "utf-8"
    assert files.detect("汉字汉字".encode("gb18030"))[:3:2] == ("汉字汉字", "low") or files.detect("汉字汉字".encode("gb18030"))[1] == "gb18030"
    assert files.detect(b"\xef\xbb\xbfabc")[:3] == ("abc", "utf-8-sig", "high")
    assert files.detect("abc".encode("utf-16"))[:3] == ("abc", "utf-16", "high")
    assert files.detect("abc".encode("utf-32"))[:3] == ("abc", "utf-32", "high")
    assert files.detect(b"abc")[2] == "low"  # all three decoders read it
    assert files.detect(b"")[3] == "empty"
    assert files.detect(b"\xff\xff\xff\x80\x80")[3] == "undecodable" and files.detect(b"\x80", "utf-8") == (None, "utf-8", None, "undecodable")
    assert files.plausibility("a\x01�") == 0.25 and files.plausibility("") == 1.0


def test_decoded_frames(spark):
    df = spark.createDataFrame([(1, bytearray(b"\xff\xff\xff\x80")), (2, bytearray("né".encode())), (3, None)], "k long, content binary")
    got = {r.k: r for r in files.decoded(df, "k").collect()}
    assert got[1].text is None and got[1].error == "undecodable" and got[1].preview
    assert got[2].text == "né" and got[2].error is None and got[3].error == "empty"


def test_counters_of_marked_documents(spark):
    """The counters over all documents, with letters turned into delimiters, against a walk over every character."""
    from narrata.plans.registry import QUERIES

    marks = str.maketrans(".,xzqj'", "」「『』“”‘")
    texts = {x.doc_id: (x.text or "").translate(marks) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {x.book: x for x in QUERIES["t3_scan_stats_of_marked_texts"](spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(texts)
    for k, t in texts.items():
        quotes, causes = by_character(t)
        want = {name: sum(causes.count(c) for c in counted) for name, counted in text.COUNTERS.items()}
        want |= {"quotes": len(quotes), "top_level_quotes": sum(q[3] == 0 for q in quotes), "warnings": len(causes), "normalized_closes": 0}
        assert {c: got[k][c] for c in want} == want, k


def auto_closed(t):
    marks = [(i, 1 if c == "“" else -1) for i, c in enumerate(t) if c in "“”"]
    out = []
    for k, (at, step) in enumerate(marks):
        depth, low = 0, 0
        for _, s in marks[k + 1 :]:
            depth += s
            low = min(low, depth)
        end = t.find("\n", at)
        if step == 1 and low >= 0 and end > at + 1 and next((s for i, s in marks if i >= end), None) == 1:
            out.append((at, end))
    return out


def test_auto_closes_against_a_walk_and_in_one_pass(spark):
    r = random.Random(11)
    texts = ["", "\n", "“", "“\n“", "“a\n“", "a“b\n\n”“c\n“d", *("".join(r.choice("“”a\n𝄞") for _ in range(r.randint(1, 60))) for _ in range(200))]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "book long, text string")
    got = sorted(tuple(x) for x in text.auto_close_suggestions(df).collect())
    assert got == sorted((b, *x) for b, t in enumerate(texts) for x in auto_closed(t))
    # The square of these numbers, of characters without a mark and of marks, took minutes.
    n = 400_000
    big = spark.range(1).select(F.lit(0).cast("long").alias("book"), F.concat(F.repeat(F.lit("“a"), 60_000), F.lit("\n“"), F.repeat(F.lit("x"), n)).alias("text"))
    began = time.time()
    assert text.auto_close_suggestions(big).count() == 60_000
    assert time.time() - began < 40


def test_scans_go_in_slices(spark, monkeypatch):
    """Python has some texts as objects at a time, not a batch of them; the results don't depend on how many."""
    from narrata.functions import slices

    held = []
    whole = {x.book: x for x in text.scan_stats(spark.range(40).select(F.col("id").alias("book"), F.repeat(F.lit("「a『b』」”"), 5).alias("text"))).collect()}
    monkeypatch.setattr(text, "mapped", lambda rows, make, schema: held.append(schema) or slices.mapped(rows, make, schema, 3))
    got = {x.book: x for x in text.scan_stats(spark.range(0, 40, 1, 1).select(F.col("id").alias("book"), F.repeat(F.lit("「a『b』」”"), 5).alias("text"))).collect()}
    assert held and got == whole and got[0].quotes == 10 and got[0].stray_closes == 5


def test_original_lines(spark, tmp_path):
    """Lines by every break, and of one long text in a time that grows with it: its lines were each held against all of it."""
    from hashlib import sha256

    texts = [None, "", "\n", "\r\n", "a", "a\n", "a\r\n", "a\n\n", "a\n\r", "\ra\r\nb\x0bc\x0cd\x1ce\x1df\x1eg\x85h\u2028i\u2029", "\x1f\u3000\n "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/d/documents.parquet")
    got = {(x.doc_id, x.ref): x.digest for x in QUERIES["t17_original_lines"](spark, f"{tmp_path}/d").collect()}
    want = {(k, f"L{i + 1}"): sha256(x.encode()).hexdigest() for k, t in enumerate(texts) for i, x in enumerate((t or "").splitlines())}
    assert got == want
    spark.createDataFrame([(1, "ab\n" * 60000)], "doc_id long, text string").write.parquet(f"{tmp_path}/long/documents.parquet")
    began = time.time()
    assert QUERIES["t17_original_lines"](spark, f"{tmp_path}/long").count() == 60000
    assert QUERIES["t17_original_lines"](spark, f"{tmp_path}/long").agg(F.count_distinct("digest")).collect()[0][0] == 1
    assert time.time() - began < 30


def test_sentences_are_cut_at_their_ends(spark):
    """parts() gives what the pattern finds, in a time far below that of matching all that isn't an end."""
    import re

    r = random.Random(5)
    texts = [None, "", "。", "a", "\n\n", "a\r", "a！？", "\u2028。x", "𠀀!𠀀"] + ["".join(r.choice("ab。！？!?\n\r\u2028说𠀀") for _ in range(r.randrange(60))) for _ in range(200)]
    d = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {x.k: x.p for x in d.select("k", text.parts(F.col("text")).alias("p")).collect()}
    find = re.compile(text.SENTENCE.replace("$", r"\Z"))
    assert got == {k: None if t is None else [x for x in find.findall(t) if x] for k, t in enumerate(texts)}
    long = spark.range(400).select(F.repeat(F.lit("the words of a sentence that goes on for a while, "), 4000).alias("text"))
    plan = QUERIES["t11_sentences"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and long.select(F.sum(F.size(text.parts(F.col("text"))))).collect()[0][0] == 400


def test_compression_moves_no_sentences(spark):
    """What stays and goes is worked out within each text: no plan sorts or shuffles sentences, and losses are as written out."""
    d = spark.createDataFrame([(1, "一" * 9 + "。" + "ab cd ef gh.!" * 8 + "他说。尾。", [(0, 5), (30, 31)]), (2, "short。a。b。", [(0, 9)]), (3, None, [(0, 9)]), (4, "x。" * 50, None)], "doc_id long, text string, must_keep array<struct<a: int, b: int>>")
    spans = [(x.kept, x.start_cp, x.end_cp) for x in text.compressed(d.filter("doc_id = 1"), "doc_id").collect()]
    assert spans == [(True, 0, 23), *[(False, 23 + 13 * k, 36 + 13 * k) for k in range(6)], (True, 101, 119)]
    got = {x.doc_id: (x.compressed, x.dropped_spans, x.dropped_cp, x.violations) for x in text.loss(d, "doc_id").collect()}
    assert got == {1: (1, 6, 78, 1), 2: (0, 0, 0, 0), 3: (0, 0, 0, 0), 4: (1, 46, 92, 0)}
    for q in (text.compressed(d, "doc_id"), text.loss(d, "doc_id")):
        plan = q._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Exchange", "Window", "Sort "))
