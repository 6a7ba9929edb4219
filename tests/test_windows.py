"""Windows, units and matchings against one walk after another in plain Python."""

import random

from pyspark.sql import functions as F

from narrata.operators import evaluation, graph, windows


def walked(rows, budget, most):
    """(window, oversized) of each (tokens, gap) in order."""
    out, window, held, used = [], -1, 0, 0
    for tokens, gap in rows:
        over = tokens > budget
        if held and not over and used + tokens + gap <= budget and not (most and held >= most):
            held, used = held + 1, used + tokens + gap
        else:
            window, held, used = window + 1, 0 if over else 1, 0 if over else tokens
        out.append((window, over))
    return out


def test_windows_against_a_walk(spark, monkeypatch):
    r = random.Random(3)
    monkeypatch.setattr(windows, "CELL", 50)  # several cells of positions a book
    for most in (0, 3):
        books = {b: [(r.choice([0, 5, 40, 99, 100, 101, 300]), r.choice([0, 0, 3, 60, 500])) for _ in range(n)] for b, n in enumerate([1, 2, 30, 200])}
        rows = [(b, 3 * k, t, g) for b, x in books.items() for k, (t, g) in enumerate(x)]
        df = spark.createDataFrame(rows, "book long, start_cp long, tokens long, gap_before long")
        got = windows.packed(df, 100, most).orderBy("book", "start_cp").collect()
        assert [(x.window, x.oversized) for x in got] == [w for x in books.values() for w in walked(x, 100, most)]
    assert windows.packed(df.limit(0), 100).count() == 0


def units(blocks, budget, most):
    out = []
    for first, last, tokens, quotes, before, explicit in blocks:
        u = out[-1] if out else None
        if u and not explicit and u[2] + tokens + u[3] <= budget and not (most and u[4] + quotes > most):
            u[1], u[2], u[4] = last, u[2] + tokens, u[4] + quotes
        else:
            out.append([first, last, tokens, before, quotes])
    return [(f, e, t, b, t + b <= budget) for f, e, t, b, _ in out]


def test_units_against_a_walk(spark):
    r = random.Random(5)
    rows, want = [], []
    for book in range(5):
        lines = [(k, r.choice([1, 9, 30, 130]), r.random() < 0.5, r.random() < 0.1) for k in range(r.choice([1, 40, 150]))]
        rows += [(book, *x) for x in lines]
        blocks, last = [], None
        for k, tokens, quote, explicit in lines:
            if quote and last and last[2] and not explicit:
                blocks[-1][1:4] = k, blocks[-1][2] + tokens, blocks[-1][3] + 1
            else:
                blocks.append([k, k, tokens, int(quote), last[1] if last else 0, explicit])
            last = (k, tokens, quote)
        want += [(book, u, *x) for u, x in enumerate(units(blocks, 100, 4))]
    df = spark.createDataFrame(rows, "book long, line long, tokens long, has_quote boolean, explicit boolean")
    got = windows.dialogue_units(df, 100, 4).select("book", "unit", "first", "last", "tokens", "before", "fits").collect()
    assert sorted(map(tuple, got)) == want


def test_one_to_one_against_a_walk(spark):
    r = random.Random(9)
    rows = [(g, r.randrange(25), r.randrange(25), r.randrange(4)) for g in range(3) for _ in range(150)] + [(0, None, 1, 0), (1, 2, None, 0)]
    want, used = set(), set()
    for g, a, b, score in sorted((x for x in rows if None not in x), key=lambda x: (x[0], x[3], x[1], x[2])):
        if ("l", g, a) not in used and ("r", g, b) not in used:
            used |= {("l", g, a), ("r", g, b)}
            want.add((g, a, b, score))
    df = spark.createDataFrame(rows, "g long, a long, b long, score long")
    got = [tuple(x) for x in evaluation.one_to_one(df, ["g"], "a", "b", ["score"]).collect()]
    assert len(got) == len(want) and set(got) == want
    assert evaluation.one_to_one(df.limit(0), ["g"], "a", "b", ["score"]).count() == 0


def test_ways_of_any_length(spark):
    rows = [("a", k, k + 3 if k < 97 else None) for k in range(100)] + [("b", 7, 9), ("b", 8, None), ("b", 9, None), ("c", 0, 50)]
    got = {(x.book, x.at) for x in graph.followed(spark.createDataFrame(rows, "book string, at long, next long")).collect()}
    assert got == {("a", k) for k in range(0, 100, 3)} | {("b", 7), ("b", 9), ("c", 0)}


def test_the_last_within_reach(spark):
    r = random.Random(2)
    totals = sorted(r.choice([0, 1, 5, 5, 40, 41, 200, 207, 500]) + 100 * r.randrange(5) for _ in range(60))
    df = spark.createDataFrame([(1, k, v, r.randint(-30, 60)) for k, v in enumerate(totals)], "book long, _i long, total long, more long")
    for x in windows.last_within(df, "total", F.col("total") + F.col("more"), 60, "last").collect():
        below = [k for k, v in enumerate(totals) if v <= x.total + x.more]
        assert x.last == (below[-1] if x.more >= 0 else None)


def test_overlap_against_a_walk(spark):
    r = random.Random(1)
    paragraphs, at = [], 0
    for _ in range(120):
        n = r.choice([1, 7, 30])
        paragraphs.append((1, at, at + n, r.choice([0, 1, 10, 40, 150])))
        at += n + r.choice([0, 2])
    starts = [(1, k, r.randrange(at + 20)) for k in range(60)] + [(2, 0, 5)]
    want = set()
    for _, k, x in starts[:-1]:
        before = [p for p in paragraphs if p[2] <= x]
        if before:
            first, total = before[-1], before[-1][3]
            for p in reversed(before[:-1]):
                total += p[3]
                if total > 100:
                    break
                first = p
            want.add((1, k, first[1]))
    got = windows.overlap(spark.createDataFrame(starts, "book long, window long, at long"), spark.createDataFrame(paragraphs, "book long, p_start long, p_end long, tokens long"), 100)
    assert {tuple(x) for x in got.collect()} == want
