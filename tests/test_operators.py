"""Folds, matching, graphs and streams against plain Python."""

import random

import pandas as pd
from pyspark.sql import functions as F

from narrata.functions import names
from narrata.operators import evaluation, export, graph, intervals, text, windows
from narrata.sources import archives, pages
from narrata.streaming import ledger


def test_matching_is_greedy(spark):
    r = random.Random(4)
    gold = [("b", f"g{k}", k * 50 + r.randint(0, 9), k * 50 + r.randint(30, 60)) for k in range(40)]
    pred = [("b", f"p{k}", a := r.randint(0, 2000), a + r.randint(10, 60)) for k in range(80)]
    cols = "book string, key string, start_cp long, end_cp long"
    got = {(x.gold, x.pred) for x in evaluation.matched(spark.createDataFrame(gold, cols), spark.createDataFrame(pred, cols)).collect()}
    pairs = []
    for _, g, a, b in gold:
        for _, p, c, d in pred:
            shared, union = min(b, d) - max(a, c), max(b, d) - min(a, c)
            if shared > 0 and shared / union >= 0.5:
                pairs.append((-shared / union, a, c, g, p))
    want, used = set(), set()
    for *_, g, p in sorted(pairs):
        if g not in used and p not in used:
            used |= {g, p}
            want.add((g, p))
    assert got == want and want


def test_intervals_of_confidence(spark):
    low, high = evaluation.wilson(F.col("h"), F.col("n"))
    rows = spark.createDataFrame([(2, 2), (0, 5), (0, 0)], "h long, n long").select(low.alias("low"), high.alias("high"), evaluation.ratio(F.col("h"), F.col("n")).alias("r")).collect()
    z = 1.96
    want = ((1 + z * z / 4) - z * (z * z / 16) ** 0.5) / (1 + z * z / 2)
    assert abs(rows[0].low - want) < 1e-9 and rows[0].high == 1.0 and rows[1].low == 0.0
    assert rows[2].low is None and rows[2].high is None and rows[2].r is None
    f = spark.createDataFrame([(0.5, 0.0), (0.5, 0.25), (None, 0.5)], "p double, r double").select(evaluation.f1(F.col("p"), F.col("r")).alias("f")).collect()
    assert [x.f for x in f] == [None, 1 / 3, None]


def test_graphs(spark):
    r = random.Random(1)
    edges = [(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(45)] + [(f"c{k}", f"c{k + 1}") for k in range(30)]
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in root}
    seeds = spark.createDataFrame([("n1",), ("c10",)], "node string")
    reached = {x.node for x in graph.reached(spark.createDataFrame(edges, "source string, target string"), seeds).collect()}
    want, front = {"n1", "c10"}, ["n1", "c10"]
    while front:
        x = front.pop()
        for a, b in edges:
            if a == x and b not in want:
                want.add(b)
                front.append(b)
    assert reached == want
    ends = {x.node: x.end for x in graph.resolved(spark.createDataFrame([(f"v{k}", f"v{k + 1}") for k in range(20)], "node string, target string")).collect()}
    assert set(ends.values()) == {"v20"}
    assert graph.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_packing_of_targets(spark):
    rows = [("b", k, t, g) for k, (t, g) in enumerate([(100, 0), (100, 50), (60, 10), (400, 5), (10, 5), (10, 280), (290, 0), (5, 5)])]
    got = windows.packed(spark.createDataFrame(rows, "book string, start_cp long, tokens long, gap_before long"), 300).orderBy("start_cp").collect()
    assert [x.window for x in got] == [0, 0, 1, 2, 3, 3, 4, 4] and [x.oversized for x in got].count(True) == 1


def test_slices_take_the_innermost(spark):
    nodes = spark.createDataFrame([("b", 0, 0, 20), ("b", 1, 20, 30)], "book string, node long, l_start long, l_end long")
    items = spark.createDataFrame([("b", "o", 0, 2, 15), ("b", "i", 1, 5, 8), ("b", "j", 2, 5, 8)], "book string, item string, ordinal long, r_start long, r_end long")
    got = sorted((x.node, x.start_cp, x.end_cp, x.item) for x in export.slices(nodes, items).collect())
    assert got == [(0, 0, 2, None), (0, 2, 5, "o"), (0, 5, 8, "i"), (0, 8, 15, "o"), (0, 15, 20, None), (1, 20, 30, None)]


def test_names(spark):
    cases = [("Anna", "Anna Lee", "Anna Lee"), ("", "悠太", "悠太"), ("悠太", "悠太老师", "悠太"), ("女生", "美咲", "美咲"), ("Bob", "Alice", "Bob"), ("Al", "S12", "Al"), (None, None, "")]
    got = spark.createDataFrame(cases, "c string, p string, w string").select("w", names.fuller(F.col("c"), F.col("p")).alias("g")).collect()
    assert all(x.w == x.g for x in got)
    m = spark.createDataFrame([("店员美咲", "美咲", True), ("美咲（旧）", "美咲", True), ("悠太的父亲", "父亲", False), ("x", "", False)], "v string, n string, w boolean")
    assert all(x.w == x.g for x in m.select("w", names.matches(F.col("v"), F.col("n")).alias("g")).collect())


def test_pages_and_archives(spark):
    html = "<html><head><title>t</title></head><body><p>a &amp; b<p>c<br>d<!-- x --><script>no</script> e&nbsp;f</body></html>"
    got = [(x.block, x.text) for x in pages.blocks(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")).orderBy("block").collect()]
    assert got == [(0, "a & b"), (1, "c"), (2, "d e f")]
    calls = spark.createDataFrame([(1, '{"api_key": "s3cret", "x": 1}'), (2, None)], "k long, body string")
    back = {x.k: x.text for x in archives.unpacked(archives.packed(calls, "k", "body"), "k").collect()}
    assert back == {1: '{"api_key": "***", "x": 1}', 2: None}
    bad = spark.createDataFrame([(1, bytearray(b"junk"))], "k long, archive binary")
    assert archives.unpacked(bad, "k").first().text is None


def test_last_range_as_fallback(spark):
    points = spark.createDataFrame([("b", 5), ("b", 50), ("c", 1)], "book string, p long")
    ranges = spark.createDataFrame([("b", 0, 0, 10), ("b", 1, 10, 20)], "book string, ch long, r_start long, r_end long")
    assert sorted((x.book, x.p, x.ch) for x in intervals.with_range_or_last(points, ranges, "p", "ch").collect()) == [("b", 5, 0), ("b", 50, 1), ("c", 1, None)]


def test_compression_keeps_cues(spark):
    t = "甲。" * 30 + "他说。" + "乙。" * 30
    got = [(x.kept, x.start_cp, x.end_cp) for x in text.compressed(spark.createDataFrame([(1, t), (2, "short。"), (3, "说。" * 60)], "d long, text string"), "d").collect()]
    assert sorted((a, b) for k, a, b in got if k) == [(0, 4), (58, 65), (119, 123)]
    assert sum(b - a for _, a, b in got) == len(t)


def test_stream_goes_on_after_a_stop(spark, tmp_path):
    """The fold of states takes a second file up where the first one ended."""
    events = pd.DataFrame({"event_id": range(8), "user_id": [1, 1, 2, 1, 1, 2, 1, 2], "event_type": ["a", "purchase", "a", "a", "a", "purchase", "purchase", "a"], "ts": pd.date_range("2024-01-01", periods=8, freq="h"), "value": 1.0})
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for part in (events[:4], events[4:]):
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("event_id long, user_id long, event_type string, ts timestamp, value double").parquet(src)
        q = ledger.folded(stream).writeStream.trigger(availableNow=True).outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/offsets").start()
        q.awaitTermination()
    got = {x.event_id: (x.scene, x.label) for x in spark.read.parquet(out).collect()}
    assert got == {0: (0, 1), 1: (1, 0), 3: (1, 1), 4: (1, 2), 6: (2, 0), 2: (0, 1), 5: (1, 0), 7: (1, 1)}


def test_epub(spark):
    import io
    import zipfile

    from narrata.sources import epub

    book = epub.build("t", [("One & two", ["a <b>", " c  d\n"]), ("", [])])
    toc, rows = epub.read(book)
    assert list(toc.values()) == ["One & two", ""] and [r[:4] for r in rows] == [(0, 0, "h1", "One & two"), (0, 1, "p", "a <b>"), (0, 2, "p", "c d")]
    assert zipfile.ZipFile(io.BytesIO(book)).infolist()[0].filename == "mimetype"

    def changed(name, data=b"x"):
        out = io.BytesIO(book)
        with zipfile.ZipFile(out, "a") as z:
            z.writestr(name, data)
        return out.getvalue()

    bad = [b"", b"no", changed("../x"), changed("/x"), changed("a\\b"), changed("mimetype"), book[:-30]]
    got = epub.blocks(spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate([*bad, book])] + [(99, None)], "book long, content binary")).collect()
    assert {r.book for r in got if r.error} == {*range(len(bad)), 99} and sum(r.book == len(bad) for r in got) == 3


def test_manifests_are_bound_in_order(spark):
    from narrata.operators import evaluation

    ch = spark.createDataFrame([(1, 0, "A"), (1, 1, "B"), (1, 2, "A"), (1, 3, None)], "book long, ordinal long, title string")
    ti = spark.createDataFrame([(1, 0, "B"), (1, 1, " A "), (1, 2, "A"), (1, 3, "x"), (1, 9, "y")], "book long, index long, title string")
    got = {x["index"]: x.ordinal for x in evaluation.bound_chapters(ch, ti).collect()}
    assert got == {0: 1, 1: 0, 2: 2, 3: 3}
    q = spark.createDataFrame([(1, 0, k, f"q{k}", t) for k, t in enumerate(["a", "b", "a", "c"])], "book long, chapter long, start_cp long, quote_id string, text string")
    e = spark.createDataFrame([(1, 0, k, t) for k, t in enumerate(["b", "z", "a", "a", "", "c"])] + [(2, 0, 0, "a")], "book long, chapter long, entry long, text string")
    assert {(x.book, x.entry): x.quote_id for x in evaluation.restored_by_text(q, e).collect()} == {(1, 0): "q1", (1, 1): None, (1, 2): "q2", (1, 3): None, (1, 4): None, (1, 5): "q3", (2, 0): None}
