"""Attribution by rule and candidates for tasks against plain Python."""

import random
import time

from pyspark.sql import functions as F

from narrata.operators import attribution, evidence


def said(tail):
    """(name, verb) of the first place with a verb and a clean name before it."""
    for i in range(len(tail)):
        verbs = [v for v in attribution.VERBS if tail.startswith(v, i)]
        bare = tail[:i].rstrip(attribution.BOUNDARY)
        start = len(bare) - 6
        if start < 0:
            start = max(0, i + start)
        name = bare[start:]
        if verbs and name and not set(name) & set(attribution.BOUNDARY):
            return name, min(verbs)
    return None


def test_names_before_verbs(spark):
    r = random.Random(4)
    tails = ["", "说", "安娜说道", "，安娜。低声回答说", "abcdefgh 说", "a\nb道", "😀😀说", "他 没有答 她问"]
    tails += ["".join(r.choice(["安", "娜", "说", "道", "低声", "回答", "问", "，", " ", "\n", "a", "…", "”", "忽然说"]) for _ in range(r.randint(0, 25)))[:40] for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(tails)), "k long, tail string")
    got = {x.k: x.x for x in df.select("k", attribution.attributed(F.col("tail")).alias("x")).collect()}
    assert [got[k] and tuple(got[k]) for k in range(len(tails))] == [said(t) for t in tails]
    assert spark.createDataFrame([(None,)], "tail string").select(attribution.attributed(F.col("tail")).alias("x")).first().x is None


def test_tails_across_pieces(spark):
    r = random.Random(6)
    texts = {1: "".join(r.choice("abc日😀") for _ in range(300)), 2: "xy"}
    segments = []
    for book, t in texts.items():
        at = 0
        while at < len(t):
            n = r.choice([1, 3, 60])
            segments.append((book, len(segments), t[at : at + n], at))
            at += n
    quotes = spark.createDataFrame([(b, k) for b, t in texts.items() for k in range(len(t) + 1)], "book long, end_cp long")
    whole = spark.createDataFrame(list(texts.items()), "book long, text string")
    cut = spark.createDataFrame(segments, "book long, turn long, seg string, start_cp long")
    for df in (whole, cut):
        got = {(x.book, x.end_cp): x.tail for x in attribution.tails(df, quotes, 10, 25).collect()}
        assert got == {(b, k): t[k : k + 10] for b, t in texts.items() for k in range(len(t) + 1)}


def test_candidates_against_a_walk(spark):
    r = random.Random(8)
    lines, at = [], 0
    for _ in range(80):
        n = r.choice([5, 30, 120])
        lines.append((1, at, at + n, "".join(r.choice("abcde") for _ in range(n))))
        at += n
    facts = [(1, f"p{k}", kind, "".join(r.choice("abcde") for _ in range(r.choice([1, 2, 3, 4]))), r.randrange(2000)) for k in range(12) for kind in ("name", "alias", "designation", "relation") if r.random() < 0.7]
    tasks = [(1, 0, 900, 1000, None, ["p9"]), (1, 1, 900, 1000, 1010, []), (1, 2, 0, 5, 700, ["p1", "p2", "nobody"]), (1, 3, 2000, 2100, 2600, None)]
    want = []
    for book, task, first, last, horizon, pinned in tasks:
        limit = min(at if horizon is None else horizon, at)
        a, b, rows = max(0, first - 100), min(limit, last + 100), []
        for p in sorted({f[1] for f in facts}):
            own = [f for f in facts if f[1] == p and f[4] <= limit]
            if not any(f[2] in ("name", "designation") for f in own):
                continue
            hits = [s for _, s, e, line in lines if e <= limit and any(f[3] in line for f in own if f[2] in evidence.NAMING)]
            rows.append((p not in (pinned or []), -sum(a <= s < b for s in hits), min((abs(s - first) for s in hits), default=at), p))
        rows.sort()
        keep = [x for k, x in enumerate(rows) if not x[0] or k < 4]
        want += [(task, k + 1, p, not free, -local, far) for k, (free, local, far, p) in enumerate(keep)]
    got = evidence.candidates(
        spark.createDataFrame(tasks, "book long, task long, first long, last long, horizon long, pinned array<string>"),
        spark.createDataFrame(facts, "book long, person string, kind string, value string, visible_from_cp long"),
        spark.createDataFrame(lines, "book long, start_cp long, end_cp long, line string"), margin=100, most=4,
    )
    assert sorted((x.task, x["rank"], x.person, x.pinned, x.local, x.distance) for x in got.collect()) == want


def test_postings_against_all_pairs_and_of_long_lines(spark):
    r = random.Random(6)
    word = lambda n: "".join(r.choice("ab安😀 ") for _ in range(n))
    facts = [(b, f"p{k % 9}", r.choice(["name", "alias", "designation", "other"]), r.choice([word(r.randint(0, 4)), None, " ", "a"]), k) for b in (1, 2) for k in range(60)] + [(None, "p", "name", "a", 0)]
    lines = [(b, k * 50, k * 50 + 40, word(r.randint(0, 40)) or None) for b in (1, 2, 3) for k in range(30)]
    f = spark.createDataFrame(facts, "book long, person string, kind string, value string, visible_from_cp long")
    t = spark.createDataFrame(lines, "book long, start_cp long, end_cp long, line string")
    want = {(b, p, v, at, s, e) for b, p, kind, v, at in facts if kind != "other" and v and v.strip(" ") for c, s, e, x in lines if b == c and x and v in x}
    got = [tuple(x) for x in evidence.postings(f, t).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # A copy of the line for each two neighbouring code points was the square of its length.
    one = F.concat(F.transform(F.sequence(F.lit(0x4E00), F.lit(0x9000)), lambda x: F.decode(F.unhex(F.hex(x)), "UTF-16BE")))
    long = spark.range(20).select(F.lit(1).cast("long").alias("book"), F.col("id").alias("start_cp"), F.col("id").alias("end_cp"), F.concat(F.array_join(F.flatten(F.array(one, one, one)), ""), F.lit("安b")).alias("line"))
    began = time.time()
    assert evidence.postings(f.filter("book = 1").limit(0).unionByName(spark.createDataFrame([(1, "p", "name", "安b", 0)], f.schema)), long).count() == 20
    assert time.time() - began < 40


def test_mention_ranking_doesnt_copy_lines(spark):
    """The plan generates the names that lines hold, and no rows for the code points of a line."""
    from narrata.plans.registry import QUERIES

    plan = QUERIES["d44_mention_ranking"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    made = [x for x in plan.split("\n") if "Generate explode" in x]
    assert made and not any("sequence(" in x for x in made)
