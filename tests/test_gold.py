"""Issues of gold standards, held against a plain walk over random ones, and cases by hand."""

import collections
import random

from narrata.operators import gold

RANGE = "struct<start_cp: bigint, end_cp: bigint>"
KINDS = {
    "books": "book long, length_cp long", "scenes": "book long, i long, scene_id string, start_cp long, end_cp long, participants array<string>",
    "quotes": f"book long, i long, quote_id string, start_cp long, end_cp long, scene_id string, group_id string, resolvable boolean, kind string, fragments array<{RANGE}>, evidence array<struct<start_cp: bigint, end_cp: bigint, visible_from_cp: bigint>>, body string",
    "gaps": f"book long, i long, gap_id string, left_quote_id string, right_quote_id string, must_keep array<{RANGE}>",
}


def within(a, b, low, high):
    a, b = (-1 if x is None else x for x in (a, b))
    return low <= a < b <= high


def expected(t):
    out = collections.Counter()
    for book in {r[0] for rows in t.values() for r in rows}:
        of = lambda k: sorted((r for r in t[k] if r[0] == book), key=lambda r: r[1])  # noqa: E731, B023
        lengths = [r[1] for r in of("books") if r[1] is not None]
        outside = lambda a, b: bool(lengths) and not within(a, b, 0, max(lengths))  # noqa: E731, B023
        add = lambda code, ref, n=1: out.update({(book, code, ref): n})  # noqa: E731, B023
        seen, labels = set(), {}
        for _, _, ref, a, b, people in of("scenes"):
            add("duplicate_scene_id", ref, ref in seen)
            add("scene_range_out_of_bounds", ref, outside(a, b))
            if ref is not None:
                seen.add(ref)
                labels[ref] = people or []
        seen, ranges = set(), {}
        for _, _, ref, a, b, scene, group, sure, kind, parts, evidence, body in of("quotes"):
            low, high = (-1 if x is None else x for x in (a, b))
            add("duplicate_quote_id", ref, ref in seen)
            add("quote_range_out_of_bounds", ref, outside(a, b))
            add("unknown_scene", ref, scene not in labels)
            add("resolvable_without_group", ref, sure is True and group is None)
            add("unresolvable_with_group", ref, sure is False and group is not None)
            add("group_not_in_scene", ref, group is not None and group not in labels.get(scene, []))
            for x in parts or []:
                add("fragment_out_of_quote", ref, not within(*x, low, high))
            for x in evidence or []:
                add("evidence_range_out_of_bounds", ref, outside(x[0], x[1]))
                add("visible_before_evidence", ref, (x[2] or 0) < (-1 if x[0] is None else x[0]))
            add("quote_not_delimited", ref, kind in gold.MARKED and bool(body) and 0 <= low < high and not (body[0] in gold.PAIRS and body[-1] in gold.PAIRS.values()))
            if ref is not None:
                seen.add(ref)
                ranges[ref] = (low, high)
        seen_gaps = set()
        for _, _, ref, left, right, keep in of("gaps"):
            add("duplicate_gap_id", ref, ref in seen_gaps)
            add("unknown_quote_in_gap", ref, sum(x is not None and x not in ranges for x in (left, right)))
            if left in ranges and right in ranges:
                for x in keep or []:
                    add("must_keep_outside_gap", ref, not within(*x, ranges[left][1], ranges[right][0]))
            if ref is not None:
                seen_gaps.add(ref)
    return {k: n for k, n in out.items() if n}


def run(spark, t):
    got = gold.reference_issues(*[spark.createDataFrame(t[k], KINDS[k]) for k in KINDS]).collect()
    assert all((x.level == "warning") == (x.code in gold.WARNINGS) for x in got)
    return {(x.book, x.code, x.target): x.times for x in got}


def test_at_random(spark):
    r = random.Random(11)
    place = lambda: r.choice([None, -1, 0, 1, 5, 9, 10, 20])
    span = lambda: (place(), place())
    some = lambda make: r.choice([None, [], [make()], [make(), make()]])
    ref = lambda kind: r.choice([f"{kind}{k}" for k in range(5)] + [None])
    t = {k: [] for k in KINDS}
    for book in range(160):
        t["books"] += [(book, r.choice([None, 10, 20]))] * (book % 5 != 4)
        t["scenes"] += [(book, i, ref("s"), *span(), some(lambda: ref("g"))) for i in range(r.randint(0, 4))]
        t["quotes"] += [(book, i, ref("q"), *span(), ref("s"), ref("g"), r.choice([None, True, False]), r.choice(["speech", "thought", "other", None]), some(span), some(lambda: (*span(), place())), r.choice([None, "", "「a」", "『b", "c", "“"])) for i in range(r.randint(0, 5))]
        t["gaps"] += [(book, i, ref("x"), ref("q"), ref("q"), some(span)) for i in range(r.randint(0, 4))]
    want = expected(t)
    found = {code for _, code, _ in want}
    assert len(found) == 15, found
    assert run(spark, t) == want


def test_clean_and_empty(spark):
    t = {
        "books": [(1, 10)], "scenes": [(1, 0, "s", 0, 10, ["g"])], "quotes": [(1, 0, "q", 0, 3, "s", "g", True, "speech", [(0, 3)], [(0, 3, 3)], "「a」"), (1, 1, "p", 5, 10, "s", None, False, "speech", None, None, "（abc）")],
        "gaps": [(1, 0, "x", "q", "p", [(3, 5)]), (1, 1, "y", "p", None, None)],
    }
    assert run(spark, t) == {} and run(spark, {k: [] for k in KINDS}) == {}
