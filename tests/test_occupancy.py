"""Admission of work against sets in plain Python."""

import random

from narrata.operators import occupancy as o

JOB = "book long, kind string, state string, start_cp long, end_cp long, selected array<string>, chapter string"
KINDS = {"requests": f"request string, own string, {JOB}", "jobs": f"job string, {JOB}", "windows": "job string, win string, quote_id string", "planned": "job string, win string, quote_id string", "quotes": "book long, quote_id string, start_cp long, depth int", "lengths": "book long, length_cp long"}


def expected(t):
    lengths, sets = dict(t["lengths"]), {}
    for kind in ("windows", "planned"):
        for job, win, q in t[kind]:
            sets.setdefault((kind, job), {}).setdefault(win, set()).add(q)

    def about(own, book, start, end, selected):
        a, z = 0 if start is None else start, lengths[book] if end is None else end
        a, z = (a, z) if 0 <= a <= z else (0, lengths[book])
        wide = {q for b, q, at, depth in t["quotes"] if b == book and a <= at < z and depth == 0}
        if selected is None or None in selected:
            return wide
        stored, plan = sets.get(("windows", own), {}), sets.get(("planned", own), {})
        known = set().union(*(stored[w] for w in selected if w in stored))
        if all(w in stored or w in plan for w in selected):
            return known.union(*(plan[w] for w in selected if w not in stored))
        return known | wide

    out = {}
    for request, own, book, kind, _, start, end, selected, chapter in t["requests"]:
        met = []
        for job, b, k, state, a, z, chosen, c in t["jobs"]:
            if b == book and job != own and state in o.ACTIVE and (k == o.ON_PEOPLE) == (kind == o.ON_PEOPLE) and k in [*o.ON_QUOTES, o.ON_PEOPLE]:
                if c == chapter if k == o.ON_PEOPLE else about(job, b, a, z, chosen) & about(own, book, start, end, selected):
                    met.append(job)
        out[request] = min(met, default=None)
    return out


def test_admitted(spark):
    r = random.Random(2)
    t = {k: [] for k in KINDS}
    for book in range(25):
        t["lengths"].append((book, 100))
        t["quotes"] += [(book, f"q{book}-{k}", k * 10, int(k == 5)) for k in range(10)]
        for n in range(5):
            job = f"j{book}-{n}"
            row = (book, r.choice([*o.ON_QUOTES, o.ON_PEOPLE, "OTHER"]), r.choice([*o.ACTIVE, "DONE", None]), r.choice([None, 0, 20, 60, -1]), r.choice([None, 20, 30, 70, 80]), r.choice([None, None, [], ["w0"], ["w0", "w1"], ["w2", "w9"], ["w0", None]]), r.choice(["a", "b", None]))
            t["jobs"].append((job, *row))
            for kind in ("windows", "planned"):
                t[kind] += [(job, f"w{w}", f"q{book}-{r.randrange(10)}") for w in range(3) for _ in range(2) if r.random() < 0.4]
            own = r.choice([job, f"j{book}-0", None])
            t["requests"].append((f"r{job}", own, book, r.choice([*o.ON_QUOTES, o.ON_PEOPLE]), None, *row[3:]))
    got = {x.request: x.met for x in o.admitted(*[spark.createDataFrame(t[k], KINDS[k]) for k in KINDS]).collect()}
    want = expected(t)
    assert got == want and 10 < sum(x is None for x in want.values()) < 115
    none = [spark.createDataFrame([], s) for s in KINDS.values()]
    assert o.admitted(*none).count() == 0
