"""Corrections against folds in plain Python: clean-up, taking back, deletion."""

import json
import random

from narrata.operators import corrections as c

KINDS = {
    "items": "item string, quote_id string, reason string, status string, annotation_version long, candidates string", "annotations": "id string, book long, quote_id string, version long, stale boolean, user_locked boolean, source string, speaker string",
    "corrections": "id string, target_type string, target_id string, applied_version long, undone_by string, speaker string, at long", "histories": "annotation_id string, revision long, correction_id string", "jobs": "book long, state string",
}


def tables(r):
    quotes = [f"q{k}" for k in range(120)]
    t = {k: [] for k in KINDS}
    t["annotations"] = [(f"a{q}", (0, 0, 0, 0, 1, 5)[k % 6], q, r.randint(1, 3), r.choice([True, True, False, None]), r.random() < 0.1, r.choice(["MODEL", "MODEL", "MODEL", "USER"]), "now") for k, q in enumerate(quotes) if r.random() < 0.95]
    t["corrections"] = [(f"c{k}", r.choice(["QUOTE", "QUOTE", "ANNOTATION", "SCENE", "GAP"]), r.choice([*quotes, "gone"]), r.choice([None, 1, 2, 2, 3, 4]), r.choice([None, None, None, "", "u"]), f"was{k}", r.randrange(50)) for k in range(200)]
    t["histories"] = [(f"a{r.choice(quotes)}", r.randint(1, 3), r.choice([None, f"c{r.randrange(210)}"])) for _ in range(25)]
    said = lambda: r.choice([None, "{bad", "[1]", "7", '{"correction_id": 5}', '{"correction_id": null}', "{}"] + [json.dumps({"correction_id": f"c{r.randrange(210)}", "x": [1]}) for _ in range(40)])
    t["items"] = [(f"i{k:04}", r.choice([*quotes, "gone", None]), r.choice(["STALE_DEPENDENCY"] * 5 + ["OTHER"]), r.choice(["PENDING"] * 5 + ["DEFERRED", "RESOLVED", None]), r.choice([1, 2, 3, 4, None]), said()) for k in range(1500)]
    t["jobs"] = [(5, "RUNNING"), (1, "DONE"), (2, None), (None, "QUEUED")]
    return t


def of_json(text):
    try:
        data = json.loads(text)
    except (TypeError, ValueError):
        return None
    return data.get("correction_id") if isinstance(data, dict) and isinstance(data.get("correction_id"), str) else None


def test_cleaned(spark):
    t = tables(random.Random(8))
    notes, causes = {x[2]: dict(zip(["id", "book", "quote", "version", "stale", "locked", "source"], x, strict=False)) for x in t["annotations"]}, {x[0]: x for x in t["corrections"]}
    structural, had = {h[0] for h in t["histories"] if h[2] in causes and causes[h[2]][1] in c.STRUCTURAL}, {h[:2] for h in t["histories"]}
    want = {}
    for item, quote, reason, status, version, said in sorted(t["items"]):
        if quote not in notes or reason != "STALE_DEPENDENCY" or status in ("RESOLVED", None):
            continue
        a, cause = notes[quote], causes.get(of_json(said))
        ok = status == "PENDING" and cause and cause[1] in c.LOCAL and cause[2] in notes and notes[cause[2]]["book"] == a["book"] and cause[2] != quote
        ok = ok and version == a["version"] and not a["locked"] and a["source"] == "MODEL" and a["id"] not in structural and a["book"] != 5
        restored, written = bool(ok and a["stale"]), bool(ok and a["stale"] and (a["id"], a["version"]) not in had)
        if restored:
            a["stale"], a["version"] = False, a["version"] + 1
        want[item] = ("refused" if a["book"] == 5 else "resolved" if ok else "preserved", restored, written, a["version"] if restored else None)
    done = c.cleaned(*[spark.createDataFrame(t[k], KINDS[k]) for k in KINDS])
    got = {x.item: (x.verdict, x.restored, x.written, x.version if x.restored else None) for x in done.collect()}
    assert got == want and {v[0] for v in want.values()} == {"refused", "resolved", "preserved"} and sum(v[1] for v in want.values()) > 5
    summary = {x.book: x for x in c.cleanup_summary(done).collect()}
    assert sum(x.resolved_records for x in summary.values()) == sum(v[0] == "resolved" for v in want.values()) and [b for b, x in summary.items() if x.refused] == [5]


def test_undone(spark):
    t = tables(random.Random(9))
    t["corrections"] += [(f"h{k}", "QUOTE", "q0", k // 2 if k % 7 else None, None, f"h{k}", 100 + k) for k in range(60)]
    t["annotations"] = [x for x in t["annotations"] if x[2] != "q0"] + [("aq0", 0, "q0", 3, False, False, "MODEL", "now")]
    now, want = {x[2]: x[3] for x in t["annotations"]}, {"none": ("no_correction", None, None)}
    for id_, kind, quote, version, undone_by, speaker, _ in sorted(t["corrections"], key=lambda x: (x[6], x[0])):
        wrong = "not_local" if kind not in c.LOCAL else "already_undone" if undone_by else "no_annotation" if quote not in now else None
        if wrong is None and version in (None, now[quote]):
            now[quote] += 1
            want[id_] = ("undone", now[quote], speaker)
        else:
            want[id_] = (wrong or "changed_since", None, None)
    asked = spark.createDataFrame([(x[0],) for x in t["corrections"]] + [("none",), ("none",)], "id string")
    got = c.undone(asked, *[spark.createDataFrame(t[k], KINDS[k]) for k in ("corrections", "annotations")]).collect()
    assert {x.id: (x.verdict, x.version, x.speaker) for x in got} == want and len(got) == len(want)
    assert len({v[0] for v in want.values()}) == 6


def test_deleted_and_empty(spark):
    make = lambda rows, schema="book long, id string": spark.createDataFrame(rows, schema)
    held = {"quotes": make([(1, "q"), (2, "r"), (3, "s"), (None, "n")]), "gaps": make([(1, "g")]), "annotations": make([(1, "a"), (1, "q")])}
    asked, jobs = make([(1,), (2,), (2,)], "book long"), make([(2, "QUEUED"), (1, "FAILED")], KINDS["jobs"])
    rows = make([(k, "QUOTE", t, None, None, None, 0) for k, t in [("1", "q"), ("2", "r"), ("3", "s"), ("4", "g"), ("5", "a"), ("6", None), ("7", "gone"), ("8", "n")]], KINDS["corrections"])
    verdicts, gone = c.deleted(asked, jobs, rows, **held)
    assert sorted(map(tuple, verdicts.collect())) == [(1, "deleted"), (2, "refused")] and sorted(map(tuple, gone.collect())) == [("1", 1), ("4", 1), ("5", 1)]
    none = {k: make([], s) for k, s in KINDS.items()}
    assert c.cleaned(*none.values()).count() == 0 and c.undone(make([], "id string"), none["corrections"], none["annotations"]).count() == 0
