"""Issues of outputs, each code by itself and all of them on random outputs."""

import collections
import random

from pyspark.sql import functions as F

from narrata.operators import validation as v

KINDS = {
    "targets": "win long, kind string, ref string, position long", "updates": "win long, i long, temp_ref string, after_gap string, starts_at string",
    "decisions": "win long, i long, gap string, decision string",
    "speakers": "win long, i long, temp_ref string, scene string, first_quote string, character string, name string, real_name string, evidence long",
    "labels": "win long, i long, quote string, scene string, speaker string, assignment string, owned boolean, evidence array<string>", "needs": "win long, quote string",
}


def expected(t):
    """Codes and references of one window's output."""
    of = lambda kind: [x[2] for x in sorted(t["targets"], key=lambda x: x[3]) if x[1] == kind]
    quotes, gaps, scenes, allowed = of("quote"), of("gap"), of("scene"), of("speaker")
    first = scenes[0] if scenes else v.CURRENT
    breaks = {d[2] for d in t["decisions"] if d[3] == "BREAK"}
    out = []
    for k, (_, _, ref, gap, start) in enumerate(t["updates"]):
        earlier = t["updates"][:k]
        out += [("duplicate_scene_ref", ref)] * (ref in scenes or ref in [x[2] for x in earlier]) + [("duplicate_scene_update", gap)] * (gap in [x[3] for x in earlier])
        out += [("duplicate_scene_start", start)] * (start in [x[4] for x in earlier]) + [("unknown_gap_in_scene_update", ref)] * (gap not in gaps)
        out += [("scene_update_without_break", ref)] * (gap in gaps and gap not in breaks) + [("unknown_quote_in_scene_update", ref)] * (start not in quotes)
    out += [("break_without_scene_update", g) for g in breaks - {x[3] for x in t["updates"]}]
    starts, made = {x[4]: x[2] for x in t["updates"]}, {x[2] for x in t["updates"]}
    scene, at = {}, first
    for q in quotes:
        scene[q] = at = starts.get(q, at)
    home = {}
    for _, _, ref, where, begin, person, name, real, evidence in t["speakers"]:
        good = lambda x: bool(x) and x in ("Anna", "悠太")
        out += [("unknown_character_in_speaker", ref)] * (bool(person) and person not in of("character")) + [("missing_character_evidence", ref)] * (bool(person) and not evidence)
        out += [("missing_speaker_name", ref)] * (not good(name) and not (name is None and bool(person) and person in of("declared")))
        out += [("missing_real_name_evidence", ref)] * (bool(real) and (not good(real) or not evidence)) + [("duplicate_speaker_ref", ref)] * (ref in home)
        out += [("unknown_scene_in_speaker", ref)] * (where not in scenes and where not in made) + [("unknown_quote_in_speaker", ref)] * (begin not in quotes)
        home[ref] = where
        used = sorted((quotes.index(x[2]) if x[2] in quotes else 99, x[1], x[2], x[5]) for x in t["labels"] if x[4] == ref and x[6])
        if used and ref not in allowed and used[0][2:] != (begin, "NEW"):
            out.append(("speaker_used_before_creation", used[0][2]))
    for k, d in enumerate(t["decisions"]):
        out += [("duplicate_gap_decision", d[2])] * (d[2] in [x[2] for x in t["decisions"][:k]]) + [("unknown_gap", d[2])] * (d[2] not in gaps)
    for k, (_, _, q, where, who, how, owned, evidence) in enumerate(t["labels"]):
        known = of("evidence")
        wrong = [
            ("duplicate_label", q in [x[2] for x in t["labels"][:k]]), ("unknown_quote", q not in quotes), ("unknown_scene", where not in scenes and where not in made),
            ("speaker_scene_mismatch", where != scene.get(q)),
            ("old_scene_speaker" if scene.get(q) != first else "unknown_speaker", owned and how == "EXISTING" and not (scene.get(q) == first and who in allowed) and home.get(who, "?") != scene.get(q)),
            ("undeclared_new_speaker", owned and how == "NEW" and who not in home), ("speaker_scene_mismatch", owned and how == "NEW" and home.get(who) != where),
            ("unknown_evidence", bool(known) and not set(evidence or []) <= set(known)),
        ]
        out += [(next(c for c, bad in wrong if bad), q)] if any(bad for _, bad in wrong) else []
    out += [("missing_targets", None)] * bool(set(quotes) - {x[2] for x in t["labels"]}) + [("unknown_needs_context", q) for _, q in t["needs"] if q not in quotes]
    return out


def at_random(r, win):
    some = lambda p, n: [f"{p}{k}" for k in range(r.randrange(n))]
    q, g, s = lambda: f"q{r.randrange(6)}", lambda: f"g{r.randrange(4)}", lambda: r.choice(["s0", "n1", "n2", v.CURRENT])
    w = lambda: r.choice(["S1", "S2", "new1", "new2"])
    held = {"quote": some("q", 6), "gap": some("g", 4), "scene": some("s", 2), "speaker": ["S1", "S2"][: r.randrange(3)], "character": ["c1"], "declared": r.choice([[], ["c1"]]), "evidence": r.choice([[], ["e1", "e2"]])}
    name = lambda: r.choice(["Anna", "悠太", None, "", "new1", "未知", "a，b", "x" * 40])
    return {
        "targets": [(win, kind, ref, k) for kind, refs in held.items() for k, ref in enumerate(refs)],
        "updates": [(win, i, r.choice(["n1", "n2", "s0"]), g(), q()) for i in range(r.randrange(3))], "decisions": [(win, i, g(), r.choice(["BREAK", "CONTINUE"])) for i in range(r.randrange(4))],
        "speakers": [(win, i, w(), s(), q(), r.choice([None, "", "c1", "c2"]), name(), name(), r.randrange(2)) for i in range(r.randrange(3))],
        "labels": [(win, i, q(), s(), w(), r.choice(["NEW", "EXISTING", "UNKNOWN", None]), r.random() < 0.8, r.choice([None, [], ["e1"], ["e1", "e9"]])) for i in range(r.randrange(7))],
        "needs": [(win, q()) for _ in range(r.randrange(2))],
    }


def test_issues_of_random_outputs(spark):
    r = random.Random(12)
    windows = [at_random(r, k) for k in range(250)]
    tables = {name: spark.createDataFrame([x for w in windows for x in w[name]], kind) for name, kind in KINDS.items()}
    got = collections.Counter(map(tuple, v.issues(**tables).collect()))
    want = collections.Counter((k, *x) for k, w in enumerate(windows) for x in expected(w))
    assert got == want and len({c for _, c, _ in want}) == 27
    accepted = v.judged_labels(tables["targets"], tables["updates"], tables["speakers"], tables["labels"]).filter("code IS NULL").count()
    labels = {"duplicate_label", "unknown_quote", "unknown_scene", "speaker_scene_mismatch", "old_scene_speaker", "unknown_speaker", "undeclared_new_speaker", "unknown_evidence"}
    assert accepted == sum(len(w["labels"]) for w in windows) - sum(n for (_, c, _), n in want.items() if c in labels) > 0


def test_no_output(spark):
    tables = {name: spark.createDataFrame([], kind) for name, kind in KINDS.items()}
    assert v.issues(**tables).count() == 0
    tables["targets"] = spark.createDataFrame([(1, "quote", "q", 0)], KINDS["targets"])
    assert [tuple(x) for x in v.issues(**tables).collect()] == [(1, "missing_targets", None)]


def test_names_of_speakers(spark):
    cases = {"Anna": True, " 悠太 ": True, "": False, None: False, "S12": False, "new3": False, "NEW3": False, "未知": False, "a，b": False, "第一人称": False, "向他搭讪": False, "x" * 33: False, "S12b": True}
    df = spark.createDataFrame([(k, c) for k, c in cases.items()], "name string, good boolean")
    assert df.filter(v.is_name(F.col("name")) != F.col("good")).count() == 0
