"""Reasons to look at answers again, held against a plain walk over random windows."""

import random
import re

import pytest

from narrata.operators import risks

KINDS = {
    "targets": "win long, i long, quote_id string", "labels": "win long, quote_id string, kind string, assignment string, basis string, speaker string, evidence array<string>",
    "context": "win long, ref string, text string", "people": "win long, character_id string, existing_ref string, name string, aliases array<string>",
    "declared": "win long, temp_ref string, character_id string", "requested": "win long, quote_id string",
}


def expected(t, stride):
    out = {}
    for win in {x[0] for x in t["targets"]}:
        of = lambda k: [x[1:] for x in t[k] if x[0] == win]  # noqa: E731, B023
        targets = [q for _, q in sorted(of("targets"))]
        labels, context = {x[0]: x[1:] for x in of("labels")}, dict(of("context"))
        declared, asked = dict(of("declared")), {q for (q,) in of("requested")}
        users = {}
        for _, _, _, who, refs in labels.values():
            for e in refs or []:
                users.setdefault(e, set()).update([who] if who else [])
        weak = lambda x: x[1] == "UNKNOWN" or x[0] == "unknown" or x[2] in risks.WEAK
        for k, q in enumerate(targets):
            why = ["requested_context"] * (q in asked)
            if q not in labels:
                why.append("missing_label")
            else:
                kind, assignment, basis, who, refs = labels[q]
                outside = [e for e in refs or [] if e != q and e in context]
                people = of("people")
                person = [p for p in people if (p[0] == declared[who] if who in declared else p[1] == who and who is not None) and (who not in declared or declared[who])]
                names = [n for p in person[:1] for n in [p[2], *(p[3] or [])] if n]
                text = "\n".join(context[e] or "" for e in outside)
                why += ["speech_type_ambiguity"] * (kind != "speech") + ["unknown"] * (assignment == "UNKNOWN" or kind == "unknown") + ["weak_basis"] * (basis in risks.WEAK)
                why += ["no_external_evidence"] * (kind == "speech" and not outside) + ["new_identity"] * (who in declared and not declared[who])
                why += ["direct_relation_unverified"] * (basis == "DIRECT" and not (any(n in text for n in names) and re.search(risks.VERBS, text)))
                why += ["shared_evidence_conflict"] * any(len(users[e]) > 1 for e in outside) + ["uncertain_evidence_chain"] * any(e in labels and weak(labels[e]) for e in outside)
                own = context.get(q) or ""
                why += ["addressed_person_conflict"] * (any(n in own for n in names) and not re.search(risks.ONESELF, own))
            why += ["window_edge"] * (k in (0, len(targets) - 1)) + ["accepted_sample_audit"] * (k % stride == 0)
            if why:
                out[win, q] = (k, why)
    return out


def test_at_random(spark):
    r = random.Random(4)
    t = {k: [] for k in KINDS}
    names = ["Ann", "Bo", "林", ""]
    for win in range(40):
        quotes = [f"q{k}" for k in range(r.randint(1, 12))]
        refs = [*quotes, "gone"]
        t["targets"] += [(win, k, q) for k, q in enumerate(quotes)]
        t["labels"] += [(win, q, r.choice(["speech", "speech", "thought", "unknown"]), r.choice(["EXISTING", "NEW", "UNKNOWN"]), r.choice(["DIRECT", "DIRECT", "STYLE_ONLY", None, "COREFERENCE"]), r.choice(["s1", "s2", "n1", "n2", None, ""]), r.choice([None, [], [r.choice(refs)], [r.choice(refs), r.choice(refs)]])) for q in quotes if r.random() < 0.85]
        t["context"] += [(win, q, r.choice([None, "", "Ann 说", "Bo", "我是 Ann", "林问 Bo", "x 答"])) for q in quotes if r.random() < 0.9]
        t["people"] += [(win, f"c{k}", f"s{k}", r.choice([*names, None]), r.choice([None, [], ["林"], ["Bo", None, ""]])) for k in (1, 2) if r.random() < 0.8]
        t["declared"] += [(win, f"n{k}", r.choice([None, "", "c1", "c9"])) for k in (1, 2) if r.random() < 0.7]
        t["requested"] += [(win, q) for q in refs if r.random() < 0.1]
    want = expected(t, 4)
    assert len({x for _, why in want.values() for x in why}) == 13
    got = risks.detected(*[spark.createDataFrame(t[k], KINDS[k]) for k in KINDS], stride=4).collect()
    assert {(x.win, x.quote_id): (x.i, x.reasons) for x in got} == want and len(got) == len(want)


def test_empty(spark):
    none = [spark.createDataFrame([], s) for s in KINDS.values()]
    assert risks.detected(*none).count() == 0
    with pytest.raises(ValueError):
        risks.detected(*none, stride=0)
