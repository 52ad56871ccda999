import random
import re

from weftline.llm import license_rules as licenses

from .license_wordings import WORDINGS

RULES = licenses.rules()


def brute(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    base = [(i, label) for p, label in licenses.BASE.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    n = " " + " ".join(ws) + " "
    found = [(m.start(), m.end(), r.priority, r.id) for r in RULES if any(k in n for k in r.keywords) for m in re.finditer(r.regex, n)]
    within = lambda d, e: e[0] <= d[0] and e[1] >= d[1] and (e[2] > d[2] or (e[2] == d[2] and (e[0], -e[1], e[3]) < (d[0], -d[1], d[3])))
    keep = [d for d in found if not any(e is not d and within(d, e) for e in found)]
    labels = {label for _, label in base} | {RULES[d[3]].label for d in keep}
    at = [i for i, _ in base]
    return (len(ws), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), max([RULES[d[3]].confidence for d in keep], default=0.0))


def test_rules():
    assert len(RULES) > 200 and len({(r.label, r.regex) for r in RULES}) == len(RULES) and [r.id for r in RULES] == list(range(len(RULES)))
    assert all(0 <= r.priority <= 5 and 0 < r.confidence <= 1 for r in RULES)


def sample(pattern, r):
    """A random text that the pattern matches."""
    out = []
    for op, arg in pattern:
        op = str(op)
        if op == "LITERAL":
            out.append(chr(arg))
        elif op == "IN":
            kind, value = r.choice(arg)
            out.append({"LITERAL": lambda v: chr(v), "RANGE": lambda v: chr(r.randint(*v)), "CATEGORY": lambda v: "7" if "DIGIT" in str(v) else "q"}[str(kind)](value))
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            lo, hi, inner = arg
            out += [sample(inner, r) for _ in range(r.randint(lo, min(int(hi), lo + 3)))]
        elif op == "SUBPATTERN":
            out.append(sample(arg[-1], r))
        elif op == "BRANCH":
            out.append(sample(r.choice(arg[1]), r))
        else:
            assert op in ("ASSERT", "ASSERT_NOT"), op
    return "".join(out)


def test_every_match_passes_the_gate_and_holds_a_keyword():
    r = random.Random(2)
    for rule in RULES:
        for _ in range(60):
            t = sample(re._parser.parse(rule.regex), r)
            assert re.search(rule.regex, f" {t} "), (rule, t)
            assert any(k in f" {t} " for k in rule.keywords), (rule, t)
            assert any(g in t for g in licenses.GATE) or re.search(licenses.GATE_WORDS, t), (rule, t)


def test_real_wordings(spark):
    """Wordings as headers, manifests and notices have them, none of which a rule was made from; each of at least 19 in 20 gets its label, and texts about other things get none."""
    cases = [line.split(": ", 1) for line in WORDINGS.strip().split("\n")]
    assert len(cases) >= 200
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {x["doc_id"]: set(x["labels"].split(",")) for x in licenses.licenses(df).collect()}
    hit = [want == "none" and got[i] == {""} or want in got[i] for i, (want, _) in enumerate(cases)]
    missed = [(want, t, got[i]) for (i, (want, t)), ok in zip(enumerate(cases), hit) if not ok]
    assert sum(hit) >= 0.95 * len(hit), missed
    assert all(got[i] == {""} for i, (want, _) in enumerate(cases) if want == "none")


def test_query(spark, docs, none):
    r = random.Random(3)
    vocabulary = (
        "the mit license apache License, Version 2.0 1.1 gnu general public license cc by nc sa 4.0 3.0 licensed under spdx-license-identifier: gpl only or later is in public domain "
        "all rights reserved CC-BY bsd 3 clause mozilla creative commons attribution non commercial é x İ"
    ).split()
    texts = [None, "", "MIT LICENSE mit license", "cc by cc by-nc 4.0", "ünder GNU General Public License", "SPDX-License-Identifier: Apache-2.0", "cc\n by 3.0", "permission is hereby granted, free of charge, to any person obtaining a copy of this software"]
    texts += [" ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 30))) for _ in range(300)] + ["mit license " * 2000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = {x["doc_id"]: tuple(x)[1:] for x in licenses.licenses(df).collect()}
    assert {i: brute(t) for i, t in enumerate(texts) if i < len(texts) - 1} == {i: v for i, v in got.items() if i < len(texts) - 1}
    assert got[len(texts) - 1][:6] == (4000, 2000, 0, 3998, "mit", "mit")
    assert licenses.licenses(none).collect() == [] and licenses.licenses(docs).count() == docs.count()


def test_native(spark, docs):
    plan = licenses.licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
