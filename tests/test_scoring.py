import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.operators import scoring
from weftline.plans import evaluation
from weftline.schemas import ENTRY, GOLD, RECORD


def matched(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, matcher string, gold string, pred string, aliases array<string>")
    return [r["matched"] for r in scoring.decide(df, aliases="aliases").orderBy("i").collect()]


def test_matchers(spark):
    rows = [
        ("date", "2026-08-19", "August 19, 2026", None, True), ("date", "x", "x", None, False), ("acronym", " ICML ", "icml", None, True), ("edition", "38", "38", None, True),
        ("edition", "x", "1", None, False), ("string", "Vancouver", "Vancouver, BC", None, True), ("string", "Neural Systems", "x", None, True if "x" in "neural systems" else False),
        ("string", "Wien", "Vienna", ["Vienna"], True), ("string", "Wien", "Vienna", None, False), ("string", "a b", "", None, False), ("country", "USA", "United States", None, True),
        ("country", "UK", "England", None, True), ("country", "DE", "Germany", None, False), ("topic", "learning machines", "machines learning", None, True), ("speaker", "Dr. José Núñez", "Jose Nunez", None, True),
        ("speaker", "John Smith", "Smith", None, True), ("speaker", "John", "Mary", None, False), ("string", None, "x", None, False), ("country", "Atlantis", "Atlantis Island", None, True),
    ]
    assert matched(spark, [r[:4] for r in rows]) == [r[4] for r in rows]


def plain_greedy(m):
    used, tp = set(), 0
    for row in m:
        for j, ok in enumerate(row):
            if ok and j not in used:
                used.add(j)
                tp += 1
                break
    return tp, (len(m[0]) if m else 0) - tp, len(m) - tp


def test_greedy(spark):
    cases = [[[True, True, False], [True, False, False]], [[False]], [], [[]], [[True], [True]]]
    import random

    r = random.Random(2)
    for _ in range(100):
        w = r.randrange(1, 5)
        cases.append([[r.random() < 0.4 for _ in range(w)] for _ in range(r.randrange(1, 5))])
    df = spark.createDataFrame(list(enumerate(cases)), "i int, m array<array<boolean>>")
    got = [tuple(x["g"]) for x in df.orderBy("i").select(scoring.greedy(F.col("m"), F.coalesce(F.size(F.get("m", F.lit(0))), F.lit(0))).alias("g")).collect()]
    assert got == [plain_greedy(c) for c in cases]
    assert got[0] == (1, 2, 1)


def entry(model, url, data, status="ok", warnings=(), **more):
    return json.dumps({"model": model, "url": url, "status": status, "warnings": list(warnings), "data": data, "elapsed_sec": 2.0, "attempts": 1, "backend": "b", **more})


def evaluated(spark, entries, gold):
    e = spark.createDataFrame([(i, x) for i, x in enumerate(entries)], "seq int, j string").select("seq", F.from_json("j", ENTRY).alias("e")).select("seq", "e.*")
    g = spark.createDataFrame([(x,) for x in gold], "j string").select(F.from_json("j", GOLD).alias("g")).select("g.*")
    from weftline.functions.text import url_key

    return evaluation.evaluate(e, g.withColumn("url_key", url_key(F.col("url"))).drop("url"))


def test_evaluation(spark):
    truth = {"conference": {"full_name": "Neural Systems", "acronym": "NS", "edition_number": 3}, "dates": {"start_date": "2026-08-19"}, "topics": ["a b", "c d"], "keynote_speakers": [], "venue": {"city": "Wien"}}
    gold = [json.dumps({"url": "https://www.a.org/", "ground_truth": truth, "aliases": {"venue.city": ["Vienna"]}})]
    pred = {"conference": {"full_name": "The Neural Systems", "acronym": "XX"}, "dates": {"start_date": "19/08/2026", "end_date": "2026-08-21"}, "topics": ["c d", "zz yy", "b a"], "keynote_speakers": [{"name": "N"}], "venue": {"city": "Vienna"}}
    entries = [
        entry("m", "http://a.org", pred), entry("m", "http://b.org", pred), entry("m", "http://a.org", {}, "error"), entry("m", "http://a.org", {}, warnings=["Could not fetch any pages"]),
        entry("n", "http://a.org", {}), json.dumps({"model": "o", "url": "http://a.org", "data": pred}),
    ]
    found = evaluated(spark, entries, gold)
    assert sorted(r["scored_as"] for r in found.labelled.collect()) == ["crashed", "fetch_failed", "missing", "scored", "scored", "scored"]
    models = {m["model"]: m for m in evaluation.as_dicts(found)}
    m = models["m"]
    assert (m["n_examples"], m["errors"], m["fetch_failures"], m["avg_latency_sec"], m["backend"]) == (1, 1, 1, 2.0, "b")
    assert models["o"]["errors"] == 1 and models["o"]["n_examples"] == 1
    topics = m["by_field"]["topics"]
    assert (topics["tp"], topics["fn"], topics["fp_wrong"], topics["support"]) == (2, 0, 1, 3)
    assert topics["precision"] == topics["recall"] == 2 / 3
    speakers = m["by_field"]["keynote_speakers"]
    assert (speakers["fp_wrong"], speakers["fp_halluc"], speakers["hallucination_rate"]) == (1, 0, 0.0)
    assert m["by_field"]["dates.end_date"]["fp_halluc"] == 1 and m["by_field"]["conference.acronym"]["fp_wrong"] == 1 and m["by_field"]["venue.city"]["tp"] == 1
    assert m["by_category"]["publication"]["tn"] == 2 and m["by_category"]["publication"]["f1"] == 0.0
    assert abs(m["macro_f1_categories"] - sum(c["f1"] for c in m["by_category"].values()) / 7) < 1e-12
    for x in models.values():
        for k in scoring.COUNTS:
            assert x["overall"][k] == sum(c[k] for c in x["by_category"].values()) == sum(c[k] for c in x["by_field"].values())
    assert found.fields.where("outcome is not null").count() == 36 and found.fields.where("outcome is null").count() == 9
    text = evaluation.report(evaluation.as_dicts(found))
    assert "(no data)" in text and evaluation.model_line(m).startswith("m ")
    assert {r["path"] for r in evaluation.differences(found).where("model = 'm'").collect()} >= {"topics", "conference.acronym"}


@given(st.lists(st.integers(0, 9), min_size=5, max_size=5))
@settings(max_examples=15, deadline=None)
def test_ratios(spark, counts):
    tp, fn, wrong, made, tn = counts
    r = scoring.with_ratios(spark.createDataFrame([("m", *map(int, counts))], "model string, " + ", ".join(f"{c} long" for c in scoring.COUNTS))).first()
    p = tp / (tp + wrong + made) if tp + wrong + made else 0.0
    q = tp / (tp + fn + wrong) if tp + fn + wrong else 0.0
    assert r["precision"] == p and r["recall"] == q and r["support"] == tp + fn + wrong
    assert abs(r["f1"] - (2 * p * q / (p + q) if p + q else 0.0)) < 1e-12
    assert r["hallucination_rate"] == (made / (made + tn) if made + tn else 0.0)


def test_record_schema_reads_entries(spark):
    assert spark.createDataFrame([], f"r {RECORD}").select("r.dates.start_date").schema[0].dataType.simpleString() == "string"
