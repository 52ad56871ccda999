import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import records, verify
from weftline.schemas import RECORD

V = F.col("v")
FULL = {
    "conference": {"full_name": "A", "acronym": "B", "url": "u", "edition_number": 3}, "dates": {"start_date": "2026-01-01", "end_date": None}, "venue": {"city": None, "country": None},
    "deadlines": {"submission": None, "notification": None, "camera_ready": None}, "topics": [], "keynote_speakers": [], "program_committee": [], "publication": {"publisher": None, "series": None},
}


def merged(spark, basic=None, speakers=None, committee=None):
    df = spark.createDataFrame([(basic, speakers, committee)], "b string, s string, c string")
    return df.select(records.merge(F.lit("u"), F.col("b"), F.col("s"), F.col("c")).alias("r"))


def test_merge(spark):
    r = merged(spark, '{"full_name":null,"acronym":"X","submission_deadline":"2026-01-01","topics":null}', '{"keynote_speakers":[{"name":"N"}]}').first()["r"]
    assert r["conference"]["full_name"] == "" and r["conference"]["acronym"] == "X" and r["conference"]["url"] == "u"
    assert r["deadlines"]["submission"] == "2026-01-01"
    assert r["topics"] is None and r["program_committee"] == [] and r["keynote_speakers"][0]["name"] == "N"


def test_counts(spark):
    df = merged(spark, '{"full_name":"A","city":"C"}')
    r = df.select(records.null_fields(F.col("r")).alias("n"), records.filled_fields(F.col("r")).alias("f"), records.good_enough(F.col("r")).alias("g")).first()
    assert tuple(r["n"]) == (10, 13) and tuple(r["f"]) == (3, 16) and not r["g"]
    none = spark.createDataFrame([(None,)], f"r {RECORD}").select(records.filled_fields(F.col("r")).alias("f")).first()["f"]
    assert tuple(none) == (0, 3)


def test_fill_percent(values):
    got = values(list(range(17)), records.fill_percent(V, F.lit(16)), "v int")
    assert got == [round(n / 16 * 100, 1) for n in range(17)]
    assert got[1] == 6.2


@pytest.mark.parametrize(("nulls", "kept", "made"), [([6, 5, 5], 2, 3), ([4, 0, 0], 1, 1), ([5, 4, 0], 2, 2), ([None, None, None], 1, 3), ([None, 9, 9], 2, 3)])
def test_best_attempt(spark, nulls, kept, made):
    def record(n):
        if n is None:
            return None
        names = [("conference", "full_name"), ("conference", "acronym"), ("conference", "edition_number"), ("dates", "start_date"), ("dates", "end_date"), ("venue", "city"), ("venue", "country"), ("deadlines", "submission"), ("deadlines", "notification"), ("deadlines", "camera_ready"), ("publication", "publisher"), ("publication", "series")]
        doc = json.loads(json.dumps(FULL))
        for i, (s, k) in enumerate(names):
            doc[s][k] = None if i < n else 1 if k == "edition_number" else "x"
        return json.dumps(doc)

    rows = [("u", i + 1, record(n)) for i, n in enumerate(nulls)]
    df = spark.createDataFrame(rows, "site_url string, attempt int, j string").select("site_url", "attempt", F.from_json("j", RECORD).alias("record"))
    r = records.best_attempt(df, ["site_url"]).first()
    assert (r["attempt"], r["attempts"]) == (kept, made)


def test_shape(values):
    bad = json.loads(json.dumps(FULL))
    bad["conference"].pop("acronym")
    bad["conference"]["full_name"] = None
    bad["conference"]["edition_number"] = "38"
    bad["dates"] = []
    bad["topics"] = ["a", 1]
    bad["keynote_speakers"] = [{"name": None}, "x"]
    bad.pop("publication")
    got = values([json.dumps(FULL), json.dumps(bad), "[]"], records.shape_errors(V))
    assert got[0] == []
    assert set(got[1]) == {
        "'acronym' is a required property", "null is not of type 'string'", "\"38\" is not of type 'integer', 'null'", "[] is not of type 'object'", "1 is not of type 'string'",
        "\"x\" is not of type 'object'", "'publication' is a required property",
    }
    assert got[2] == ["[] is not of type 'object'"]


def validated(spark, doc, source):
    df = spark.createDataFrame([("k", json.dumps(doc), source)], "k string, j string, source string").select("k", F.from_json("j", RECORD).alias("record"), "source")
    return verify.validate(df).first()


def test_validate(spark):
    doc = json.loads(json.dumps(FULL))
    doc["conference"].update(full_name="Neural Systems", acronym="")
    doc["dates"].update(start_date="2026-08-20", end_date="2026-07-02")
    doc["venue"].update(city="Viena", country="Nowhereland")
    doc["publication"].update(publisher=None, series="Made up")
    doc["keynote_speakers"] = [{"name": "Ann Lee"}, {"name": "Zzyzx Qwrt"}, {"name": ""}]
    doc["program_committee"] = [{"name": ""}, {"name": "Ann Lee"}]
    r = validated(spark, doc, "<p>Neural systems in Vienna, 19-21 August 2026. Ann Lee speaks.</p>")
    level = {c["path"]: c["level"] for c in r["confidence"]}
    assert [c["path"] for c in r["confidence"]][:2] == ["conference.full_name", "conference.acronym"]
    assert level["conference.full_name"] == level["conference.acronym"] == level["dates.start_date"] == level["publication.publisher"] == "high"
    assert level["venue.city"] == "medium" and level["venue.country"] == "low" and level["dates.end_date"] == "low"
    assert [level[f"keynote_speakers[{i}].name"] for i in range(3)] == ["high", "low", "high"]
    assert [level[f"program_committee[{i}].name"] for i in range(2)] == ["low", "high"]
    out = r["record"]
    assert out["venue"]["country"] is None and out["venue"]["city"] == "Viena" and out["dates"]["end_date"] is None and out["publication"]["series"] == "Made up"
    assert [s["name"] for s in out["keynote_speakers"]] == ["Ann Lee", ""] and [s["name"] for s in out["program_committee"]] == ["Ann Lee"]
    assert r["warnings"] == [
        "[dates] start_date (2026-08-20) > end_date (2026-07-02)", "[source] low confidence: dates.end_date", "[source] low confidence: venue.country",
        "[source] low confidence: keynote_speakers[1].name", "[source] low confidence: program_committee[0].name",
    ]


def test_tags_in_the_source_hide_a_date(spark):
    doc = json.loads(json.dumps(FULL))
    doc["dates"]["start_date"] = "2026-08-19"
    assert validated(spark, doc, "August <b>19</b>, 2026")["record"]["dates"]["start_date"] is None
