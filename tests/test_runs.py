import json
import os

import pytest
from pyspark.sql import functions as F

from weftline.operators import batch
from weftline.plans import benchmark, extraction
from weftline.sources import fetch, readers, writers
from weftline.streaming import increments


def test_remaining_and_order(spark):
    todo = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("b", 3)], "url string, ord int")
    done = spark.createDataFrame([("b", "error"), ("b", "ok")], "url string, status string")
    assert sorted(r["url"] for r in batch.remaining(todo, done, ["url"]).collect()) == ["a", "c"]
    out = batch.in_input_order(spark.createDataFrame([("b",), ("z",), ("c",)], "url string"), todo, "url", "ord")
    assert {r["url"]: r["pos"] for r in out.collect()} == {"b": 3, "z": 0, "c": 2}


@pytest.mark.parametrize(("offset", "limit"), [(0, None), (2, None), (1, 2), (0, 0), (-2, None), (1, -1), (9, 1), (-3, -1)])
def test_part(spark, offset, limit):
    rows = spark.createDataFrame([(i,) for i in range(5)], "i int")
    want = list(range(5))[offset:][: limit if limit is not None else None]
    assert [r["i"] for r in batch.part(rows, "i", offset, limit).collect()] == want


def test_keep_last(spark):
    rows = spark.createDataFrame([("k", "f1", 2, None), ("k", "f2", 0, "x"), ("j", "f1", 0, "y"), ("k", "f2", 1, "z")], "k string, file string, pos int, v string")
    assert {r["k"]: r["v"] for r in batch.keep_last(rows, ["k"], ["file", "pos"]).collect()} == {"k": "z", "j": "y"}


def test_check(spark):
    inputs = spark.createDataFrame([("http://a", "x"), ("http://b", "y"), ("http://c", "z")], "website_url string, note string")
    fetched = spark.createDataFrame([("http://a", "http://a/", 200), ("http://b", "http://b", 200), ("http://c", None, None)], "url string, final_url string, status_code int")
    got = {r["website_url"]: r for r in batch.checked(inputs, fetched).collect()}
    assert got["http://a"]["redirected"] and not got["http://b"]["redirected"] and got["http://c"]["error"] == "Failed to fetch" and not got["http://c"]["redirected"]
    t = batch.check_totals(batch.checked(inputs, fetched), 2.0, 6).first()
    assert (t["done"], t["ok"], t["errors"], t["redirects"], t["rate"], t["eta"]) == (3, 2, 1, 1, 1.5, 2.0)


def test_check_of_inputs_of_one_address(spark):
    inputs = spark.createDataFrame([(0, "http://a"), (1, "http://a"), (2, "http://b")], "k int, website_url string")
    fetched = spark.createDataFrame([(0, "http://a", "http://a/", 200), (1, "http://a", None, None), (2, "http://b", "http://b", 500)], "k int, url string, final_url string, status_code int")
    own = {r["k"]: (r["status_code"], r["redirected"], r["error"]) for r in batch.checked(inputs, fetched, "k").collect()}
    assert own == {0: (200, True, None), 1: (None, False, batch.FAILED), 2: (500, False, None)}
    assert tuple(batch.check_totals(batch.checked(inputs, fetched, "k")).first()) == (3, 1, 1, 1)
    by_url = sorted((r["k"], r["status_code"]) for r in batch.checked(inputs, fetched).collect())
    assert by_url == [(0, 200), (1, 200), (2, 500)]


def test_summary(spark):
    rows = [("m", "u", "ok", 50.0, ["a"], 2.0, 0), ("m", "u", "ok", 6.2, [], 4.0, 1), ("m", "v", "error", 0.0, [], 1.0, 2), ("n", "u", "error", 0.0, [], 1.0, 3)]
    e = spark.createDataFrame(rows, "model string, url string, status string, fill_pct double, low_confidence_fields array<string>, elapsed_sec double, seq int")
    text = benchmark.summary(e, ["m", "n"], ["u", "v", "https://w"])
    assert "u | 6.2% h:0 | ERR" in text and "v | ERR | -" in text and "w | - | -" in text
    assert "m: avg_fill=6.2%  avg_time=4s  total_hallucinations=0  sites=1/3" in text and "n: no successful runs" in text


def test_readers(spark, tmp_path):
    (tmp_path / "list.json").write_text('[{"website_url": "u1",\n "x": 1},\n {"website_url": "u2"}]')
    got = readers.json_array(spark, str(tmp_path / "list.json")).orderBy("ord").collect()
    assert [r["website_url"] for r in got] == ["u1", "u2"] and json.loads(got[0]["raw"]) == {"website_url": "u1", "x": 1}
    (tmp_path / "bad.json").write_text("[{")
    with pytest.raises(ValueError, match="no JSON"):
        readers.json_array(spark, str(tmp_path / "bad.json"))
    assert readers.earlier_results(spark, str(tmp_path / "bad.json"), "website_url string").count() == 0
    assert readers.earlier_results(spark, str(tmp_path / "none.json"), "website_url string").count() == 0
    (tmp_path / "lines.txt").write_text("  a \n\n# c\nb # d\n")
    assert [r["line"] for r in readers.lines(spark, str(tmp_path / "lines.txt")).collect()] == ["a", "b # d"]


def test_models():
    text = "m1 --x 'a b' # note\n# c\n\nm2\n"
    assert readers.models(text) == [("m1", ["--x", "a b"]), ("m2", [])]
    assert readers.models(text, comments=False)[0] == ("m1", ["--x", "a b", "#", "note"])


def test_gold(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n{"url": "http://a.org",\n "ground_truth": {"venue": {"city": "X"}}, "aliases": {"venue.city": "Y", "p": ["q"], "n": null}}, 3, {"no": 1}]')
    (tmp_path / "b.json").write_text('{"url": "https://www.a.org/", "venue": {"city": "Z"}}')
    (tmp_path / "c.json").write_text("{")
    (tmp_path / "d.txt").write_text('{"url": "http://d.org"}')
    got = readers.gold(spark, str(tmp_path)).collect()
    assert [(r["url_key"], r["ground_truth"]["venue"]["city"]) for r in got] == [("a.org", "Z")]
    one = readers.gold(spark, str(tmp_path / "a.json")).collect()
    assert one[0]["aliases"] == {"venue.city": ["Y"], "p": ["q"], "n": []} and one[0]["ground_truth"]["venue"]["city"] == "X"


def test_results(spark, tmp_path):
    for path, text in {"m/u.json": '{"model": "m", "url": "u", "status": "ok"}', "m/v.json": "{", "m/w.json": '{"url": "w"}', "top.json": '{"model": "t"}', "m/p/x.json": '{"model": "p"}', "n/z.json": '{"model": null, "url": "z"}'}.items():
        os.makedirs((tmp_path / path).parent, exist_ok=True)
        (tmp_path / path).write_text(text)
    assert [(r["model"], r["url"]) for r in readers.results(spark, str(tmp_path)).orderBy("seq").collect()] == [("m", "u"), (None, "z")]


PAGES = {
    "http://a.org": '<title>Neural Systems 2026</title><p>Neural Systems, 19-21 August 2026, Vienna.</p><a href="/committee">Committee</a><a href="/gone">Venue</a>',
    "http://a.org/committee": "<title>Committee</title><p>Ann Lee, chair</p>",
    "http://b.org": "<p>nothing</p>",
}


def reply(prompt, model, name, attempt):
    if "Neural" not in prompt:
        if attempt == 3:
            return '{"start_date": 5}' if name == "basic" else None
        return None
    if name == "basic":
        good = '```json\n{"full_name": "Neural Systems", "acronym": "SYSTEMS", "edition_number": 3, "start_date": "2026-08-19", "end_date": "2026-08-21", "city": "Vienna", "country": "Austria", "topics": ["x"]}\n```'
        return good if attempt == 2 else '{"full_name": "Neural Systems"}'
    return '[{"name": "Ann Lee"}, {"name": "Zz Qq"}]'


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    sites = spark.createDataFrame([(u,) for u in ("http://a.org", "http://b.org", "http://none.org")], "site_url string")
    answer = lambda u: fetch.Answer(u, 200, PAGES[u]) if u in PAGES else None
    crawled = fetch.crawl(sites, lambda urls: fetch.fetch(urls, answer))
    rows = crawled.collect()
    folder = str(tmp_path_factory.mktemp("run"))
    entries = extraction.extract(spark.createDataFrame(rows, crawled.schema), sites, reply, folder, tries=3)
    return rows, {r["url"]: r for r in entries.collect()}, folder


def test_crawl(run):
    assert sorted((r["site_url"], r["crawl_idx"], r["url"]) for r in run[0]) == [("http://a.org", 0, "http://a.org"), ("http://a.org", 1, "http://a.org/committee"), ("http://b.org", 0, "http://b.org")]
    assert next(r for r in run[0] if r["crawl_idx"] == 1)["text"] == "Committee\nAnn Lee, chair"


def test_extraction(run, spark):
    a = run[1]["http://a.org"]
    assert a["status"] == "ok" and a["attempts"] == 3 and a["pages_fetched"] == 2
    assert a["data"]["conference"]["full_name"] == "Neural Systems" and a["data"]["dates"]["start_date"] == "2026-08-19"
    assert a["data"]["conference"]["acronym"] == "SYSTEMS" and a["data"]["venue"]["country"] is None
    assert [p["name"] for p in a["data"]["program_committee"]] == ["Ann Lee"]
    assert "venue.country" in a["low_confidence_fields"] and a["fields_total"] == 16 and a["fill_pct"] == round(a["fields_filled"] / 16 * 100, 1)
    b, none = run[1]["http://b.org"], run[1]["http://none.org"]
    assert b["status"] == "error" and "start_date" in b["error"]
    assert none["status"] == "ok" and none["warnings"] == ["Could not fetch any pages"] and none["attempts"] == 0 and none["data"]["topics"] == []
    asked = spark.read.option("recursiveFileLookup", True).parquet(f"{run[2]}/answers")
    assert asked.where("site_url = 'http://a.org' and target = 'basic'").count() == 3


def test_benchmark_and_writers(spark, run, tmp_path):
    crawled = spark.createDataFrame(run[0])
    out = benchmark.run(spark, crawled, lambda m: reply, str(tmp_path), [("m/1", ["--x"])], ["http://a.org", "http://none.org"])
    assert out.count() == 2 and "m/1: avg_fill" in (tmp_path / "summary.txt").read_text()
    assert json.loads((tmp_path / "benchmark.json").read_text())["models"] == [{"name": "m/1", "vllm_extra_args": ["--x"]}]
    assert (tmp_path / "results" / "model_dir=m_1" / "url_name=a_org").is_dir()
    back = {r["url"]: r for r in readers.results(spark, str(tmp_path / "results")).collect()}
    assert set(back) == {"http://a.org", "http://none.org"} and back["http://a.org"]["confidence"]["venue.country"] == "low" and back["http://a.org"]["model"] == "m/1"
    writers.report({"a": "é"}, str(tmp_path / "r.json"))
    assert "é" in (tmp_path / "r.json").read_text()


def test_run_list(spark, run, tmp_path):
    (tmp_path / "in.json").write_text('[{"website_url": "http://none.org", "x": 1}, {"website_url": "http://a.org"}, {"website_url": "http://b.org"}]')
    inputs = readers.json_array(spark, str(tmp_path / "in.json"))
    done = spark.createDataFrame([("http://b.org", "m"), ("http://a.org", "other")], "website_url string, model string")
    out = benchmark.run_list(inputs, spark.createDataFrame(run[0]), reply, str(tmp_path / "w"), "m", done=done)
    writers.batch_rows(out, str(tmp_path / "out.json"), [{"wikicfp": {"website_url": "http://b.org"}}])
    rows = json.loads((tmp_path / "out.json").read_text())
    assert [r["wikicfp"]["website_url"] for r in rows] == ["http://b.org", "http://none.org", "http://a.org"] and rows[1]["wikicfp"]["x"] == 1
    assert rows[2]["meta"]["status"] == "ok" and rows[2]["extracted"]["conference"]["full_name"] == "Neural Systems" and rows[1]["meta"]["attempts"] == 0
    again = readers.earlier_results(spark, str(tmp_path / "out.json"), "wikicfp struct<website_url:string>, meta struct<model:string>")
    assert again.where("meta.model = 'm'").count() == 2


def test_command_line(spark, run, tmp_path, capsys):
    from weftline import cli

    assert cli.main(["evaluate", "--gold", str(tmp_path / "none"), "--results", str(tmp_path)]) == 2
    (tmp_path / "gold").mkdir()
    (tmp_path / "gold" / "a.json").write_text('{"url": "http://a.org", "ground_truth": {"venue": {"city": "X"}}}')
    (tmp_path / "res" / "m").mkdir(parents=True)
    (tmp_path / "res" / "m" / "u.json").write_text('{"model": "m", "url": "http://a.org", "status": "ok", "data": {"venue": {"city": "x"}}}')
    assert cli.main(["evaluate", "--gold", str(tmp_path / "gold"), "--results", str(tmp_path / "res"), "--json-out", str(tmp_path / "o.json"), "--text-out", str(tmp_path / "o.txt"), "--debug"]) == 0
    got = json.loads((tmp_path / "o.json").read_text())
    assert got["n_gold"] == 1 and got["models"][0]["overall"]["tp"] == 1 and "m " in (tmp_path / "o.txt").read_text()


def test_servers():
    assert extraction.server("vllm").endswith(":8000") and extraction.server("x").endswith(":11434")
    with pytest.raises(ValueError, match="Unknown backend"):
        extraction.over_http("x")
    assert extraction.nothing("p", "m", "basic", 1) is None


def test_follow(spark, tmp_path):
    inputs, results, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    os.makedirs(inputs)
    work = lambda df: df.withColumn("status", F.lit("ok"))

    def step(name, urls):
        (tmp_path / "in" / name).write_text("".join(json.dumps({"url": u}) + "\n" for u in urls))
        increments.follow(spark, inputs, "url string", work, results, state, ["url"]).awaitTermination()
        return sorted((r["url"], r["batch"]) for r in spark.read.option("recursiveFileLookup", True).parquet(results).collect())

    assert step("1.json", ["a", "b", "a"]) == [("a", 0), ("b", 0)]
    assert step("2.json", ["b", "c"]) == [("a", 0), ("b", 0), ("c", 1)]
