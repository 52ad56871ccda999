"""Command line: extract, evaluate, check and follow."""

from __future__ import annotations

import argparse
import json
import sys
import time
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import batch
from .plans import benchmark, evaluation, extraction
from .session import session
from .sources import fetch, readers, writers


def _extract(a: argparse.Namespace) -> int:
    """Run models over sites that have no result yet."""
    spark = session()
    if a.models_file:
        with open(a.models_file, encoding="utf-8") as f:
            models = readers.models(f.read())
    else:
        models = [(m, []) for m in a.model] if a.model else batch.DEFAULT_MODELS
    urls = [r["line"] for r in readers.lines(spark, a.urls_file).collect()] if a.urls_file else a.url or batch.DEFAULT_URLS
    rows = spark.createDataFrame(list(enumerate(urls)), "ord int, site_url string")
    rows = batch.part(rows, "ord", a.offset, a.limit)
    if a.done:
        done = readers.results(spark, a.done).select(F.col("url").alias("site_url"))
        rows = batch.remaining(rows, done, ["site_url"])
    urls = [r["site_url"] for r in rows.orderBy("ord").collect()]
    if not urls:
        print("Nothing to do")
        return 0
    sites = spark.createDataFrame([(u,) for u in urls], "site_url string")
    fetch.crawl(sites, lambda u: fetch.fetch(u.repartition(a.workers))).write.mode("overwrite").parquet(f"{a.out}/pages")
    crawled = spark.read.parquet(f"{a.out}/pages")
    ask = extraction.over_http(a.backend, a.base_url)
    benchmark.run(spark, crawled, lambda model: ask, a.out, models, urls, a.backend)
    if a.prompts:
        for i, _ in enumerate(models):
            work = f"{a.out}/runs/{i}/work"
            writers.exchanges(spark.read.option("recursiveFileLookup", True).parquet(f"{work}/answers").withColumn("pass", F.col("target")), f"{a.out}/prompts/{i}")
    return 0


#: Sites of a list after which its results are saved, and addresses after which a check is.
SAVE_SITES, SAVE_CHECKS = 5, 100


def _parts(rows: DataFrame, each: int) -> Iterator[DataFrame]:
    """rows by their place (ord), so many at a time."""
    for lo in range(0, rows.count(), each):
        yield batch.part(rows, "ord", lo, each)


def _batch(a: argparse.Namespace) -> int:
    """Run models over a JSON list of sites, one output file for each model, saved as it grows."""
    spark = session()
    inputs = readers.json_array(spark, a.input)
    inputs = batch.part(inputs, "ord", a.offset, a.limit)
    sites = inputs.select(F.col("website_url").alias("site_url")).distinct()
    fetch.crawl(sites, lambda u: fetch.fetch(u.repartition(a.workers))).write.mode("overwrite").parquet(f"{a.out}/pages")
    crawled, ask = spark.read.parquet(f"{a.out}/pages"), extraction.over_http(a.backend, a.base_url)
    for i, (model, args) in enumerate([(m, []) for m in a.model] if a.model else batch.DEFAULT_MODELS):
        path = f"{a.out}/{model.replace('/', '_').replace(':', '_')}.json"
        earlier = readers.earlier_results(spark, path, "wikicfp struct<website_url:string>, meta struct<model:string>")
        done = earlier.select("wikicfp.website_url", "meta.model")
        said = [json.loads(r["raw"]) for r in earlier.orderBy("ord").collect()]
        todo = batch.remaining(inputs, done.where(F.col("model") == model), ["website_url"]).persist()
        for n, part in enumerate(_parts(todo, SAVE_SITES)):
            out = benchmark.run_list(part, crawled, ask, f"{a.out}/runs/{i}/{n}", model, a.backend, args, done)
            said = writers.batch_rows(out, path, said)
        if not said:
            writers.report(said, path)
    return 0


def _evaluate(a: argparse.Namespace) -> int:
    spark = session()
    try:
        gold, entries = readers.gold(spark, a.gold), readers.results(spark, a.results)
        if not gold.limit(1).count() or not entries.limit(1).count():
            print("No gold entries or no results", file=sys.stderr)
            return 2
    except Exception as error:  # noqa: BLE001  a missing folder is the user's to mend
        if "PATH_NOT_FOUND" not in str(error):
            raise
        print(error, file=sys.stderr)
        return 2
    found = evaluation.evaluate(entries, gold)
    if a.model:
        found = evaluation.evaluate(entries.where(F.col("model").isin(a.model)), gold)
    models = evaluation.as_dicts(found)
    text = evaluation.report(models)
    print(text)
    if a.debug:
        evaluation.differences(found).orderBy("model", "url", "path").show(200, truncate=60)
    if a.text_out:
        writers.text(text + "\n", a.text_out)
    if a.json_out:
        writers.report({"gold_dir": a.gold, "results_dir": a.results, "n_gold": gold.count(), "models": models}, a.json_out)
    return 0


def _check(a: argparse.Namespace) -> int:
    spark = session()
    inputs = readers.json_array(spark, a.input)
    began = time.time()
    done = readers.earlier_results(spark, a.output, "website_url string")
    todo = batch.remaining(inputs, done, ["website_url"])
    rows = [json.loads(r["raw"]) for r in done.orderBy("ord").collect()]
    place = {r["website_url"]: r["ord"] for r in inputs.select("website_url", "ord").collect()}
    results, todo = [], todo.persist()
    for part in _parts(todo, SAVE_CHECKS):
        got = fetch.fetch(part.select(F.col("website_url").alias("url")).distinct().repartition(a.workers)).drop("html")
        checked = batch.checked(part, got).persist()
        rows += [json.loads(r["raw"]) | {k: r[k] for k in ("final_url", "status_code", "redirected", "error")} for r in batch.in_input_order(checked, inputs, "website_url", "ord").orderBy("pos").collect()]
        writers.report(sorted(rows, key=lambda r: place.get(r["website_url"], 0)), a.output)
        results.append(checked)
    if results:
        batch.check_totals(reduce(DataFrame.unionByName, results), time.time() - began, inputs.count()).show(truncate=False)
    else:
        writers.report(sorted(rows, key=lambda r: place.get(r["website_url"], 0)), a.output)
    return 0


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="weftline", description=__doc__)
    sub = parser.add_subparsers(required=True)
    e = sub.add_parser("extract", help=_extract.__doc__)
    e.add_argument("--model", action="append")
    e.add_argument("--models-file")
    e.add_argument("--url", action="append")
    e.add_argument("--urls-file")
    e.add_argument("--backend", choices=sorted(extraction.DEFAULT_SERVER), default="ollama")
    e.add_argument("--base-url")
    e.add_argument("--out", default="results")
    e.add_argument("--done", help="a results folder whose sites are left out")
    e.add_argument("--offset", type=int, default=0)
    e.add_argument("--limit", type=int)
    e.add_argument("--workers", type=int, default=10)
    e.add_argument("--prompts", action="store_true", help="keep prompts and answers")
    e.set_defaults(run=_extract)
    b = sub.add_parser("batch", help=_batch.__doc__)
    b.add_argument("--input", required=True)
    b.add_argument("--out", default="results")
    b.add_argument("--model", action="append")
    b.add_argument("--backend", choices=sorted(extraction.DEFAULT_SERVER), default="ollama")
    b.add_argument("--base-url")
    b.add_argument("--offset", type=int, default=0)
    b.add_argument("--limit", type=int)
    b.add_argument("--workers", type=int, default=10)
    b.set_defaults(run=_batch)
    v = sub.add_parser("evaluate")
    v.add_argument("--gold", default="gold")
    v.add_argument("--results", default="results")
    v.add_argument("--model", action="append")
    v.add_argument("--text-out")
    v.add_argument("--json-out")
    v.add_argument("--debug", action="store_true")
    v.set_defaults(run=_evaluate)
    c = sub.add_parser("check")
    c.add_argument("--input", required=True)
    c.add_argument("--output", required=True)
    c.add_argument("--workers", type=int, default=10)
    c.set_defaults(run=_check)
    a = parser.parse_args(args)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
