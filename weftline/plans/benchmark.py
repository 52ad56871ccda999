"""Models run over sites, resumed where they stopped, and summed up."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.batch import DEFAULT_MODELS, DEFAULT_URLS, remaining, summary_averages, summary_pivot
from ..sources import writers
from .extraction import Ask, extract


def run(spark: SparkSession, crawled: DataFrame, ask: Callable[[str], Ask], folder: str, models: list[tuple[str, list[str]]] | None = None, urls: list[str] | None = None, backend: str = "ollama") -> DataFrame:
    """Entries of every model and URL, written under folder, with a report and a summary.

    ask gives the function that asks a model. Seconds are those of a model's run
    shared among its sites, which run side by side.
    """
    models, urls = models or DEFAULT_MODELS, urls or DEFAULT_URLS
    sites = spark.createDataFrame([(u,) for u in urls], "site_url string")
    stamp = datetime.now()
    parts = []
    for i, (model, args) in enumerate(models):
        began = time.time()
        path = f"{folder}/runs/{i}"
        extract(crawled, sites, ask(model), f"{path}/work", model, backend).write.mode("overwrite").parquet(f"{path}/entries")
        seconds = round((time.time() - began) / len(urls), 1)
        entries = spark.read.parquet(f"{path}/entries")
        parts.append(entries.withColumn("elapsed_sec", F.lit(seconds)).withColumn("vllm_extra_args", F.array(*map(F.lit, args)).cast("array<string>")).withColumn("seq", F.lit(i)))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    writers.entries(all_.drop("seq").withColumn("confidence", F.map_from_entries("confidence")), f"{folder}/results")
    writers.report({"timestamp": stamp.strftime("%Y%m%d_%H%M%S"), "backend": backend, "models": [{"name": m, "vllm_extra_args": a} for m, a in models], "urls": urls}, f"{folder}/benchmark.json")
    writers.text(summary(all_, [m for m, _ in models], urls), f"{folder}/summary.txt")
    return all_


def run_list(inputs: DataFrame, crawled: DataFrame, ask: Ask, folder: str, model: str, backend: str = "ollama", args: list[str] | None = None, done: DataFrame | None = None) -> DataFrame:
    """Results of one model for a list of sites (ord, raw and website_url, see sources.readers.json_array), in input order.

    wikicfp is the input as it was given, beside it extracted, confidence,
    warnings and meta. Sites that done (website_url, model) has are left out, be
    their result an error.
    """
    todo = inputs.select("ord", "raw", "website_url").withColumn("model", F.lit(model))
    if done is not None:
        todo = remaining(todo, done, ["website_url", "model"])
    sites = todo.select(F.col("website_url").alias("site_url")).distinct()
    began = time.time()
    extract(crawled.join(sites, "site_url", "left_semi"), sites, ask, f"{folder}/work", model, backend).write.mode("overwrite").parquet(f"{folder}/entries")
    entries = inputs.sparkSession.read.parquet(f"{folder}/entries").drop("model", "backend")
    seconds = round((time.time() - began) / max(1, entries.count()), 1)
    meta = F.struct(
        F.lit(model).alias("model"), F.lit(backend).alias("backend"), "attempts", "pages_fetched", "status", "error", F.lit(seconds).alias("elapsed_sec"), F.lit(datetime.now().isoformat()).alias("extracted_at"),
        F.array(*map(F.lit, args or [])).cast("array<string>").alias("vllm_extra_args"),
    )
    out = todo.drop("model").join(entries, F.col("website_url") == F.col("url"))
    return out.select("ord", "website_url", F.lit(model).alias("model"), F.col("raw").alias("wikicfp"), F.col("data").alias("extracted"), F.map_from_entries("confidence").alias("confidence"), "warnings", meta.alias("meta"))


def summary(entries: DataFrame, models: list[str], urls: list[str]) -> str:
    """Models by sites, and each model's means, as text; both tables are as small as the lists."""
    names = list(dict.fromkeys(models))
    rows = {r["url"]: r for r in summary_pivot(entries, names).collect()}
    out = ["URL | " + " | ".join(names)]
    out += [" | ".join([u.replace("https://", ""), *(rows[u][m] if u in rows else "-" for m in names)]) for u in urls]
    out += ["(filled% h:doubtful fields)", "", "Means"]
    means = {r["model"]: r for r in summary_averages(entries).collect()}
    for m in names:
        r = means.get(m)
        if r is None or not r["sites"]:
            out.append(f"  {m}: no successful runs")
        else:
            out.append(f"  {m}: avg_fill={r['avg_fill']:.1f}%  avg_time={r['avg_time']:.0f}s  total_hallucinations={r['doubtful']}  sites={r['sites']}/{len(urls)}")
    return "\n".join(out)
