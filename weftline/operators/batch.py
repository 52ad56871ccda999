"""Batches of sites and models: what is left to do, what has been done, and how it went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The models and sites of a run that names none.
DEFAULT_MODELS = [("mistral:latest", []), ("qwen3:4b", []), ("deepseek-r1:7b", [])]
DEFAULT_URLS = ["https://neurips.cc", "https://2024.gecon-conference.org", "https://2024.aclweb.org", "https://acit.tech", "https://aaai.org/conference/aaai/aaai-25/"]
FAILED = "Failed to fetch"


def remaining(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of todo whose keys are not done; errors count as done."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def part(rows: DataFrame, order: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """A slice of rows by their order; negative numbers count from the end, as slices do."""
    if offset >= 0 and (limit is None or limit >= 0):
        out = rows.orderBy(order)
        out = out.offset(offset) if offset else out
        return out if limit is None else out.limit(limit)
    n = rows.count()
    start = max(n + offset, 0) if offset < 0 else min(offset, n)
    stop = n if limit is None else start + limit if limit >= 0 else max(n + limit, start)
    return rows.orderBy(order).offset(start).limit(max(0, min(stop, n) - start))


def combinations(models: DataFrame, urls: DataFrame) -> DataFrame:
    """Every model with every URL, numbered model by model; model_ord and url_ord count from 0. The models are the few that a user lists."""
    n = urls.agg(F.count("*").alias("_n"))
    both = urls.crossJoin(models.crossJoin(n))
    return both.withColumn("ord", F.col("model_ord") * F.col("_n") + F.col("url_ord") + 1).drop("_n")


def keep_last(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The last row for each key, by a map-side aggregation: a key with many rows costs one row a task."""
    cols = rows.columns
    rest = [c for c in cols if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return last.select(*(F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in cols))


def in_input_order(results: DataFrame, inputs: DataFrame, key: str, order: str) -> DataFrame:
    """results with pos: where their key last stands in the input; 0 for keys that it lacks."""
    last = inputs.groupBy(key).agg(F.max(order).alias("pos"))
    return results.join(last, key, "left").withColumn("pos", F.coalesce("pos", F.lit(0)))


def checked(inputs: DataFrame, fetched: DataFrame, key: str = "website_url") -> DataFrame:
    """inputs (website_url and others) with final_url, status_code, redirected and error, from fetched (url, final_url, status_code): a row for each of inputs.

    key names a column of both that tells inputs of one address apart, where each
    was fetched by itself. Of several answers under a key one counts: one that
    came, of the least status.
    """
    own = F.col("url" if key == "website_url" else key).alias(key)
    answers = fetched.select(own, F.struct(F.col("status_code").isNull().alias("failed"), "status_code", "final_url").alias("a"))
    got = answers.groupBy(key).agg(F.min("a").alias("a")).select(key, "a.final_url", "a.status_code")
    out = inputs.join(got, key, "left")
    ok = F.col("status_code").isNotNull()
    return out.withColumn("redirected", ok & (F.col("final_url") != F.col("website_url"))).withColumn("error", F.when(~ok, FAILED))


def check_totals(results: DataFrame, seconds: float | None = None, total: int | None = None) -> DataFrame:
    """done, ok, errors and redirects; with the seconds so far also the rate, and with the total the seconds to go."""
    out = results.agg(
        F.count("*").alias("done"), F.count_if(F.col("status_code") < 400).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if("redirected").alias("redirects"),
    )
    if seconds is not None:
        out = out.withColumn("rate", F.lit(0.0) if seconds <= 0 else F.col("done") / seconds)
        if total is not None:
            out = out.withColumn("eta", F.when(F.col("rate") > 0, (total - F.col("done")) / F.col("rate")).otherwise(0.0))
    return out


def cell(entry: Column) -> Column:
    """What a summary shows of a run: share filled and doubtful fields, ERR, or - where there is none."""
    shown = F.concat(entry["fill_pct"].cast("string"), F.lit("% h:"), F.size(entry["low_confidence_fields"]).cast("string"))
    return F.when(entry["status"].isNull(), "-").when(entry["status"] != "ok", "ERR").otherwise(shown)


def summary_pivot(entries: DataFrame, models: list[str]) -> DataFrame:
    """url and a cell for each model; of several runs of a model and URL the last counts."""
    last = keep_last(entries.select("model", "url", "status", "fill_pct", "low_confidence_fields", "seq"), ["model", "url"], ["seq"])
    shown = last.select("url", "model", cell(F.struct("status", "fill_pct", "low_confidence_fields")).alias("cell"))
    out = shown.groupBy("url").pivot("model", models).agg(F.first("cell"))
    return out.fillna("-", models)


def summary_averages(entries: DataFrame) -> DataFrame:
    """model, sites that are ok, all sites, and over the ok ones mean share filled, mean seconds and doubtful fields."""
    last = keep_last(entries.select("model", "url", "status", "fill_pct", "elapsed_sec", "low_confidence_fields", "seq"), ["model", "url"], ["seq"])
    ok = F.col("status") == "ok"
    return last.groupBy("model").agg(
        F.count_if(ok).alias("sites"), F.count("*").alias("all_sites"), F.avg(F.when(ok, F.col("fill_pct"))).alias("avg_fill"),
        F.avg(F.when(ok, F.col("elapsed_sec"))).alias("avg_time"), F.sum(F.when(ok, F.size("low_confidence_fields"))).alias("doubtful"),
    )
