"""From crawled pages to verified records: prompts, answers of a model, parsing, merging, verification, the best attempt.

A model is a relation: a function that gives answers for prompts, on the
executors. Its answers are written down before anything is made of them, so a
repeated task asks nothing twice. Attempts beyond the first are made only for
sites that need them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import json_of, object_of
from ..operators import pages as P
from ..operators.records import ATTEMPTS, best_attempt, empty, fields_at, fill_percent, filled_fields, good_enough, merge, shape_errors
from ..operators.scoring import NO_PAGES
from ..operators.verify import validate

#: Targets, and the key under which a bare list of each pass is taken.
PASSES = {"basic": None, "speakers": "keynote_speakers", "committee": "program_committee"}
# What a model server is asked for.
DEFAULT_SERVER = {"vllm": "http://localhost:8000", "ollama": "http://localhost:11434"}
DEFAULT_MODEL = "mistral:latest"
TEMPERATURE, MAX_TOKENS, SECONDS, STOP = 0.1, 2048, 180, "\n\n\n"

PROMPTS = {
    "basic": (
        "Read the web pages of an academic event below. Answer with one JSON object with the keys full_name, acronym, edition_number, start_date, end_date, "
        "city, country, submission_deadline, notification_date, camera_ready_date, topics, publisher and series. Write dates as YYYY-MM-DD, topics as a "
        "list of strings, and null for what the pages do not say. Answer with JSON alone.\n\nPages:\n",
        "\n",
    ),
    "speakers": (
        'Read the web pages of an academic event below. Answer with one JSON object, {"keynote_speakers": [...]}, with name, affiliation and country of each '
        "invited or keynote speaker; null for what the pages do not say, an empty list if there are none. Answer with JSON alone.\n\nPages:\n",
        "\n",
    ),
    "committee": (
        'Read the web pages of an academic event below. Answer with one JSON object, {"program_committee": [...]}, with name, affiliation, country and role of '
        "each member of a committee; null for what the pages do not say, an empty list if there are none. Answer with JSON alone.\n\nPages:\n",
        "\n",
    ),
}

Ask = Callable[[str, str, str, int], str | None]


def server(backend: str) -> str:
    return DEFAULT_SERVER["vllm"] if backend == "vllm" else DEFAULT_SERVER["ollama"]


def over_http(backend: str, url: str | None = None) -> Ask:
    """A function (prompt, model, pass, attempt) that asks a model server; the server itself is not managed here."""
    if backend not in DEFAULT_SERVER:
        raise ValueError(f"Unknown backend: {backend}")
    base = (url or server(backend)).rstrip("/")

    def ask(prompt: str, model: str, name: str, attempt: int) -> str | None:
        import json
        import urllib.request

        if backend == "vllm":
            path, body = "/v1/completions", {"model": model, "prompt": prompt, "temperature": TEMPERATURE, "max_tokens": MAX_TOKENS, "stop": [STOP]}
        else:
            path, body = "/api/generate", {"model": model, "prompt": prompt, "stream": False, "options": {"temperature": TEMPERATURE, "num_predict": MAX_TOKENS}}
        request = urllib.request.Request(base + path, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=SECONDS) as got:  # noqa: S310
            answer = json.load(got)
        return answer["choices"][0]["text"] if backend == "vllm" else answer["response"]

    return ask


def nothing(prompt: str, model: str, name: str, attempt: int) -> str | None:
    """A model that is not there: what offline runs and tests build on."""
    return None


def prompt(context: Column, target: Column, prompts: dict[str, tuple[str, str]] | None = None) -> Column:
    out = F.lit(None).cast("string")
    for t, (head, tail) in (prompts or PROMPTS).items():
        out = F.when(target == t, F.concat(F.lit(head), context, F.lit(tail))).otherwise(out)
    return out


def answers(prompts: DataFrame, ask: Ask, model: str, attempt: int) -> DataFrame:
    """site_url, target, attempt, prompt, response and error of each prompt."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for text, target in zip(p["prompt"], p["target"]):
                try:
                    out.append((ask(text, model, target, attempt), None))
                except Exception as error:  # noqa: BLE001  one site's failure is its result
                    out.append((None, str(error) or type(error).__name__))
            yield p.assign(attempt=attempt, response=[o[0] for o in out], error=[o[1] for o in out])[["site_url", "target", "attempt", "prompt", "response", "error"]]

    return prompts.select("site_url", "target", "prompt").mapInPandas(run, "site_url string, target string, attempt int, prompt string, response string, error string")


def passes(replies: DataFrame) -> DataFrame:
    """site_url, attempt, error and an object (JSON) for each pass."""
    value = json_of(F.col("response"))
    each = replies.withColumn("_v", value)
    wrapped = F.lit(None).cast("string")
    for t, key in PASSES.items():
        wrapped = F.when(F.col("target") == t, object_of(F.col("_v"), key)).otherwise(wrapped)
    each = each.withColumn("_v", wrapped)
    return each.groupBy("site_url", "attempt").agg(F.min("error").alias("error"), *(F.max(F.when(F.col("target") == t, F.col("_v"))).alias(t) for t in PASSES))


def _same_types(basic: Column, speakers: Column, committee: Column) -> Column:
    """What makes a record unusable: dates and names that are no texts, lists that are null."""
    kind = lambda c, p: F.schema_of_variant(F.try_variant_get(F.try_parse_json(c), p, "variant"))
    dates = ["start_date", "end_date", "submission_deadline", "notification_date", "camera_ready_date"]
    odd = [F.when(~F.coalesce(kind(basic, f"$.{d}"), F.lit("VOID")).isin("STRING", "VOID"), F.lit(f"{d} is no text")) for d in dates]
    for c, key in ((speakers, "keynote_speakers"), (committee, "program_committee")):
        have = F.array_contains(F.json_object_keys(c), key)
        odd.append(F.when(F.coalesce(have, F.lit(False)) & ~F.coalesce(kind(c, f"$.{key}"), F.lit("VOID")).startswith("ARRAY"), F.lit(f"{key} is no list")))
    people = F.try_variant_get(F.try_parse_json(speakers), "$.keynote_speakers", "array<variant>")
    odd.append(F.when(F.coalesce(F.exists(people, lambda v: ~F.schema_of_variant(v).startswith("OBJECT")), F.lit(False)), F.lit("a speaker is no object")))
    return F.get(F.array_compact(F.array(*odd)), F.lit(0))


def attempt(tried: DataFrame, sources: DataFrame) -> DataFrame:
    """Verified records of an attempt: site_url, attempt, error, record, confidence and warnings."""
    none = F.col("basic").isNull() & F.col("speakers").isNull() & F.col("committee").isNull()
    merged = tried.withColumn("error", F.coalesce("error", _same_types(F.col("basic"), F.col("speakers"), F.col("committee"))))
    merged = merged.withColumn("record", merge(F.col("site_url"), F.col("basic"), F.col("speakers"), F.col("committee"))).withColumn("_none", none)
    usable = merged.where(~F.col("_none") & F.col("error").isNull()).select("site_url", "attempt", "record").join(sources, "site_url")
    done = validate(usable, shape=shape_errors(F.to_json("record", {"ignoreNullFields": "false"})))
    kept = done.select("site_url", "attempt", F.lit(None).cast("string").alias("error"), "record", "confidence", "warnings")
    rest = merged.where(F.col("_none") | F.col("error").isNotNull()).select("site_url", "attempt", "error", F.lit(None).cast(kept.schema["record"].dataType).alias("record"), F.array().cast(kept.schema["confidence"].dataType).alias("confidence"), F.array().cast("array<string>").alias("warnings"))
    return kept.unionByName(rest)


def extract(crawled: DataFrame, sites: DataFrame, ask: Ask, folder: str, model: str = DEFAULT_MODEL, backend: str = "ollama", lexicons: dict[str, list[str]] | None = None, prompts: dict[str, tuple[str, str]] | None = None, tries: int = ATTEMPTS) -> DataFrame:
    """One entry for each site: model, backend, url, status, error, pages_fetched, attempts, counts, warnings, data and confidence.

    crawled has the pages (see sources.fetch.crawl), sites the site_url of all
    that were asked for. Answers and attempts are written to folder and read from
    there. A site without pages has the empty record and a warning; one whose
    answers break its record has status error.
    """
    spark = crawled.sparkSession
    scored = P.with_scores(crawled, lexicons)
    chosen = P.contexts(P.select_pages(scored, list(PASSES)))
    asked = chosen.withColumn("prompt", prompt(F.col("context"), F.col("target"), prompts)).select("site_url", "target", "prompt")
    asked.write.mode("overwrite").parquet(f"{folder}/prompts")
    asked = todo = spark.read.parquet(f"{folder}/prompts")
    sources = P.raw_html(crawled)
    done = None
    for i in range(1, tries + 1):
        answers(todo, ask, model, i).write.mode("overwrite").parquet(f"{folder}/answers/{i}")
        attempt(passes(spark.read.parquet(f"{folder}/answers/{i}")), sources).write.mode("overwrite").parquet(f"{folder}/attempts/{i}")
        new = spark.read.parquet(f"{folder}/attempts/{i}")
        done = new if done is None else done.unionByName(new)
        ended = new.where(F.col("error").isNotNull() | (F.col("record").isNotNull() & good_enough(F.col("record")))).select("site_url")
        todo = todo.join(ended, "site_url", "left_anti")
        if i < tries and not todo.limit(1).count():
            break
    best = best_attempt(done.where("error is null"), ["site_url"]).drop("attempt", "error")
    failed = done.where("error is not null").groupBy("site_url").agg(F.min("error").alias("error"))
    fetched = crawled.groupBy("site_url").agg(F.count("*").cast("int").alias("pages_fetched"))
    out = sites.select("site_url").distinct().join(fetched, "site_url", "left").join(failed, "site_url", "left").join(best, "site_url", "left")
    no_pages, broken = F.col("pages_fetched").isNull(), F.col("error").isNotNull()
    none = F.array().cast("array<string>")
    data = F.when(~broken, F.coalesce("record", empty(F.col("site_url"))))
    levels = F.when(broken, F.array().cast(best.schema["confidence"].dataType)).otherwise(F.coalesce("confidence", F.array().cast(best.schema["confidence"].dataType)))
    warnings = F.when(no_pages, F.array(F.lit(NO_PAGES))).when(broken, F.array("error")).otherwise(F.coalesce("warnings", none))
    out = out.select(F.lit(model).alias("model"), F.lit(backend).alias("backend"), F.col("site_url").alias("url"), F.when(broken, "error").otherwise("ok").alias("status"), "error", F.coalesce("pages_fetched", F.lit(0)).alias("pages_fetched"), F.when(no_pages, 0).otherwise(F.coalesce("attempts", F.lit(tries))).alias("attempts"), data.alias("data"), levels.alias("confidence"), warnings.alias("warnings"))
    counts = filled_fields(F.col("data"))
    out = out.withColumn("fields_filled", counts["filled"]).withColumn("fields_total", counts["total"])
    return out.withColumns({"fill_pct": fill_percent(F.col("fields_filled"), F.col("fields_total")), "high_confidence_count": F.size(fields_at(F.col("confidence"), "high")), "low_confidence_fields": fields_at(F.col("confidence"), "low")})
