"""What runs leave behind. Spark's committers make each write whole or absent."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_stem, safe_name


def table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def entries(df: DataFrame, folder: str) -> None:
    """Runs as JSON, one folder for each model."""
    parted = df.withColumn("model_dir", safe_name(F.col("model"))).withColumn("url_name", safe_name(F.col("url")))
    parted.write.mode("overwrite").partitionBy("model_dir", "url_name").json(folder)


def batch_rows(df: DataFrame, path: str, earlier: list[dict] | None = None) -> list[dict]:
    """Results of plans.benchmark.run_list as one JSON array behind earlier ones: what a list's user reads, on the driver."""
    rows = [json.loads(r[0]) for r in df.orderBy("ord").select(F.to_json(F.struct(F.try_parse_json("wikicfp").alias("wikicfp"), "extracted", "confidence", "warnings", "meta"), {"ignoreNullFields": "false"})).toLocalIterator()]
    rows = [*(earlier or []), *rows]
    report(rows, path)
    return rows


def exchanges(df: DataFrame, folder: str) -> None:
    """Prompts and answers (url, pass, attempt, prompt, response), in folders named for their passes."""
    df.withColumn("pass", file_stem(F.col("pass"))).write.mode("overwrite").partitionBy("pass").json(folder)


def report(rows: list[dict] | dict, path: str) -> None:
    """A small report as indented JSON on the driver, put in place at once."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        json.dump(rows, f, ensure_ascii=False, indent=2)
    os.replace(f.name, path)


def text(content: str, path: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(content)
