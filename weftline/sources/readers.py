"""What runs read: lists of sites, earlier results, gold sets, result folders, and files of models."""

from __future__ import annotations

import shlex

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip, url_key
from ..operators.batch import keep_last
from ..schemas import ENTRY, RECORD


def json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Objects of a JSON array in one file, in order: their members as columns, with ord and all of each as raw."""
    text = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"), "value")
    bad = text.where(F.col("v").isNull()).limit(1).count()
    if bad:
        raise ValueError(f"{path} holds no JSON")
    items = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    rows = text.select(F.posexplode(items).alias("ord", "item")).select("ord", F.to_json("item").alias("raw"))
    if schema is None:
        schema = spark.read.option("multiLine", True).json(path).schema.simpleString()
    schema = schema if schema.startswith("struct<") else f"struct<{', '.join(_pairs(schema))}>"
    return rows.select("ord", "raw", F.from_json("raw", schema).alias("j")).select("ord", "raw", "j.*")


def _pairs(ddl: str) -> list[str]:
    """name:type for each column of a DDL list."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, kind = ddl[at:i].strip().split(None, 1)
            out.append(f"{name}:{kind}")
            at = i + 1
    return out


def earlier_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Results of a run before; none where the file is missing or no JSON."""
    try:
        return json_array(spark, path, schema)
    except Exception as error:  # noqa: BLE001  a missing path and a broken file both mean a fresh start
        if not any(x in str(error) for x in ("PATH_NOT_FOUND", "holds no JSON", "does not exist")):
            raise
        return spark.createDataFrame([], f"ord int, raw string, {schema}")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file, without those that are blank or begin with #."""
    return spark.read.text(path).select(strip(F.col("value")).alias("line")).where("line <> '' and not line like '#%'")


def models(text: str, comments: bool = True) -> list[tuple[str, list[str]]]:
    """Models and their arguments from the lines of a file; a list by the user, read on the driver.

    Arguments are split as a shell does. Without comments, a # behind them is an
    argument like others.
    """
    found = []
    for line in (x.strip() for x in text.splitlines()):
        if line and not line.startswith("#") and (words := shlex.split(line, comments=comments)):
            found.append((words[0], words[1:]))
    return found


def gold(spark: SparkSession, path: str) -> DataFrame:
    """url_key, url, ground_truth and aliases of a gold set: a file or a folder of *.json, each an object or an array.

    Files that are no JSON, elements that are no objects and those without a URL
    are left out; of entries with one key the last counts, by file and place.
    """
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v")).where("v is not null")
    items = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    each = files.select("file", F.posexplode(items).alias("pos", "v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    raw = F.to_json("v")
    return gold_rows(each.select("file", "pos", raw.alias("raw")))


def gold_rows(rows: DataFrame) -> DataFrame:
    """The same from rows of file, pos and raw (an entry as JSON)."""
    url, truth = F.get_json_object("raw", "$.url"), F.get_json_object("raw", "$.ground_truth")
    truth = F.when(truth.isNull() | (truth == "") | (truth == "{}"), F.col("raw")).otherwise(truth)
    aliases = F.from_json(F.get_json_object("raw", "$.aliases"), "map<string,string>")
    forms = F.transform_values(aliases, lambda _, v: F.when(v.startswith("["), F.from_json(v, "array<string>")).when(v.isNull(), F.array().cast("array<string>")).otherwise(F.array(v)))
    found = rows.select("file", "pos", url_key(url).alias("url_key"), url.alias("url"), F.from_json(truth, RECORD).alias("ground_truth"), F.coalesce(forms, F.create_map().cast("map<string,array<string>>")).alias("aliases"))
    return keep_last(found.where("url <> ''"), ["url_key"], ["file", "pos"]).drop("file", "pos")


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of a results folder, with seq in the order of their paths; those without a model are left out.

    One file each, in folders of models: <model>/<url>.json, or as writers.entries
    leaves them. Files elsewhere under the folder are others'.
    """
    sc = spark.sparkContext
    root = sc._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath()
    place = F.substring_index(F.regexp_replace("_metadata.file_path", "^[a-z0-9]+:/+", "/"), root.rstrip("/") + "/", -1)
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    text = files.where(place.rlike(r"^[^/]+/[^/]+\.json$|^model_dir=[^/]+/url_name=[^/]+/[^/]+\.json$")).select(F.col("_metadata.file_path").alias("seq"), "value").where(F.try_parse_json("value").isNotNull())
    there = F.array_contains(F.json_object_keys("value"), "model")
    schema = f"struct<{', '.join(_pairs(ENTRY))}>"
    return text.where(there).select("seq", F.from_json("value", schema).alias("e")).select("seq", "e.*")
