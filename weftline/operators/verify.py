"""Values verified against the source: confidence by path, and what is not found taken out.

Word-for-word search and dates are JVM expressions over the whole source. Only
records with values that are not found so go to the similarity function, with
their source once. A record is verified within its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import found_in, order_warnings
from ..functions.similarity import about
from ..functions.text import strip
from ..schemas import SECTIONS, VERIFIED, VERIFIED_DATES

# How similar a value must be to count as found about.
ABOUT = {"scalar": 70, "keynote_speakers": 75, "program_committee": 80}


def _value(record: Column, path: str) -> Column:
    section, key = path.split(".")
    return record[section][key]


def checks(record: Column, source: Column, low: Column) -> Column:
    """path, value, least and level of each value to verify, in order; level is null where similarity must tell.

    low is the source in lower case.
    """
    parts = []
    for path in VERIFIED:
        v = _value(record, path)
        if path in VERIFIED_DATES:
            level = F.when(v.isNull() | found_in(strip(v), source, low), "high").otherwise("low")
        else:
            level = F.when(v.isNull() | F.contains(low, strip(F.lower(v))), "high")
        parts.append(F.struct(F.lit(path).alias("path"), v.alias("value"), F.lit(ABOUT["scalar"]).alias("least"), level.alias("level")))
    return F.concat(F.array(*parts), *(_names(record[kind], kind, low) for kind in ("keynote_speakers", "program_committee")))


def _names(people: Column, kind: str, low: Column) -> Column:
    def item(x: Column, i: Column) -> Column:
        name = F.coalesce(x["name"], F.lit(""))
        found = F.contains(low, F.lower(name))
        # An empty name is in any text, but a member of the committee must have one.
        level = F.when(found, "high") if kind == "keynote_speakers" else F.when(name == "", "low").when(found, "high")
        path = F.concat(F.lit(f"{kind}["), i.cast("string"), F.lit("].name"))
        return F.struct(path.alias("path"), name.alias("value"), F.lit(ABOUT[kind]).alias("least"), level.alias("level"))

    return F.coalesce(F.transform(people, item), F.array().cast("array<struct<path:string,value:string,least:int,level:string>>"))


def with_confidence(records: DataFrame, record: str = "record", source: str = "source") -> DataFrame:
    """records with confidence: structs of path and level, in the order of verification. Nothing is shuffled."""
    names = records.columns
    rows = records.withColumn("_low", F.lower(F.coalesce(source, F.lit(""))))
    # Generated, so that what follows reads the record and does not make it anew for each value.
    rows = rows.select(*names, "_low", F.inline(F.array(F.struct(F.col(record).alias("_r")))))
    rows = rows.withColumn("_checks", checks(F.col("_r"), F.col(source), F.col("_low")))
    open_ = F.exists("_checks", lambda c: c["level"].isNull())
    ask = about(F.when(open_, F.transform("_checks", lambda c: F.when(c["level"].isNull(), c["value"]))), F.when(open_, F.transform("_checks", lambda c: c["least"])), F.when(open_, F.col("_low")))
    rows = rows.withColumn("_about", ask)
    level = lambda c, i: F.struct(c["path"].alias("path"), F.coalesce(c["level"], F.get("_about", i)).alias("level"))
    return rows.select(*(F.col("_r").alias(n) if n == record else F.col(n) for n in names), F.transform("_checks", level).alias("confidence"))


def nullify(record: Column, level: Column) -> Column:
    """record with values of low confidence (a map by path) null, and speakers and members of low confidence taken out."""
    low = lambda path: F.coalesce(F.element_at(level, path) == "low", F.lit(False))
    out = record
    for s, ks in SECTIONS.items():
        members = [F.when(~low(f"{s}.{k}"), record[s][k]).alias(k) if f"{s}.{k}" in [*VERIFIED, "publication.series"] else record[s][k].alias(k) for k in ks]
        out = out.withField(s, F.struct(*members))
    for k in ("keynote_speakers", "program_committee"):
        out = out.withField(k, F.filter(record[k], _not_low(low, k)))
    return out


def _not_low(low, kind: str):
    return lambda x, i: ~low(F.concat(F.lit(f"{kind}["), i.cast("string"), F.lit("].name")))


def dates_of(record: Column) -> dict[str, Column]:
    return {
        "start_date": record["dates"]["start_date"], "end_date": record["dates"]["end_date"],
        **{k: record["deadlines"][k] for k in ("submission", "notification", "camera_ready")},
    }


def validate(records: DataFrame, shape: Column | None = None) -> DataFrame:
    """records (record, source and others) with confidence, warnings and the record without what was not found.

    Warnings tell of shape (messages given by shape, seen before anything is
    taken out), dates and source, in this order.
    """
    rows = records.withColumn("_shape", shape if shape is not None else F.array().cast("array<string>"))
    found = with_confidence(rows).withColumn("_level", F.map_from_entries("confidence"))
    tagged = lambda tag, c: F.transform(c, lambda m: F.concat(F.lit(f"[{tag}] "), m))
    low = F.transform(F.filter("confidence", lambda c: c["level"] == "low"), lambda c: F.concat(F.lit("low confidence: "), c["path"]))
    warnings = F.concat(tagged("schema", F.col("_shape")), tagged("dates", order_warnings(dates_of(F.col("record")))), tagged("source", low))
    return found.withColumn("warnings", warnings).withColumn("record", nullify(F.col("record"), F.col("_level"))).drop("_shape", "_level")
