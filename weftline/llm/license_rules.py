"""License detection by ordered signature rules, in DataFrame functions alone.

Texts are taken as their words, lower-cased and joined by single spaces. Every
rule of license_signatures is a regular expression over these with a label, a
priority, a confidence and keywords, one of which any match contains. A text that holds none of the
GATE is done at once; for the others only rules with a keyword that occurs are
matched.
Where detections overlap, one that lies within another of the same or a higher
priority is dropped. All of it happens within the row: nothing is shuffled.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_signatures import SIGNATURES

#: What separates words, once A-Z are lower-cased; before that, A-Z are not among it.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: A text without any of these, once lower-cased, has no words of a base phrase or rule.
GATE = """
    licen spdx gpl gfdl gnu bsd copyleft redistribut wtfpl cc0 domain permission commons warrant reserved mozilla mpl apache cddl eupl busl sspl cecill odbl
    artistic endorse advertising liable misrepresented openssl evil beer proprietary unauthorized
""".split()
GATE_WORDS = r"cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by|open[\x00-\x2F\x3A-\x60\x7B-\x7F]*rail|(?<![a-z0-9])(?:mit|x11|expat|asl|epl|osl|bsl|ofl|perl|ms)(?![a-z0-9])"


@dataclass(frozen=True)
class Rule:
    id: int
    label: str
    priority: int
    confidence: float
    keywords: tuple[str, ...]
    regex: str


def rules() -> list[Rule]:
    """All rules, in their order."""
    found = []
    for line in SIGNATURES.strip().split("\n"):
        label, priority, confidence, words, body = line.split("|", 4)
        found.append(Rule(len(found), label, int(priority), float(confidence), tuple(words.split(",")), f"(?<= )(?:{body})(?= )"))
    return found


_RULE = "struct<id:int,label:string,priority:int,confidence:double,regex:string>"
_FOUND = "array<struct<start:int,end:int,priority:int,rule:int>>"


def _matches(t: Column, r: Column) -> Column:
    """start, end (negative, so that the longer sorts first), priority (negative) and rule of each match of r in t."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("out"))

    def add(a: Column, x: Column) -> Column:
        lo = a["at"] + x["gap"]
        hi = lo + x["size"]
        return F.struct(hi.alias("at"), F.concat(a["out"], F.array(F.struct(lo.alias("start"), (-hi).alias("end"), (-r["priority"]).alias("priority"), r["id"].alias("rule")))).alias("out"))

    def places(hits: Column) -> Column:
        gaps = F.split(t, r["regex"], F.lit(-1))
        step = F.arrays_zip(F.transform(F.slice(gaps, F.lit(1), F.size(hits)), F.length).alias("gap"), F.transform(hits, F.length).alias("size"))
        return F.when(F.size(hits) > 0, F.aggregate(step, start, add, lambda a: a["out"])).otherwise(F.array().cast(_FOUND))

    return F.transform(F.array(F.regexp_extract_all(t, r["regex"], F.lit(0))), places)[0]


def _survivors(found: Column) -> Column:
    """Rules with a detection that no other of the same or a higher priority contains."""
    start = F.struct(F.array_repeat(F.lit(-1), 6).alias("ends"), F.array().cast("array<int>").alias("keep"))

    def add(a: Column, d: Column) -> Column:
        inside = F.element_at(a["ends"], 1 - d["priority"]) >= -d["end"]
        ends = F.transform(a["ends"], lambda e, i: F.when(i <= -d["priority"], F.greatest(e, -d["end"])).otherwise(e))
        return F.struct(ends.alias("ends"), F.when(inside, a["keep"]).otherwise(F.array_union(a["keep"], F.array(d["rule"]))).alias("keep"))

    return F.aggregate(F.array_sort(found), start, add, lambda a: a["keep"])


def _spaces(t: Column) -> Column:
    return F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))


def _base(t: Column, phrase: str) -> Column:
    """Places of a phrase in t, its first and last word, and its label."""
    there = f" {phrase} "
    n = F.regexp_count(t, F.lit(f"(?<= ){phrase}(?= )")).cast("long")
    first = F.instr(t, there)
    last = F.length(t) - F.instr(F.reverse(t), there[::-1]) - len(there) + 2
    at = lambda p: (_spaces(F.substring(t, F.lit(1), p)) - 1).cast("long")
    return F.struct(n.alias("n"), F.when(n > 0, at(first)).alias("first"), F.when(n > 0, at(last)).alias("last"), F.lit(BASE[phrase]).alias("label"))


def licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row.

    score is the highest confidence among the rules that are left. A null or
    empty text, like any without a detection, has no labels (''), null words and
    a score of 0. Null ids, repeated rows and empty tables pass through; other
    columns are left out.
    """
    by_words: dict[tuple[str, ...], list[dict]] = {}
    for r in rules():
        by_words.setdefault(r.keywords, []).append({k: v for k, v in asdict(r).items() if k != "keywords"})
    groups = F.from_json(F.lit(json.dumps([{"k": list(k), "rules": v} for k, v in by_words.items()])), f"array<struct<k:array<string>,rules:array<{_RULE}>>>")
    table = F.from_json(F.lit(json.dumps([r for r in sorted((r for v in by_words.values() for r in v), key=lambda r: r["id"])])), f"array<{_RULE}>")
    whole = F.coalesce(F.col(text), F.lit(""))
    lower = F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), BREAK, " ")

    def scan(t: Column) -> Column:
        asked = F.flatten(F.transform(F.filter(groups, lambda g: F.exists(g["k"], lambda k: F.contains(t, k))), lambda g: g["rules"]))
        keep = _survivors(F.flatten(F.transform(asked, lambda r: _matches(t, r))))
        return F.struct(F.array(*(_base(t, p) for p in BASE)).alias("base"), F.transform(keep, lambda i: table[i]).alias("rules"))

    def gate(t: Column) -> Column:
        any_ = F.contains(t, F.lit(GATE[0]))
        for k in GATE[1:]:
            any_ = any_ | F.contains(t, F.lit(k))
        return any_ | t.rlike(GATE_WORDS)

    nothing = "array(named_struct('base', cast(array() as array<struct<n:bigint,first:bigint,last:bigint,label:string>>), 'rules', cast(array() as array<" + _RULE + ">)))"
    found = F.when(F.transform(F.array(F.lower(whole)), gate)[0], F.transform(F.array(plain), scan)).otherwise(F.expr(nothing))
    rows = docs.select("doc_id", F.regexp_count(whole, F.lit(WORD)).cast("long").alias("n_words"), F.inline(found))
    some = F.filter("base", lambda b: b["n"] > 0)
    base_labels = F.array_sort(F.transform(some, lambda b: b["label"]))
    labels = F.array_sort(F.array_distinct(F.concat(base_labels, F.col("rules.label"))))
    return rows.select(
        "doc_id", "n_words",
        F.aggregate("base", F.lit(0).cast("long"), lambda a, b: a + b["n"]).alias("n_base"),
        F.array_min(some["first"]).alias("first_word"), F.array_max(some["last"]).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.coalesce(F.array_max("rules.confidence"), F.lit(0.0)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
