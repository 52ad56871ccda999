"""Records of events: merged from three answers, counted, checked for shape, and the best attempt kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BASIC, COMMITTEE, LISTS, SECTIONS, SPEAKERS

ATTEMPTS = 3
#: An attempt is good enough when no more than this share of its scalar fields is empty.
NULL_SHARE = 0.35
#: Members of a record's sections that the first pass calls otherwise.
RENAMED = {"submission": "submission_deadline", "notification": "notification_date", "camera_ready": "camera_ready_date"}


def _bound(value: Column, make) -> Column:
    """make(value), with value computed once."""
    return F.transform(F.array(value), make)[0]


def _list(answer: Column, key: str, kind: str) -> Column:
    """A list of an answer: missing is empty, an explicit null stays null."""
    parsed = F.from_json(answer, f"struct<`{key}`:{kind}>")[key]
    there = F.array_contains(F.json_object_keys(answer), key)
    return F.when(F.coalesce(there, F.lit(False)), parsed).otherwise(F.array().cast(kind))


def merge(url: Column, basic: Column, speakers: Column, committee: Column) -> Column:
    """One record of the three answers (JSON objects, each may be null)."""

    def made(b: Column) -> Column:
        member = lambda k: F.coalesce(b[k], F.lit("")) if k in ("full_name", "acronym") else url if k == "url" else b[RENAMED.get(k, k)]
        section = lambda s: F.struct(*(member(k).alias(k) for k in SECTIONS[s])).alias(s)
        return F.struct(
            section("conference"), section("dates"), section("venue"), section("deadlines"),
            _list(basic, "topics", "array<string>").alias("topics"),
            _list(speakers, "keynote_speakers", SPEAKERS).alias("keynote_speakers"),
            _list(committee, "program_committee", COMMITTEE).alias("program_committee"),
            section("publication"),
        )

    # Parsed once, not for each member.
    return _bound(F.from_json(basic, BASIC), made)


def empty(url: Column) -> Column:
    """The record of which nothing is known."""
    nothing = F.lit(None).cast("string")
    return merge(url, nothing, nothing, nothing)


def _scalars(record: Column) -> list[Column]:
    return [record[s][k].cast("string") for s, ks in SECTIONS.items() for k in ks]


def null_fields(record: Column) -> Column:
    """nulls (or empty) and total among the scalar fields."""
    missing = sum(((c.isNull() | (c == "")).cast("int") for c in _scalars(record)), F.lit(0))
    return F.struct(missing.alias("nulls"), F.lit(sum(map(len, SECTIONS.values()))).alias("total"))


def good_enough(record: Column) -> Column:
    counts = null_fields(record)
    return counts["nulls"] / counts["total"] <= NULL_SHARE


def filled_fields(record: Column) -> Column:
    """filled and total over scalars and lists; a section that is missing has no members, a list always counts."""
    filled, total = F.lit(0), F.lit(len(LISTS))
    for s, ks in SECTIONS.items():
        total = total + F.when(record[s].isNotNull(), len(ks)).otherwise(0)
        for k in ks:
            filled = filled + F.coalesce(record[s][k].cast("string") != "", F.lit(False)).cast("int")
    for k in LISTS:
        filled = filled + F.coalesce(F.size(record[k]) > 0, F.lit(False)).cast("int")
    return F.struct(filled.alias("filled"), total.alias("total"))


def fill_percent(filled: Column, total: Column) -> Column:
    """One decimal, ties to even."""
    return F.when(total > 0, F.bround(filled / total * 100, 1)).otherwise(0.0)


def fields_at(confidence: Column, level: str) -> Column:
    """Paths of a confidence list (structs of path and level) at a level, in their order."""
    return F.transform(F.filter(confidence, lambda c: c["level"] == level), lambda c: c["path"])


def best_attempt(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """For each key the attempt with the fewest nulls, the earliest among equals; attempts counts all that were made.

    attempts has the keys, attempt, record (null when every pass failed), and
    what belongs to it; later attempts than the first good one are not counted.
    """
    kept = [c for c in attempts.columns if c not in keys]
    rows = attempts.withColumn("_enough", good_enough(F.col("record")) & F.col("record").isNotNull()).withColumn("_nulls", null_fields(F.col("record"))["nulls"])
    good = F.when(F.col("_enough"), F.col("attempt"))
    # Those before the first good one have more nulls than it, those after it are not made.
    order = F.struct(~F.col("_enough"), good, F.col("record").isNull(), "_nulls", "attempt")
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*kept), order).alias("_b"), F.coalesce(F.min(good), F.max("attempt")).alias("attempts"))
    return best.select(*keys, *(F.col(f"_b.{c}").alias(c) for c in kept), "attempts")


#: Kinds that a JSON value may have, by path; members of sections but the first may be missing.
_TEXT, _TEXT_OR_NULL = ["string"], ["string", "null"]
_SHAPES = {
    "conference": {"full_name": _TEXT, "acronym": _TEXT, "url": _TEXT, "edition_number": ["integer", "null"]},
    "dates": {"start_date": _TEXT_OR_NULL, "end_date": _TEXT_OR_NULL},
    "venue": {"city": _TEXT_OR_NULL, "country": _TEXT_OR_NULL},
    "deadlines": {"submission": _TEXT_OR_NULL, "notification": _TEXT_OR_NULL, "camera_ready": _TEXT_OR_NULL},
    "publication": {"publisher": _TEXT_OR_NULL, "series": _TEXT_OR_NULL},
}
_ITEMS = {
    "keynote_speakers": {"name": _TEXT, "affiliation": _TEXT_OR_NULL, "country": _TEXT_OR_NULL},
    "program_committee": {"name": _TEXT, "affiliation": _TEXT_OR_NULL, "country": _TEXT_OR_NULL, "role": _TEXT_OR_NULL},
}


_KINDS = {"VOID": "null", "STRING": "string", "BOOLEAN": "boolean", "BIGINT": "integer", "OBJECT": "object", "ARRAY": "array"}


def _kind(value: Column) -> Column:
    """The JSON type of a variant's value."""
    names = F.create_map(*(F.lit(x) for pair in _KINDS.items() for x in pair))
    return F.coalesce(F.element_at(names, F.substring_index(F.coalesce(F.schema_of_variant(value), F.lit("VOID")), "<", 1)), F.lit("number"))


def _wrong(value: Column, kinds: list[str]) -> Column:
    """What is said of a value that is of none of the kinds; null when it is of one."""
    names = ", ".join(f"'{k}'" for k in kinds)
    return F.when(~_kind(value).isin(*kinds), F.concat(F.coalesce(F.to_json(value), F.lit("null")), F.lit(f" is not of type {names}")))


_VARIANTS = "map<string,variant>"


def _members(value: Column) -> Column:
    """Members of a variant that is an object; null for others."""
    return F.try_variant_get(value, "$", _VARIANTS)


def _required(have: Column, keys: list[str]) -> list[Column]:
    return [F.when(~F.map_contains_key(have, k), F.lit(f"'{k}' is a required property")) for k in keys]


def _typed(have: Column, members: dict[str, list[str]]) -> list[Column]:
    return [F.when(F.map_contains_key(have, k), _wrong(F.element_at(have, F.lit(k)), kinds)) for k, kinds in members.items()]


def _object_errors(value: Column, members: dict[str, list[str]], required: bool) -> Column:
    """Messages of an object and its members; a single one for what is no object."""
    inside = lambda have: F.array(*(_required(have, list(members)) if required else []), *_typed(have, members))
    return F.when(_kind(value) == "object", _bound(_members(value), inside)).otherwise(F.array(_wrong(value, ["object"])))


def _items(value: Column, each) -> Column:
    """Messages of an array and its items; a single one for what is no array."""
    return F.when(_kind(value) == "array", F.flatten(F.transform(F.try_variant_get(value, "$", "array<variant>"), each))).otherwise(F.array(_wrong(value, ["array"])))


def shape_errors(record: Column) -> Column:
    """Messages where a record (JSON text) is not of the shape of RECORD; an empty list when all is well.

    Missing sections and members of the first section are named, values of wrong
    types are quoted. Text that is no JSON object has one message.
    """
    none = F.array().cast("array<string>")

    def check(top: Column) -> Column:
        parts = []
        for s, members in _SHAPES.items():
            parts += [F.array(*_required(top, [s])), F.when(F.map_contains_key(top, s), _section(top, s, members)).otherwise(none)]
        for s in LISTS:
            parts += [F.array(*_required(top, [s])), F.when(F.map_contains_key(top, s), _list_section(top, s)).otherwise(none)]
        return F.array_compact(F.concat(*parts))

    def whole(doc: Column) -> Column:
        return F.when(_kind(doc) == "object", _bound(_members(doc), check)).otherwise(F.array(F.concat(F.coalesce(record, F.lit("null")), F.lit(" is not of type 'object'"))))

    return _bound(F.try_parse_json(record), whole)


def _section(top: Column, s: str, members: dict[str, list[str]]) -> Column:
    return _bound(F.element_at(top, F.lit(s)), lambda v: _object_errors(v, members, s == "conference"))


def _list_section(top: Column, s: str) -> Column:
    each = (lambda v: F.array(_wrong(v, _TEXT))) if s == "topics" else (lambda v: _object_errors(v, _ITEMS[s], False))
    return _bound(F.element_at(top, F.lit(s)), lambda v: _items(v, each))
