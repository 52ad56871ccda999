"""JSON in the answers of language models: found, told apart by shape, and wrapped."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FENCE = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"


def _loads(text: str) -> str | None:
    """The value as compact JSON text; of repeated keys the last one stands, NaN is written as such."""
    try:
        return json.dumps(json.loads(text), ensure_ascii=False, separators=(",", ":"))
    except (json.JSONDecodeError, RecursionError):
        return None


def blocks(text: str):
    """The texts between a brace and the one that closes it, strings not being told apart.

    Closing braces too many are owed: as many must open before a block can begin,
    and a block may begin inside another. A block is given up when it is no JSON.
    """
    depth, start = 0, None
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            if depth == 0:
                start = m.start()
            depth += 1
        else:
            depth -= 1
            if depth == 0 and start is not None:
                yield text[start : m.end()]
                start = None


def tolerant(text: str | None) -> str | None:
    """The JSON value of an answer: all of it, else an object in a fence, else the first block that is one."""
    if not text:
        return None
    text = text.strip()
    found = _loads(text)
    if found is None and (m := re.search(FENCE, text)):
        found = _loads(m[1])
    return found if found is not None else next((x for x in map(_loads, blocks(text)) if x is not None), None)


@F.pandas_udf(T.StringType())
def _scan(text: pd.Series) -> pd.Series:
    return text.map(tolerant)


def json_of(text: Column) -> Column:
    """The JSON value in an answer, as text; null where there is none."""
    return _scan(text)


def shape(value: Column) -> Column:
    """object, array or scalar."""
    first = F.substring(F.ltrim(value), 1, 1)
    return F.when(first == "{", "object").when(first == "[", "array").when(value.isNotNull(), "scalar")


def object_of(value: Column, wrap: str | None = None) -> Column:
    """A JSON value as an object: an array only under the key wrap, if there is one, and no others."""
    kind = shape(value)
    array = F.concat(F.lit('{"' + wrap + '":'), value, F.lit("}")) if wrap else F.lit(None).cast("string")
    return F.when(kind == "object", value).when(kind == "array", array)
