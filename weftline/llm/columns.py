"""Columns that a stage hands on and does not read, kept from clashing with those it makes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aside(docs: DataFrame, used: set[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but the used ones renamed, and what gives a result the columns of docs again."""
    names = {c: c if c in used else f"_aside_{i}" for i, c in enumerate(docs.columns)}
    return docs.withColumnsRenamed(names), lambda out: out.select(*(F.col(new).alias(old) for old, new in names.items()))
