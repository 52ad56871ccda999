"""Rows left out by 64-bit keys in mapped files, so that the rows themselves are not shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lean, store
from .repeats import U64, by_range, ranges

#: Bytes of input for each range of keys.
RANGE_BYTES = 64 << 20


def without(rows: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """rows whose key (a hash of 64 bits) is not in column _k of keys.

    A join would shuffle the rows as soon as the keys are too many to broadcast.
    The keys are written by range, sorted, and a task maps the ranges that it
    meets; the result reads them.
    """
    spark = rows.sparkSession
    lean.small_batches(spark)
    n, uri = ranges(rows, RANGE_BYTES), store.folder(spark, name)

    def write(table: pa.Table) -> pa.Table:
        r = table.column("r")[0].as_py()
        store.put(uri, f"k-{r}", k=np.unique(table.column("_k").to_numpy().view(U64)))
        return pa.table({"r": pa.array([r], pa.int32())})

    spread = F.shiftrightunsigned("_k", 64 - (n.bit_length() - 1)).cast("int").alias("r")
    there = {x.r for x in keys.select(spread, "_k").groupBy("r").applyInArrow(lean.group(write), "r int").collect()}  # at most n small numbers

    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        files = store.Files(uri)
        for p in parts:
            k = p.to_numpy().view(U64)
            out = np.zeros(len(k), bool)
            for r, at in by_range(k, n):
                if r in there:
                    have = files(f"k-{r}")["k"]
                    i = np.searchsorted(have, k[at])
                    i[i == len(have)] = 0
                    out[at] = have[i] == k[at]
            yield pd.Series(out)

    return rows.where(~F.pandas_udf(found, "boolean")(key))
