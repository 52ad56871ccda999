"""Memory of Python workers, which Spark keeps for the next task: small batches, and what a task freed given back."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows that a Python worker gets at a time, at most; a batch of long texts stays a few megabytes so.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_M_TRIM_THRESHOLD, _M_MMAP_THRESHOLD = -1, -3


def small_batches(spark: SparkSession) -> None:
    """Lower the session's batches to BATCH_ROWS; what is set lower stays."""
    have = int(spark.conf.get(_BATCH))
    if have <= 0 or have > BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def _begin() -> None:
    """Large arrays straight from the system, so that freeing them frees them."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(_M_MMAP_THRESHOLD, 1 << 18)
        libc.mallopt(_M_TRIM_THRESHOLD, 1 << 20)
        pa.set_memory_pool(pa.system_memory_pool())
    except (OSError, AttributeError):  # another C library
        pass


def _end() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def batches(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function of batches, as a task should run it."""

    @wraps(run)
    def lean(parts: Iterator) -> Iterator:
        _begin()
        try:
            yield from run(parts)
        finally:
            _end()

    return lean


def group(run: Callable) -> Callable:
    """run, a function of a group's table, as a task should run it."""

    def lean(table: pa.Table) -> pa.Table:
        _begin()
        try:
            return run(table)
        finally:
            _end()

    return lean
