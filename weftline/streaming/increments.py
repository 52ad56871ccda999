"""Runs by increments: sites come as files, each batch does what is not done yet and appends its results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.batch import remaining


def follow(spark: SparkSession, inputs: str, schema: str, work: Callable[[DataFrame], DataFrame], results: str, state: str, keys: list[str], once: bool = True) -> StreamingQuery:
    """Watch a folder of JSON lines; work turns new rows into results, which are appended as Parquet under results.

    Rows whose keys have a result, be it an error, are not worked on again. A
    batch is written under its own number, so a batch that is repeated after a
    failure replaces what it had written.
    """

    def batch(rows: DataFrame, number: int) -> None:
        todo = rows.dropDuplicates(keys)
        done = spark.read.option("recursiveFileLookup", True).option("basePath", results)
        try:
            earlier = done.parquet(results).where(F.col("batch") != number)
            todo = remaining(todo, earlier, keys)
        except Exception as error:  # noqa: BLE001  nothing was written yet
            if not any(x in str(error) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
                raise
        work(todo).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{results}/{number:012d}")

    stream = spark.readStream.schema(schema).json(inputs).writeStream.foreachBatch(batch).option("checkpointLocation", state)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime="10 seconds")).start()
