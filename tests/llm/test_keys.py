import os

import pytest
from pyspark.sql import functions as F

from weftline.llm import jaccard_join, keys, quality_rules

DATA = "/root/testdata/sf0.001"


def test_rows_without_keys(spark):
    rows = spark.range(5000).select("id", F.xxhash64("id").alias("h"))
    some = rows.where("id % 3 = 0 or id > 9000").select(F.col("h").alias("_k"))
    got = [r["id"] for r in keys.without(rows, F.col("h"), some.unionAll(some), "some").collect()]
    assert sorted(got) == [i for i in range(5000) if i % 3]
    assert keys.without(rows, F.col("h"), some.where("false"), "none").count() == 5000
    assert keys.without(rows.where("false"), F.col("h"), some, "empty").count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
def test_texts_that_are_kept_are_not_shuffled(spark):
    """However many are rejected: a join would shuffle the texts once the keys are too many to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.read.parquet(f"{DATA}/documents.parquet")
        out = quality_rules.stage(spark, docs, DATA)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
        assert 0 < out.count() < docs.count() and out.columns == docs.columns
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rounds_end_when_pairs_cost_no_more():
    # As on check_l after its first round: further rounds read 346,000 members each and leave the pairs as they are.
    assert jaccard_join._no_more_rounds(1, 1_226_890, 7_213_677, 662_877)
    assert not jaccard_join._no_more_rounds(0, 7_213_677, float("inf"), 662_877)
    assert jaccard_join._no_more_rounds(2, 7_000_000, 7_213_677, 662_877)
    assert jaccard_join._no_more_rounds(jaccard_join.ROUNDS, 7_000_000, 70_000_000, 662_877)
