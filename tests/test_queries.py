import os

import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_has_rows_or_a_reason():
    from weftline.plans import queries

    assert set(queries.SQL) <= set(queries.QUERIES)
    assert set(queries.QUERIES) - set(queries.SQL) == {"html_clean"}


@pytest.mark.parametrize("name", ["html_clean", "fuzzy_match", "page_topk", "confidence_levels", "link_discovery"])
def test_query_runs(spark, name):
    assert __spark_entry__.queries()[name](spark, DATA).count() > 0


def test_records_to_verify_are_dealt_out(spark):
    from weftline.plans import queries

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert queries.table(spark, DATA, "orders").rdd.getNumPartitions() < n
    assert queries.nullify_low(spark, DATA).rdd.getNumPartitions() >= n
