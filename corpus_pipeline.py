"""A training corpus from documents: the stages, each on all that the one before it kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontaminate, jaccard_join, pseudonyms, quality_rules, sentence_pieces, store

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("jaccard_join", jaccard_join.stage),
    ("decontaminate", decontaminate.stage),
    ("pseudonyms", pseudonyms.stage),
    ("sentence_pieces", sentence_pieces.stage),
]

#: SQL has neither the outlier estimates nor the pseudonyms and pieces; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.written(spark, stage(spark, docs, sf_dir), name)
    return docs
