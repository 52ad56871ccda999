import os

import pytest

import corpus_pipeline
from weftline.llm import decontaminate, jaccard_join, pseudonyms, quality_rules, store

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
def test_stages_take_effect(spark):
    """Each stage against what its operator decides on the same input."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, ids = docs.columns, lambda d: sorted(r["doc_id"] for r in d.select("doc_id").collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "decontaminate", "pseudonyms", "sentence_pieces"]
    spark.conf.set(pseudonyms.KEY_SETTING, "named")
    for name, stage in corpus_pipeline.STAGES:
        out = store.written(spark, stage(spark, docs, DATA), "test")
        if name == "quality_rules":
            want = ids(quality_rules.quality(docs).where("kept"))
        elif name == "jaccard_join":
            want = ids(jaccard_join.jaccard_join(docs).where("doc_id = component_id"))
        elif name == "decontaminate":
            bad = {r["doc_id"] for r in decontaminate.contaminated(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
            want = [i for i in ids(docs) if i not in bad]
        else:
            want = ids(docs)
        assert ids(out) == want, name
        if name != "sentence_pieces":
            assert out.columns == columns
        if name == "pseudonyms":
            back = {r["doc_id"]: r["text"] for r in pseudonyms.pseudonymise(out, back=True).collect()}
            assert back == {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = out
    spark.conf.unset(pseudonyms.KEY_SETTING)
    assert docs.where("not round_trip").count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_stages_of_an_empty_table(spark, none, tmp_path):
    """No rows in, none out, with the columns that each stage promises."""
    spark.createDataFrame([(1, "What is the sum of all the prime numbers below ten?")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, str(tmp_path))
        assert out.collect() == [] and (name == "sentence_pieces" or out.columns == none.columns), name


def test_stages_of_one_text_over_and_over(spark, tmp_path):
    """Equal rows, nulls and an empty text through all stages: one document of the group is left, by the stage that says so."""
    text = " ".join(f"word{i} of it" for i in range(60))
    rows = [(i, text, "en", "a", len(text)) for i in range(30)] + [(7, text, "en", "a", len(text)), (None, None, None, None, None), (99, "", "en", "a", 0)]
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = store.written(spark, stage(spark, docs, str(tmp_path)), "test")
        counts[name] = docs.count()
    assert counts == {"quality_rules": 31, "jaccard_join": 1, "decontaminate": 1, "pseudonyms": 1, "sentence_pieces": 1}
    assert docs.first()["doc_id"] == 0
