import os

import pytest

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = corpus_pipeline.Stored(stage(spark, before, DATA), "test-stage").frame
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names, name
            assert docs.join(before.select("doc_id"), "doc_id").count() == docs.count() <= before.count()
            assert docs.count() > 0.5 * before.count(), name
    assert docs.select("doc_id").distinct().count() == before.count()
