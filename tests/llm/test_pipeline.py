"""The pipeline's contract: stages, columns, decisions that take effect."""

import os

import pytest

import corpus_pipeline
from suasion.llm import quality
from suasion.sources.tables import table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages_run_one_on_another(spark):
    docs = table(spark, SF, "documents")
    columns, ids, sizes = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        here = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert set(here) <= ids
        ids = set(here)
        sizes.append(len(here))
    assert sizes[0] < table(spark, SF, "documents").count()
    assert sizes[1] < sizes[0]
    assert sizes[3] >= sizes[2]
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert final.count() == sizes[3]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_quality_stage_keeps_what_scores_enough(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    good = {r["doc_id"] for r in quality.quality(docs, labels).filter("score >= 0.3").collect()}
    assert {r["doc_id"] for r in quality.keep_good(docs, labels, 0.3).select("doc_id").collect()} == good
