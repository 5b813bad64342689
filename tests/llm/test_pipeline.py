"""Queries of the corpus operators against their SQL, and the pipeline stage by stage."""

import os
from pathlib import Path

import pytest

import oracle
from loudframe.llm.common import stored
from loudframe.llm.queries import ORACLES

SF_DIR = os.environ.get("CONTRACT_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="shared tables not present")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert oracle.compare(spark, oracle.connect(SF_DIR), name, SF_DIR) is None


def test_stages_keep_columns_and_clean_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stored(stage(spark, docs, SF_DIR), name)
        assert kept.columns == columns and 0.6 * docs.count() < kept.count() <= docs.count()
        assert kept.exceptAll(docs).count() == 0
        docs = kept
    packed = stored(corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR), "packing")
    assert packed.where("start = 0").count() == docs.count()
