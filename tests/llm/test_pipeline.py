"""The pipeline end to end on the smallest tables, each stage against what it promises."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sonorium.llm import queries
from sonorium.llm.common import written

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, docs, str(DATA)))
        assert after.columns == columns and {r.doc_id for r in after.collect()} <= ids and after.count() > 0.5 * docs.count(), name
        docs = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(DATA))
    assert last.columns == ["doc_id", "source", "n_pieces", "ids"] and last.count() == docs.count()


def test_run_is_the_same_again(spark):
    once, again = (corpus_pipeline.run(spark, str(DATA)).select(F.count("*"), F.sum(F.xxhash64("doc_id", "ids").cast("decimal(38,0)"))).first() for _ in range(2))
    assert once == again


def test_registered(spark):
    assert list(corpus_pipeline.queries()) == ["pipeline"] and len(queries.queries()) == 10
    assert len({n.split("_")[0] for n in queries.queries()}) == 10
