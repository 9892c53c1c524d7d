"""The registered queries and the pipeline over the smallest tables."""

import corpus_pipeline
import pytest
from tests.compare import same
from tests.llm import fixtures as X

from wharfline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_sql(spark, sf, name):
    same(spark, sf, queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_a_row_for_each_document(spark, sf, name):
    documents = spark.read.parquet(f"{sf}/documents.parquet").count()
    out = queries.queries()[name](spark, sf)
    assert out.count() == documents and out.select("doc_id").distinct().count() == documents


def test_pipeline_stages_narrow_the_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, columns = docs.count(), docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "bpe_encode_decode"]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        now = docs.count()
        assert 0.5 * before < now <= before
        if name != "bpe_encode_decode":
            assert docs.columns == columns
        before = now
    assert corpus_pipeline.run(spark, sf).count() == before


@pytest.mark.parametrize("content", ["awkward", "empty"])
@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_take_awkward_tables(spark, sf, name, stage, content):
    docs = spark.createDataFrame(X.rows() if content == "awkward" else [], X.SCHEMA)
    out = stage(spark, docs, sf)
    n = out.count()
    assert n <= docs.count() and (name == "bpe_encode_decode" or out.columns == docs.columns)
    if name in ("line_dedup", "bpe_encode_decode"):
        assert n == docs.count()
