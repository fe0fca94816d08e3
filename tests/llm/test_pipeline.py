"""The pipeline against its stages one by one, and what each stage promises."""

import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline as p
    from folia.llm import secrets

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert 0 < docs.count() <= before
        before = docs.count()
    assert not [r for r in docs.collect() if secrets.base_spans(r["text"])]
    want = {r["doc_id"]: r["ids_sha256"] for r in p.tokens(spark, docs, DATA).collect()}
    assert {r["doc_id"]: r["ids_sha256"] for r in p.run(spark, DATA).collect()} == want
    assert len(p.STAGES) == 5 and p.ORACLE_SQL is None
