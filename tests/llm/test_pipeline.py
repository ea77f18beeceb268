"""The pipeline's stages: each decides on its own input, and what it keeps stays whole."""

import pytest

from isomesh.llm import langid, near, quality, secrets
from tests.llm.helpers import SCHEMA, SMALL, odd_documents, small_documents

pipeline = pytest.importorskip("corpus_pipeline")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(map(str, r)))


def test_stages_agree_with_their_operators(spark):
    docs = small_documents(spark)
    names = docs.columns
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "packing":
            assert out.columns == names
        ids = {r.doc_id for r in out.collect()}
        if name == "language_id":
            assert ids == {r.doc_id for r in langid.report(docs).where("kept").collect()}
        elif name == "quality_rules":
            assert ids == {r.doc_id for r in quality.report(docs).where("kept").collect()}
        elif name == "near_dedup":
            assert ids == {r.class_id for r in near.report(docs).collect()}
        elif name == "secret_scan":
            found = {r.doc_id: r.found for r in secrets.find_secrets(docs).collect()}
            for r in docs.join(out.selectExpr("doc_id", "text as masked", "n_chars as n"), "doc_id").collect():
                assert (r.masked == r.text) == (not found[r.doc_id])
                assert len(r.masked) == r.n
        else:
            assert ids == {r.doc_id for r in docs.collect()}
        if name != "packing":
            docs = out.cache()
    assert 50 < docs.count() < 200
    assert rows(pipeline.run(spark, SMALL).select("doc_id", "start", "ids_crc32")) == rows(out.select("doc_id", "start", "ids_crc32"))


def test_odd_and_empty_tables(spark):
    odd = odd_documents(spark, [None, "", "é", "x " * 40000, "the same words again " * 30, "the same words again " * 30])
    for df in (odd, spark.createDataFrame([], SCHEMA)):
        for _, stage in pipeline.STAGES[:-1]:
            out = stage(spark, df, SMALL)
            assert out.columns == df.columns and out.count() <= df.count()
        assert pipeline.STAGES[-1][1](spark, df, SMALL).count() >= df.count()
