"""The corpus pipeline on the smallest scale, stage by stage."""

import corpus_pipeline
from traitloom.llm import crf_langid, markov_secrets

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    extra = spark.createDataFrame([(10**6, None, "en", "src0", 0), (10**6 + 1, "123 !!", "en", "src0", 6)], docs.schema)
    docs = docs.unionByName(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[1] == counts[0] and counts[2] < counts[1] and counts[3] == counts[2] and counts[4] > 0
    assert docs.where("doc_id >= 1000000").count() == 0
    assert markov_secrets.scan(docs, table=[0.0] * 4096).where("size(base) > 0").count() == 0
    name, stage = corpus_pipeline.STAGES[-1]
    assert stage(spark, docs, SF).count() == counts[4]


def test_no_document_is_lost_to_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.language_id(spark, docs, SF)
    assert kept.count() == docs.count()
    assert crf_langid.train(docs.limit(0)) is None


def test_run_is_a_table(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "pieces", "n_pieces", "text_sha256"] and out.count() > 0
