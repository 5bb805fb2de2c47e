"""The pipeline's stages keep the columns of documents, and their decisions take effect."""

import corpus_pipeline


def test_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        assert {r.doc_id for r in docs.collect()} <= ids
    assert corpus_pipeline.tokenize(spark, docs, folder).count() == docs.count()


def test_near_copies_are_joined_once(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(4, text), (3, text), (3, text), (9, "other words that stand for themselves alone here"), (None, "no id"), (None, "no id")]
    docs = spark.createDataFrame([(n, t, "en", "src1", len(t)) for n, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "9", "None", "None"]
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("Join LeftSemi") == 1
