import corpus_pipeline


def test_language_id_without_labels(spark):
    rows = [(1, "some words", None), (2, "слова", None), (3, "12 !!", None), (4, None, None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.language_id(spark, docs, "")
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == rows[:2]
