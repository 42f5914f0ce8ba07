import corpus_pipeline


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.language_id(spark, docs, sf)
    assert kept.columns == columns and kept.count() == docs.filter("text rlike '\\\\p{L}'").count()
    unique = corpus_pipeline.exact_dedup(spark, docs, sf)
    assert unique.columns == columns and unique.count() == docs.selectExpr("regexp_replace(text, '[\\\\x20\\\\x09-\\\\x0D]+', ' ') AS t").distinct().count()
    mixed = corpus_pipeline.mix_to_weights(spark, docs, sf)
    assert mixed.columns == columns and mixed.groupBy("doc_id").count().filter("count > 3").count() == 0


def test_mixing_writes_no_copy_of_the_texts(spark, tmp_path):
    """Rows of a Parquet table are known by file and place; a file that is read twice, and other tables, are numbered as before."""
    path = f"{tmp_path}/a table"
    rows = [(i % 3, "one two three", None if i % 5 == 0 else "web", i) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, row_key int").repartition(3).write.parquet(path)
    once, twice = spark.read.parquet(path), spark.read.parquet(path, path)
    keyed, row = corpus_pipeline._placed(once)
    assert row == "_row_key" and keyed.select(row).distinct().count() == keyed.count() == 20
    found = [corpus_pipeline.mix_to_weights(spark, docs, "") for docs in (once, once.filter("true"))]
    assert set(once.inputFiles()) <= set(found[0].inputFiles())
    assert found[0].columns == once.columns and found[0].count() == found[1].count()
    for docs in (twice, once.filter("doc_id = 1").select("doc_id", "text", "source")):
        keyed, row = corpus_pipeline._placed(docs)
        assert keyed.select(row).distinct().count() == keyed.count() == docs.count()
