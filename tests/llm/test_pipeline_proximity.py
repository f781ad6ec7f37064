import corpus_pipeline


def test_passage_with_inserted_words_goes(spark, tmp_path):
    words = [f"term{i}" for i in range(40)]
    unnamed = [f"item{i}" for i in range(40)]
    spark.createDataFrame([("1", " ".join(words)), (None, " ".join(unnamed))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    inserted = " ".join(w + (" also" if k % 9 == 4 else "") for k, w in enumerate(words))
    of_unnamed = " ".join(w + (" also" if k % 9 == 4 else "") for k, w in enumerate(unnamed))
    other = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, inserted), (2, of_unnamed), (3, other), (4, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.benchmark(spark, docs, str(tmp_path)).collect()) == [3, 4]
