import corpus_pipeline as cp


def test_stages_keep_clean_documents(spark, docs_of, tmp_path):
    names = ["the", "water", "house", "under", "river", "stone"]
    body = lambda k: " ".join(f"{names[(i * k) % 6]}{'abcdefghij'[(i * i + k) % 10]}{'klmnopq'[(i + k) % 7]}" for i in range(60))
    item = " ".join(f"item{'abcdefghij'[i % 10]}{'klmno'[i % 5]}{'qrstuv'[i % 6]}" for i in range(30))
    rows = [(k, body(k)) for k in range(12)] + [(20, body(3)), (21, body(3) + " more"), (22, f"{body(40)} {item}"), (23, None), (24, "1234 5678"), (5, body(5))]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in cp.STAGES[:3]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        kept.append(sorted(r["doc_id"] for r in out.select("doc_id").collect()))
        docs = out
    assert kept[0] == sorted(r[0] for r in rows if r[0] not in (23, 24))
    assert kept[1] == [*range(12), 22]
    assert kept[2] == [*range(12)]
    final = cp.run(spark, str(tmp_path))
    assert set(r["doc_id"] for r in final.collect()) <= set(range(12)) and final.count() > 0


def test_empty(spark, docs_of, tmp_path):
    docs_of([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
