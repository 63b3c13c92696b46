import corpus_pipeline
from tests.llm.cases import prose


def test_pipeline(spark, tmp_path):
    good = prose(120, 21, 60, 120)
    texts = good + good[:10] + ["LOUD!! " * 80, None, "", "short"]
    rows = [(k, t, "en", f"s{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, counts = docs.columns, []
    for k, (_, fn) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = fn(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
    assert counts[:3] == [130, 130, 120]
    assert {r.doc_id for r in spark.read.parquet(f"{tmp_path}/2").collect()} == set(range(120))
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "sequence_id"} <= set(pieces.columns) and pieces.count() > 0
