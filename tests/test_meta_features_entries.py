"""The written stack is read back by its stored entries."""

from pyspark.sql import functions as F

from postlens.plans import io_queries


def test_rows_read_back_are_never_made_dense(spark, tmp_path):
    docs = [(i, f"word{i % 4} and word{i % 3} here") for i in range(20)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    vectors = [(i, [0.0 if i % 5 == 0 else i + 0.5, -1.0], i % 3) for i in range(10)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = io_queries.q_write_meta_features(spark, str(tmp_path))
    assert "UDF" not in out._jdf.queryExecution().optimizedPlan().toString()  # vector_to_array is one, and holds every feature of a row
    rows = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("value").alias("least")).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == list(range(12))
    assert [r.least == -1.0 for r in rows] == [True] * 10 + [False] * 2
    assert out.filter("value = 0").isEmpty()
