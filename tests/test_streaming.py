from sample import TEXT, sample

from glossa.streaming import documents


def test_stream_of_documents(spark, tmp_path):
    spark.createDataFrame([(0, TEXT)], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    a = sample(spark)
    hits = documents.word_hits(stream, a.markers, a.rules, a.p)
    query = hits.writeStream.format("memory").queryName("hits").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c1").start()
    query.awaitTermination()
    assert spark.table("hits").count() == 8 and spark.table("hits").where("noise_reason <> ''").count() == 1
    query = documents.tag_stream(stream, a.sources, a.p, f"{tmp_path}/out", f"{tmp_path}/c2")
    query.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 14
