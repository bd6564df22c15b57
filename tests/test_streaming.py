"""Row-level operators run unchanged on a streaming DataFrame."""

from pyspark.sql import functions as F

from labelscope.streaming import score_stream

from conftest import SF_SMALL


def test_score_stream_memory_sink(spark, tmp_path):
    src = str(tmp_path / "src")
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    e.select("vec_id", F.col("label").alias("y_true"),
             F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double")).alias("logits")) \
        .write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema("vec_id BIGINT, y_true INT, logits ARRAY<DOUBLE>").parquet(src)
    q = (score_stream(stream).writeStream.format("memory").queryName("scored_stream")
         .option("checkpointLocation", str(tmp_path / "ckpt"))
         .outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    out = spark.sql("SELECT * FROM scored_stream")
    assert out.count() == e.count()
    assert out.where("correct NOT IN (0, 1) OR ce < 0").count() == 0
