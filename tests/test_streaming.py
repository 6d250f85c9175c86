from pyspark.sql import functions as F

from statloom.streaming.windows import windowed_moments


def test_stream_equals_table(spark, tmp_path):
    rows = spark.range(500).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 7).cast("double").alias("v"), (F.col("id") % 2).alias("k"))
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    query = windowed_moments(stream, "ts", "v", ["k"], lateness="1 day").writeStream.format("memory").queryName("moments").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {tuple(r) for r in spark.table("moments").select("window_start", "k", "n", F.round("mean", 9)).collect()}
    assert got == {tuple(r) for r in windowed_moments(rows, "ts", "v", ["k"]).select("window_start", "k", "n", F.round("mean", 9)).collect()}
