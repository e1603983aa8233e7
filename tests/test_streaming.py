from pyspark.sql import functions as F

from sheetweave.streaming import pages


def test_arrivals(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for k in range(2):
        spark.range(k * 10, k * 10 + 10).select((F.col("id") % 2).alias("sheet_id"), "id").coalesce(1).write.mode("append").parquet(src)
    stream = pages.read_pages(spark, src, "sheet_id long, id long", files_per_batch=1)
    q = pages.score_arrivals(stream, lambda df: df.groupBy("sheet_id").agg(F.count("*").alias("n")), out, f"{tmp_path}/state")
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.select("batch").distinct().count() == 2 and got.agg(F.sum("n")).first()[0] == 20


def test_windows(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type").write.parquet(f"{tmp_path}/ev")
    stream = pages.read_pages(spark, f"{tmp_path}/ev", "ts timestamp, event_type string")
    q = pages.windowed_counts(stream, "ts", "event_type").writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 1000
