"""Pages as they arrive: the batch operators over a stream of new sheets, and counts by event time.

The batch engine has no streaming counterpart to match; these wrap its operators for continuous arrival.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_pages(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive below a path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def score_arrivals(pages: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs a batch operator over each micro-batch and writes its rows to a folder of the batch's number, so that a batch that runs again replaces itself."""
    def each(batch: DataFrame, number: int) -> None:
        score(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, key: str, *, late: str = "10 minutes", window: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Counts by window and key; rows later than the watermark are left out."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def first_seen(pages: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """Each page once, however often it is sent within the watermark."""
    return pages.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
