"""Coverage of a stream of metric rows: the same summary, kept up to date as events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_coverage(stream: DataFrame, time: str, metric: str, value: str, *, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, metric, count, mean, std, min, max) of event-time windows; rows later than the watermark are dropped by it.

    Works alike on a batch table.
    """
    # Watermarks ask for timestamps with a zone.
    kept = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if stream.isStreaming else stream
    out = kept.groupBy(F.window(time, window).alias("w"), F.col(metric).alias("metric")).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    return out.select(F.col("w.start").alias("window_start"), "metric", "count", "mean", "std", "min", "max")


def run_to_batches(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what is there now and writes each window that changed, open ones too, under path/batch=N.

    A batch that is run again after a failure replaces what it wrote; a restart goes on from the checkpoint.
    """

    def put(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest_windows(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each window that run_to_batches wrote; the windows still open are among them."""
    held = spark.read.parquet(path)
    rest = [c for c in held.columns if c not in ("window_start", "metric", "batch")]
    last = held.groupBy("window_start", "metric").agg(F.max_by(F.struct(*rest), "batch").alias("s"))
    return last.select("window_start", "metric", "s.*")


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what is there now and appends finished windows as Parquet; a restart goes on from the checkpoint.

    Windows that the watermark has not closed yet come with a later run; see run_to_batches for those.
    """
    query = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
