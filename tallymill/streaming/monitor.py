"""Streaming counterpart of the monitoring reports: traces arrive as JSON files or as a table of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..types import TRACE


def trace_stream(spark: SparkSession, folder: str) -> DataFrame:
    """JSON traces as they are dropped in a folder, with an event time."""
    return spark.readStream.schema(TRACE).json(folder).withColumn("event_time", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))


def windowed(traces: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Count, mean and approximate percentiles of t_total by window and mode; duplicates of an id within the watermark count once."""
    once = traces.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["id"])
    stats = F.percentile_approx("t_total", F.array(F.lit(0.5), F.lit(0.95)), F.lit(10_000))
    return once.groupBy(F.window("event_time", window), "mode").agg(F.count(F.lit(1)).alias("n"), F.avg("t_total").alias("mean"), stats.alias("quantiles")).select(
        F.col("window.start").alias("start"), "mode", "n", "mean", F.col("quantiles")[0].alias("p50"), F.col("quantiles")[1].alias("p95")
    )


def run_to_table(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows to a parquet folder and stop when the input is used up."""
    return df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
