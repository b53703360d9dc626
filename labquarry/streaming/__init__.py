"""The same aggregates over streams: windows with watermarks, sessions and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed(df: DataFrame, time: str, every: str, keys: list[str], value: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(window_start, keys, n, total) of tumbling or sliding windows; rows later than the watermark are dropped on streams."""
    w = F.window(time, every, slide) if slide else F.window(time, every)
    out = df.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """(keys, session_start, session_end, n): runs of events with gaps below `gap`."""
    out = df.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_of_each(df: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Repeats of the keys dropped; the state is bounded by the watermark on streams."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def collect_stream(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and returns its rows; for tests and small results."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(300)
    if q.isActive:
        q.stop()
        raise TimeoutError("the stream did not end in 300 s")
    return df.sparkSession.table(name)
