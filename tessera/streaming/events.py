"""Structured Streaming: exactly-once resume by key, windows with late data, merges by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, folder: str, schema, fmt: str = "parquet", per_trigger: int = 100) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_trigger).load(folder)


def first_of_key(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Each key once; state older than the watermark is dropped. Works on batch frames too."""
    return (stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])) if stream.isStreaming else stream.dropDuplicates([key])


def windows(df: DataFrame, time: str, by: list[str], size: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts and sums of value by time window and group."""
    df = df.withWatermark(time, delay) if df.isStreaming else df
    out = df.groupBy(F.window(time, size, slide or size).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(df: DataFrame, time: str, key: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Stretches of a key's events without a gap of that length."""
    df = df.withWatermark(time, delay) if df.isStreaming else df
    out = df.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def merge_batches(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch goes through merge once; the checkpoint remembers which ones did."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
