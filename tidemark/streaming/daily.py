"""The daily series of an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def daily(events: DataFrame, time: str = "ts", value: str = "value", key: str = "event_id", by: str = "event_type", delay: str = "1 day", keep_time: bool = False) -> DataFrame:
    """series_id, date, close, volume of each day; rows later than the delay are left out, as state is dropped then.

    With keep_time also `at`, the time that carries the watermark, for state further on.
    """
    windowed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).groupBy(F.window(time, "1 day").alias("day"), F.col(by).alias("series_id"))
    out = windowed.agg(F.max_by(value, key).cast("double").alias("close"), F.count("*").cast("double").alias("volume"))
    return out.select("series_id", F.to_date("day.start").alias("date"), "close", "volume", *([F.window_time("day").alias("at")] if keep_time else []))


def write(df: DataFrame, path: str, checkpoint: str):
    """Appends finished days to Parquet; restarts go on from the checkpoint."""
    return df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet").start(path)
