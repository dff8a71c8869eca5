"""Readers, column discovery and builders of daily series, and sinks for what comes out.

A series table has series_id string, date, close double, volume double, one row for
each day that has data; days may be missing.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of its own only in a session without executors elsewhere."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-"))
    return spark.sparkContext.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def flat_names(headers: Iterable) -> list[str]:
    """One name for each header: the levels of a nested one joined by underscores."""
    return ["_".join(map(str, h)).strip() if isinstance(h, (tuple, list)) else str(h) for h in headers]


def find_column(df: DataFrame, *needles: str, required: bool = True) -> str | None:
    """The first column whose lower-cased name contains a needle; needles in order of preference of place."""
    for name in df.columns:
        if any(n in name.lower() for n in needles):
            return name
    if required:
        raise ValueError(f"no column like {' or '.join(needles)}")
    return None


def normalise(df: DataFrame, date: str = "date", adjusted: bool = False, need_volume: bool = False, series: Column | None = None) -> DataFrame:
    """series_id, date, close, volume of a raw market table; a missing volume is zero unless needed."""
    price = find_column(df, "close", "adj") if adjusted else find_column(df, "close")
    volume = find_column(df, "volume", required=need_volume)
    return df.select(
        (series if series is not None else F.lit("all")).alias("series_id"),
        F.to_date(date).alias("date"),
        F.col(price).cast("double").alias("close"),
        (F.col(volume).cast("double") if volume else F.lit(0.0)).alias("volume"),
    )


def daily(df: DataFrame, time: str, value: str, key: str, by: str | None = None, unit: str = "day") -> DataFrame:
    """A series from event rows: the last value by key as close, the number of rows as volume."""
    when = F.to_date(time) if unit == "day" else F.date_trunc(unit, time)
    series = F.col(by).cast("string") if by else F.lit("all")
    return df.groupBy(series.alias("series_id"), when.alias("date")).agg(F.max_by(value, key).cast("double").alias("close"), F.count("*").cast("double").alias("volume"))


def prices(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    """Daily series of orders; one for each value of `by`."""
    return daily(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "o_orderkey", by)


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily shipped quantity and its number of lines."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.lit("flow").alias("series_id"), F.to_date("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("close"), F.count("*").cast("double").alias("volume"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly series of events by type."""
    return daily(table(spark, sf_dir, "events"), "ts", "value", "event_id", "event_type", "hour")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A document; broken ones give nulls."""
    return spark.read.json(path, schema=schema, multiLine=True, mode="PERMISSIVE")


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Name and size of the files in a folder, by name."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))
    return files.orderBy("name")


def tail(df: DataFrame, n: int = 365) -> DataFrame:
    return df.orderBy(F.desc("date")).limit(n)


def head(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy("date").limit(n)


def write_forecast(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Written by date range in parallel; as CSV with headers, sorted inside each file."""
    out = df.repartitionByRange("date").sortWithinPartitions("date").write.mode("overwrite")
    out.csv(path, header=True) if fmt == "csv" else out.format(fmt).save(path)


def write_summary(summary: DataFrame, path: str) -> None:
    summary.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
