"""Running figures of series on a stream: what a row needs of all rows before it, kept as state.

State is one row for each series: its last day and close, the number, mean and spread of
its returns, and its exponential averages. It goes once the watermark is `expiry` days
past the last row, so tickers that are delisted don't stay for ever; a series that comes
back later starts anew. Restarts go on from the checkpoint.

Input is a stream of finished days in date order from batch to batch, as daily.daily's:
a day at or before the last one seen (a repeat) is left out. A null or zero close before
a row makes its return null, and a null close leaves averages as they are. Of one batch
a series' rows are held together, one a day.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tidemark.sources.series import shared_folder, table
from tidemark.streaming import daily

DAY_MS = 86_400_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunningFigures(StatefulProcessor):
    def __init__(self, spans: list[int], expiry: int):
        self.spans, self.expiry = spans, expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("figures", "day long, close double, n long, mean double, m2 double, averages array<double>, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        before = self.state.get() if self.state.exists() else None
        day, close, n, mean, m2, averages, timer = before or (None, None, 0, 0.0, 0.0, [None] * len(self.spans), None)
        averages = list(averages)
        out = []
        batch = pd.concat(list(rows))
        for when, value in sorted(zip(pd.to_datetime(batch["date"]), batch["close"]), key=lambda r: r[0]):
            at = (when - pd.Timestamp(0)).days
            if day is not None and at <= day:
                continue
            value = None if pd.isna(value) else float(value)
            ret = value / close - 1 if value is not None and close else None
            if ret is not None:
                n += 1
                gap = ret - mean
                mean += gap / n
                m2 += gap * (ret - mean)
            if value is not None:
                averages = [value if y is None else y + 2 / (s + 1) * (value - y) for y, s in zip(averages, self.spans)]
            day, close = at, value
            out.append((key[0], when.date(), value, ret, n, math.sqrt(m2 / (n - 1)) if n > 1 else None, *averages))
        if out:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = (day + self.expiry) * DAY_MS
            self.handle.registerTimer(timer)
            self.state.update((day, close, n, mean, m2, averages, timer))
        yield pd.DataFrame(out, columns=["series_id", "date", "close", "ret", "n_returns", "volatility", *[f"ema_{s}" for s in self.spans]])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def figures(days: DataFrame, spans: list[int], expiry: int = 400) -> DataFrame:
    """series_id, date, close, ret, n_returns, volatility (of all returns so far) and ema_{span} of a stream of days with a watermark.

    The session gets RocksDB as its state store, as Spark asks for it here.
    """
    days.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    schema = "series_id string, date date, close double, ret double, n_returns long, volatility double" + "".join(f", ema_{s} double" for s in spans)
    return days.groupBy("series_id").transformWithStateInPandas(RunningFigures(spans, expiry), schema, "append", "eventtime")


def replay(spark: SparkSession, sf_dir: str, spans: list[int]) -> DataFrame:
    """Figures of the events table read as a stream, up to the last day that its watermark has finished."""
    out = f"{shared_folder(spark)}/running-{uuid.uuid4().hex}"
    # a pattern, as a stream takes a plain path for a folder
    events = daily.read_events(spark, f"{sf_dir}/[e]vents.parquet", table(spark, sf_dir, "events").schema)
    days = daily.daily(events, keep_time=True)
    query = figures(days, spans).writeStream.outputMode("append").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).format("parquet").start(f"{out}/rows")
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows")
