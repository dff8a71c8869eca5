"""Running figures on a stream against the batch: restarts, repeats, nulls, expiry."""

import datetime

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import windows as w
from tidemark.streaming import running

SCHEMA = "series_id string, at timestamp, date date, close double"
START = datetime.datetime(2024, 1, 1)


def feed(spark, folder, rows):
    spark.createDataFrame([(s, START + datetime.timedelta(days=d, hours=23), (START + datetime.timedelta(days=d)).date(), c) for s, d, c in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def drain(spark, tmp, spans=(1, 5), expiry=400):
    days = spark.readStream.schema(SCHEMA).parquet(f"{tmp}/in").withWatermark("at", "1 day")
    q = running.figures(days, list(spans), expiry).writeStream.outputMode("append").option("checkpointLocation", f"{tmp}/ck").trigger(availableNow=True).format("parquet").start(f"{tmp}/out")
    q.awaitTermination()
    return sorted(map(tuple, spark.read.parquet(f"{tmp}/out").collect()), key=str)


def batch(spark, rows, spans=(1, 5)):
    df = spark.createDataFrame([(s, (START + datetime.timedelta(days=d)).date(), c) for s, d, c in rows], "series_id string, date date, close double")
    so_far = Window.partitionBy("series_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    df = w.exponential(df, list(spans)).withColumn("ret", w.simple_return()).withColumns({"n_returns": F.count("ret").over(so_far), "volatility": F.stddev_samp("ret").over(so_far)})
    df = df.withColumn("volatility", F.when(F.col("n_returns") > 1, F.col("volatility")))
    return sorted(map(tuple, df.select("series_id", "date", "close", "ret", "n_returns", "volatility", *[f"ema_{s}" for s in spans]).collect()), key=str)


def same(got, want):
    assert len(got) == len(want) > 0
    for a, b in zip(got, want):
        assert a[:3] == b[:3] and a[4] == b[4]
        for x, y in zip(a[3:], b[3:]):
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=1e-9, abs=1e-12))


def test_stream_equals_batch_after_a_restart(spark, tmp_path):
    draw = np.random.default_rng(4)
    rows = [(s, d, None if draw.random() < 0.1 else float(np.round(draw.uniform(1, 9), 3))) for s in ("a", "b", None) for d in range(0, 40)]
    for lo, hi in ((0, 15), (15, 16), (16, 40)):
        feed(spark, f"{tmp_path}/in", [r for r in rows if lo <= r[1] < hi])
        got = drain(spark, tmp_path)
    same(got, batch(spark, rows))


def test_repeats_are_left_out_and_zero_is_no_base(spark, tmp_path):
    rows = [("a", 0, 0.0), ("a", 1, 2.0), ("a", 2, 3.0)]
    feed(spark, f"{tmp_path}/in", [*rows, ("a", 2, 3.0)])
    assert [r[3] for r in drain(spark, tmp_path)] == [None, None, 0.5]
    feed(spark, f"{tmp_path}/in", [("a", 2, 9.0), ("a", 3, 6.0)])
    got = drain(spark, tmp_path)
    assert [r[2:5] for r in got] == [(0.0, None, 0), (2.0, None, 0), (3.0, 0.5, 1), (6.0, 1.0, 2)]


def test_state_goes_when_a_series_ends(spark, tmp_path):
    feed(spark, f"{tmp_path}/in", [("gone", 0, 1.0), ("gone", 1, 2.0), ("lives", 0, 1.0)])
    drain(spark, tmp_path, expiry=10)
    for day in (5, 30):
        feed(spark, f"{tmp_path}/in", [("lives", day, 2.0)])
        drain(spark, tmp_path, expiry=10)
    feed(spark, f"{tmp_path}/in", [("gone", 31, 4.0), ("lives", 31, 4.0)])
    last = {r[0]: r for r in drain(spark, tmp_path, expiry=10) if r[1] == datetime.date(2024, 2, 1)}
    assert last["gone"][3:5] == (None, 0) and last["gone"][6:] == (4.0, 4.0)
    # it was idle for more than the expiry, too, before day 30; its row at 30 came with the watermark of day 5
    assert last["lives"][2] == 4.0 and last["lives"][4] >= 1


def test_empty_stream(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in")
    assert drain(spark, tmp_path) == []
