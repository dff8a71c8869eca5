import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import grouped
from tidemark.plans import forecast
from tidemark.plans.forecast import RunConfig
from tidemark.service import Busy, Engine, under
from tidemark.streaming import daily


def test_stream_equals_batch(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    folder = tmp_path / "in"
    batch.repartition(2).write.parquet(str(folder))
    stream = daily.daily(daily.read_events(spark, str(folder), batch.schema))
    q = daily.write(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(str(tmp_path / "out"))
    last = batch.agg(F.max(F.to_date("ts"))).first()[0]
    want = batch.groupBy("event_type", F.to_date("ts").alias("date")).agg(F.max_by("value", "event_id").alias("close"), F.count("*").cast("double").alias("volume"))
    done = {r.date for r in got.collect()}
    assert done and max(done) < last
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in want.collect() if r.date in done)


def test_engine(spark, tmp_path):
    closes = 100 + np.cumsum(np.random.default_rng(5).normal(size=900))

    def load(session, ticker):
        rows = session.range(900).select(F.lit("s").alias("series_id"), F.expr("date_add(date '2020-01-01', cast(id as int))").alias("date"), F.element_at(F.array(*[F.lit(float(c)) for c in closes]), F.col("id").cast("int") + 1).alias("close"), F.lit(1.0).alias("volume"))
        return rows

    engine = Engine(spark, load, str(tmp_path), key="k")
    config = RunConfig(horizon_days=30, test_last_days=30, monte_carlo_runs=100, max_cutoff_candidates=2)
    with pytest.raises(PermissionError):
        engine.start(config)
    with pytest.raises(FileNotFoundError):
        engine.latest()
    with pytest.raises(ValueError):
        engine.start(RunConfig(horizon_days=30, output_dir="/etc"), "k")
    engine.state["running"] = True
    with pytest.raises(Busy):
        engine.start(config, "k")
    engine.state["running"] = False
    engine.start(config, "k", wait=True, rounds=10)
    assert engine.status()["error"] is None and not engine.status()["running"]
    latest = engine.latest()
    assert latest["rows"] == 30 and "map_cutoff" in latest["stats"]
    stats = json.loads(latest["stats"])
    assert stats["walk_forward_folds"] == len(stats.get("walk_forward_details", [])) and 0 <= stats["directional_accuracy"] <= 1 and 0 < stats["p_value"] <= 1
    assert stats["ensemble_members"] == len(stats["cutoff_posteriors"]) == 2 and stats["cutoff_freq"] == "MS" and stats["min_cutoff_train_days"] == 730 and len(stats["regime_emoji"]) == 1
    assert stats["significant"] == (stats["p_value"] < 0.05) and stats["residual_test_mse"] > 0
    assert {a["set"] for a in engine.artifacts()} == {"forecast", "history", "summary"} and engine.health()["status"] == "ok"
    below = str(tmp_path / "second")
    assert engine.artifacts(below) == []
    engine.start(RunConfig(horizon_days=31, test_last_days=30, monte_carlo_runs=100, output_dir=below, max_cutoff_candidates=2), "k", wait=True, rounds=10)
    assert engine.latest(below)["rows"] == 31 and engine.latest()["rows"] == 30
    with pytest.raises(ValueError):
        engine.latest("/etc")


def test_paths_with_a_scheme():
    assert under("s3a://b/root/x", "s3a://b/root") and not under("s3a://b/root/../x", "s3a://b/root") and not under("s3a://b/rootx", "s3a://b/root") and not under("/root/x", "s3a://b/root")


def test_two_series_each_have_their_own_start_and_path(spark):
    rng = np.random.default_rng(3)
    days = [d.date() for d in pd.date_range("2018-01-01", periods=1000)]
    rows = [(s, d, float(c), float(v)) for s, size in (("a", 1000), ("b", 900)) for d, c, v in zip(days[-size:], 100 * np.exp(np.cumsum(rng.normal(0, 0.01, size))) * (1 if s == "a" else 50), rng.uniform(1, 9, size))]
    df = spark.createDataFrame(rows, "series_id string, date date, close double, volume double")
    config = RunConfig(horizon_days=30, test_last_days=30, monte_carlo_runs=100, max_lag=10, max_cutoff_candidates=2)
    table, scored, kept = forecast.run(df, config, rounds=10)
    total = {r.series_id: (r.n, r.s) for r in scored.groupBy("series_id").agg(F.count("*").alias("n"), F.sum("posterior").alias("s")).collect()}
    assert set(total) == {"a", "b"} and all(abs(s - 1) < 1e-9 for _, s in total.values())
    got = table.groupBy("series_id").agg(F.count("*").alias("n"), F.avg("combined_price").alias("p"), F.max(F.expr("combined_low_mc > combined_price or combined_high_mc < combined_price")).alias("off")).collect()
    last = {r.series_id: r.close for r in kept.groupBy("series_id").agg(F.max_by("close", "date").alias("close")).collect()}
    assert {r.series_id: r.n for r in got} == {"a": 30, "b": 30} and all(0.5 < r.p / last[r.series_id] < 2 and not r.off for r in got)
    names = {r.series_id: r.features for r in forecast.chosen_features(kept, config).collect()}
    assert all(sum(x.startswith(k) for x in v) == 3 for v in names.values() for k in ("roll_mean_ret_", "roll_vol_", "ema_", "sma_")) and all(any(x.startswith("lag_ret_") for x in v) for v in names.values())
    said = {r.series_id: r for r in forecast.summary(table, scored, kept, config, 10).collect()}
    starts = {r.series_id: str(r.cutoff) for r in scored.where("chosen").collect()}
    assert {k: r.map_cutoff for k, r in said.items()} == starts
    assert set(said) == {"a", "b"} and said["a"].forecast_30d != said["b"].forecast_30d
    ways = [grouped.forecast(df, horizon=5, test_rows=30, rounds=30, feedback=x).orderBy("series_id", "h").toPandas()["price"].round(9).tolist() for x in ("predicted", "repeat", "flat")]
    assert ways[0] != ways[1] and ways[1] != ways[2] and ways[0] != ways[2]


def test_settings_from_the_environment():
    config = RunConfig.from_env({"HORIZON_DAYS": "40", "BAYESIAN_TEMPERATURE": "1.5", "OTHER": "x", "OUTPUT_DIR": "/tmp/x"})
    assert (config.horizon_days, config.bayesian_temperature, config.output_dir, config.max_lag) == (40, 1.5, "/tmp/x", 60)


def test_summary_names_the_start_that_the_forecast_used(spark):
    rng = np.random.default_rng(11)
    days = [d.date() for d in pd.date_range("2018-01-01", periods=1100)]
    df = spark.createDataFrame([("a", d, float(c), 1.0) for d, c in zip(days, 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 1100))))], "series_id string, date date, close double, volume double")
    config, first = RunConfig(horizon_days=30, test_last_days=30, monte_carlo_runs=100, max_lag=10, max_cutoff_candidates=6), {}
    for choice in ("posterior", "weighted"):
        table, scored, kept = forecast.run(df, config, rounds=10, choice=choice)
        by = {"posterior": "posterior", "weighted": "score"}[choice]
        want = min(scored.collect(), key=lambda r: (-r[by], r.cutoff))
        said = forecast.summary(table, scored, kept, config, 10).first()
        assert said.map_cutoff == str(want.cutoff) == str(kept.agg(F.min("date")).first()[0]) and said.map_posterior == want.posterior
        assert said.cutoff_candidates_evaluated == 6
        first[choice] = {r.cutoff: (r.acc, r.days) for r in scored.collect()}
    assert first["posterior"] != first["weighted"]
