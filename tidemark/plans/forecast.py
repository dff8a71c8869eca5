"""The forecast from a series to its intervals and summary."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import frames, grouped, montecarlo, selection
from tidemark.sources.series import settled


@dataclass(frozen=True)
class RunConfig:
    """A run's settings; out of bounds is an error."""

    ticker: str = "BTC-USD"
    horizon_days: int = 365
    test_last_days: int = 90
    monte_carlo_runs: int = 1000
    bayesian_temperature: float = 2.0
    max_lag: int = 60
    random_state: int = 42
    output_dir: str | None = None
    cutoff_freq: str = "MS"
    min_cutoff_train_days: int = 730
    max_cutoff_candidates: int = 48

    @classmethod
    def from_env(cls, env: Mapping[str, str]) -> RunConfig:
        """Settings from variables named like them in capitals; others have their defaults."""
        found = {f.name: env[f.name.upper()] for f in fields(cls) if f.name.upper() in env}
        return cls(**{k: type(getattr(cls, k))(v) if getattr(cls, k) is not None else v for k, v in found.items()})

    def __post_init__(self):
        # The bounds of a run request.
        for name, lo, hi in (("horizon_days", 30, 3650), ("test_last_days", 30, 1000), ("monte_carlo_runs", 100, 20000), ("max_lag", 5, 120)):
            if not lo <= getattr(self, name) <= hi:
                raise ValueError(f"{name} must be from {lo} to {hi}")
        if not 0 < self.bayesian_temperature <= 10:
            raise ValueError("bayesian_temperature must be above 0 and at most 10")
        if self.max_cutoff_candidates < 2 or self.min_cutoff_train_days < 0:
            raise ValueError("there must be two candidates or more, and no negative number of days")


def choose_start(df: DataFrame, config: RunConfig, rounds: int = 100, choice: str = "posterior") -> DataFrame:
    """Candidate starts with accuracy, posterior, weighted score and chosen: whether the series starts there, by `posterior` or by the `weighted` score."""
    features, by = {"posterior": (grouped.SCORER, "posterior"), "weighted": (grouped.WEIGHTED_SCORER, "score")}[choice]
    grid = frames.cutoff_grid(df, config.cutoff_freq, config.min_cutoff_train_days, config.max_cutoff_candidates)
    scored = selection.weighted_score(stats.posterior(grouped.score_cutoffs(df, grid, features, rounds=rounds), config.bayesian_temperature))
    place = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc(by), "cutoff"))
    return scored.withColumn("chosen", place == 1)


def with_intervals(path: DataFrame, runs: int, seed: int = 42) -> DataFrame:
    """The forecast table: date, baseline, residual, price and the simulated interval."""
    steps = path.withColumn("log_price", F.ln("price"))
    ci = montecarlo.gaussian(steps.select("series_id", "h", "log_price", "sigma"), runs, seed)
    return path.join(ci, ["series_id", "h"]).select("series_id", "h", "date", F.col("baseline").alias("prophet_baseline"), F.col("residual").alias("xgboost_res"), F.col("price").alias("combined_price"), F.col("mc_low").alias("combined_low_mc"), F.col("mc_high").alias("combined_high_mc"))


def chosen_features(rows: DataFrame, config: RunConfig) -> DataFrame:
    """The features that each series uses, told from the rows before its test rows."""
    return selection.choose(frames.split(rows, config.test_last_days).where("not is_test").drop("is_test"), config.max_lag)


def run(df: DataFrame, config: RunConfig, rounds: int = 200, choice: str = "posterior") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(forecast table, scored starts, rows from the chosen start on) of every series; both of the latter are written once."""
    scored = settled(choose_start(df, config, choice=choice))
    best = scored.where("chosen").select("series_id", "cutoff")
    rows = settled(df.join(best, "series_id").where(F.col("date") >= F.col("cutoff")).drop("cutoff"))
    path = grouped.forecast(rows, selection.candidates(config.max_lag), config.horizon_days, config.test_last_days, rounds, chosen=chosen_features(rows, config))
    return with_intervals(path, config.monte_carlo_runs, config.random_state), scored, rows


def evaluation(rows: DataFrame, config: RunConfig, rounds: int = 200) -> DataFrame:
    """series_id, directional_accuracy, p_value, significant, residual_test_mse, and the walk-forward folds with their mean and deviation."""
    chosen = chosen_features(rows, config)
    held = grouped.evaluate(rows, selection.candidates(config.max_lag), config.test_last_days, rounds, chosen)
    p = stats.binomial_at_least(F.col("hits"), F.col("n"))
    held = held.select("series_id", F.col("acc").alias("directional_accuracy"), p.alias("p_value"), (p < 0.05).alias("significant"), F.col("mse").alias("residual_test_mse"))
    each = grouped.walk_forward(rows, selection.candidates(config.max_lag), config.test_last_days, least=max(365, config.min_cutoff_train_days), chosen=chosen)
    detail = F.struct(*[F.col(c).cast("string").alias(c) for c in ("train_end", "test_start", "test_end")], F.col("acc").alias("directional_accuracy"))
    walked = each.groupBy("series_id").agg(F.count("*").alias("walk_forward_folds"), F.avg("acc").alias("walk_forward_mean_accuracy"), F.stddev_pop("acc").alias("walk_forward_std_accuracy"), F.array_sort(F.collect_list(detail)).alias("walk_forward_details"))
    return held.join(walked, "series_id", "left").withColumn("walk_forward_folds", F.coalesce("walk_forward_folds", F.lit(0).cast("long")))


def summary(forecast: DataFrame, scored: DataFrame, rows: DataFrame, config: RunConfig, rounds: int = 200) -> DataFrame:
    """One row for each series with the chosen start, regime, settings, evaluation, prices and all posteriors."""
    best = scored.where("chosen").select("series_id", F.col("cutoff").cast("string").alias("map_cutoff"), F.col("posterior").alias("map_posterior"))
    all_ = scored.groupBy("series_id").agg(F.count("*").alias("cutoff_candidates_evaluated"), F.count("*").alias("ensemble_members"), F.array_sort(F.collect_list(F.struct(F.col("cutoff").cast("string").alias("cutoff"), F.col("acc").alias("accuracy"), "posterior"))).alias("cutoff_posteriors"))
    now = frames.latest(rows).select("series_id", F.col("close").alias("current_price"))
    ends = forecast.groupBy("series_id").agg(*[F.max(F.when(F.col("h") == min(k, config.horizon_days), F.col("combined_price"))).alias(n) for k, n in ((30, "forecast_30d"), (90, "forecast_90d"), (config.horizon_days, "forecast_target"))], *[F.max_by(c, "h").alias(n) for c, n in (("combined_low_mc", "ci95_low_target"), ("combined_high_mc", "ci95_high_target"))])
    out = best.join(all_, "series_id").join(stats.regime(rows).select("series_id", "regime", "regime_emoji"), "series_id").join(now, "series_id").join(ends, "series_id").join(evaluation(rows, config, rounds), "series_id", "left")
    settings = [F.lit(config.ticker).alias("ticker"), *[F.lit(getattr(config, c)).alias(c) for c in ("horizon_days", "test_last_days", "monte_carlo_runs", "bayesian_temperature", "max_lag", "cutoff_freq", "min_cutoff_train_days")]]
    return out.select(*settings, "*")
