"""Choice of rolling windows, averages and start dates by what they tell of the next return."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as w
from tidemark.functions.stats import partial_autocorrelations, safe_corr, significant_lags

#: Candidate rows of rolling windows and spans of averages.
ROLLING = (3, 5, 7, 14, 21, 30, 60)
AVERAGES = (3, 5, 7, 14, 21, 30)


def _long(df: DataFrame, names: list[str], value: str) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(i).cast("long").alias("pos"), F.lit(n).cast("long").alias("n"), F.col(f"c_{n}").alias(value)) for i, n in enumerate(names)])
    return df.select("series_id", F.explode(parts).alias("p")).select("series_id", "p.*")


def _targets(df: DataFrame) -> DataFrame:
    df = w.with_returns(df)
    return df.withColumn("next_ret", F.lead("ret", 1).over(w.order()))


def score_windows(df: DataFrame, candidates=ROLLING) -> DataFrame:
    """series_id, pos, n, score: mean absolute correlation of rolling mean, deviation and volume with the next return."""
    rows = _targets(df).withColumns({f"{k}_{n}": w.rolling(f, x, n) for n in candidates for k, f, x in (("m", F.avg, "ret"), ("s", F.stddev_samp, "ret"), ("v", F.avg, "volume"))})
    score = {n: sum((F.coalesce(F.abs(safe_corr(f"{k}_{n}", "next_ret")), F.lit(0.0)) for k in "msv"), F.lit(0.0)) / 3 for n in candidates}
    return _long(rows.groupBy("series_id").agg(*[score[n].alias(f"c_{n}") for n in candidates]), list(candidates), "score")


def score_averages(df: DataFrame, kind: str = "sma", candidates=AVERAGES) -> DataFrame:
    """series_id, pos, n, score: absolute correlation of a simple or exponential average with the next return."""
    if kind == "sma":
        rows = _targets(df).withColumns({f"a_{n}": w.rolling(F.avg, "close", n) for n in candidates})
    else:
        rows = _targets(w.exponential(df, list(candidates))).withColumns({f"a_{n}": F.col(f"ema_{n}") for n in candidates})
    return _long(rows.groupBy("series_id").agg(*[F.coalesce(F.abs(safe_corr(f"a_{n}", "next_ret")), F.lit(0.0)).alias(f"c_{n}") for n in candidates]), list(candidates), "score")


def top(scores: DataFrame, k: int = 3) -> DataFrame:
    """The k best of each series; equals keep the candidates' order."""
    by = Window.partitionBy("series_id").orderBy(F.desc("score"), "pos")
    return scores.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k)


def _of_series(scores: DataFrame):
    return Window.partitionBy("series_id" if "series_id" in scores.columns else F.lit(0))


def weighted_score(scores: DataFrame) -> DataFrame:
    """scores (acc, mae, days) with score = 0.6 acc + 0.2 (1 - mae / max mae) + 0.2 days / max days, the largest of each series."""
    by = _of_series(scores)
    score = 0.6 * F.col("acc") + 0.2 * (1 - F.try_divide(F.col("mae"), F.max("mae").over(by))) + 0.2 * F.try_divide(F.col("days"), F.max("days").over(by))
    return scores.withColumn("score", score)


def first_best(scores: DataFrame, score: str, order: str) -> DataFrame:
    """The best row of each series (of all rows without series_id); of equals the first in order."""
    by = _of_series(scores).orderBy(F.desc(score), order)
    return scores.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")


def candidates(max_lag: int) -> list[w.Feature]:
    """All features that a choice can name."""
    windows = [w.Feature(k, n) for n in ROLLING for k in ("mean", "std", "vol")]
    return [w.Feature("lag", i) for i in range(1, max_lag + 1)] + windows + [w.Feature(k, n) for k in ("ema", "sma") for n in AVERAGES]


def choose(train: DataFrame, max_lag: int, k: int = 3) -> DataFrame:
    """series_id, features: names of the significant lags, and of the k best windows and averages of either kind."""
    lags = significant_lags(partial_autocorrelations(w.with_returns(train), "ret", max_lag)).select("series_id", F.concat(F.lit("lag_ret_"), "lag").alias("name"))
    windows = top(score_windows(train), k).select("series_id", F.explode(F.array(*[F.concat(F.lit(p), "n") for p in ("roll_mean_ret_", "roll_std_ret_", "roll_vol_")])).alias("name"))
    averages = [top(score_averages(train, kind), k).select("series_id", F.concat(F.lit(f"{kind}_"), "n").alias("name")) for kind in ("ema", "sma")]
    names = lags.unionByName(windows).unionByName(averages[0]).unionByName(averages[1])
    return names.groupBy("series_id").agg(F.array_sort(F.collect_set("name")).alias("features"))
