"""Models of many series, candidate starts, folds and fractions, each fitted in a group of its own.

A group is one daily series (at most some thousand rows), so its task's memory is
bounded by the days there are; parallelism is over series, candidates and folds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as w
from tidemark.operators import frames, montecarlo
from tidemark.operators.models import CHANGE_SCALE, FOLD_ROUNDS, ROUNDS, SCORER_ROUNDS, BoostedTrees, Garch, SeasonalTrend
from tidemark.sources.series import settled

DEFAULT = [w.Feature("lag", 1), w.Feature("lag", 2), w.Feature("mean", 7), w.Feature("std", 7), w.Feature("vol", 7), w.Feature("sma", 14), w.Feature("ema", 14)]


def _days(dates) -> np.ndarray:
    return pd.to_datetime(pd.Series(dates)).to_numpy().astype("datetime64[D]").astype(np.int64).astype(float)


def fit_predict(pdf: pd.DataFrame, names: list[str], test: np.ndarray, rounds: int, weekly: bool = True, **trees) -> tuple[np.ndarray, np.ndarray, SeasonalTrend, BoostedTrees]:
    """Baseline and residual corrections for all rows, learned from those that aren't test rows."""
    day, y, x = _days(pdf["date"]), pdf["log_close"].to_numpy(float), pdf[names].to_numpy(float)
    trend = SeasonalTrend(weekly).fit(day[~test], y[~test])
    base = trend.predict(day)
    model = BoostedTrees(rounds, **trees).fit(x[~test], (y - base)[~test])
    return base, model.predict(x), trend, model


def accuracy(truth: np.ndarray, guess: np.ndarray) -> float:
    return float(((np.diff(truth) > 0) == (np.diff(guess) > 0)).mean()) if len(truth) > 1 else 0.5


def dealt(rows: DataFrame, keys: list[str]):
    """Groups in as many tasks as the session shuffles to; adaptive execution would put small ones, however slow, into one."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).groupBy(*keys)


def _evaluated(keys: list[str], names: list[str] | None, rounds: int, weekly: bool, least: int):
    """names: the features in use; None if each group's rows tell (_used)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        head = pdf[keys].iloc[:1].reset_index(drop=True)
        test = pdf["is_test"].to_numpy(bool)
        if len(pdf) <= least or test.all() or test.sum() < 2:
            return head.iloc[:0].assign(acc=[], mae=[], mse=[], days=[])
        base, more, _, _ = fit_predict(pdf, list(pdf["_used"].iloc[0]) if names is None else names, test, rounds, weekly)
        y, p = pdf["log_close"].to_numpy(float)[test], (base + more)[test]
        return head.assign(acc=accuracy(y, p), mae=float(np.abs(np.exp(y) - np.exp(p)).mean()), mse=float(np.square(y - p).mean()), days=len(pdf))

    return run


#: Features by which candidate starts are scored, for the posterior and for the weighted score; their test rows.
SCORER = [w.Feature("lag", 1), w.Feature("lag", 7), w.Feature("mean", 7), w.Feature("mean", 14)]
WEIGHTED_SCORER = [w.Feature("lag", n) for n in (1, 7, 14)] + [w.Feature(k, n) for n in (7, 14, 30) for k in ("mean", "std")]
SCORER_TEST_ROWS = 90


def score_cutoffs(df: DataFrame, cutoffs: DataFrame, features=SCORER, test_rows: int = SCORER_TEST_ROWS, rounds: int = SCORER_ROUNDS, least: int = 365) -> DataFrame:
    """series_id, pos, cutoff, acc, mae, mse, days of every candidate start with at least `least` rows, and over test_rows + 30 complete ones.

    A candidate knows no row before it: its features warm up from its own first row on,
    and days counts the rows that are complete then.
    """
    rows = frames.after_each(df, cutoffs)
    own = Window.partitionBy("series_id", "pos")
    rows = rows.withColumn("_rows", F.count("*").over(own)).where(F.col("_rows") >= least).drop("_rows")
    # to the windows, each candidate is a series
    built = frames.split(w.build(rows.withColumn("series_id", F.struct("series_id", "pos", "cutoff")).drop("pos", "cutoff"), features), test_rows)
    names = [f.name for f in features]
    built = built.select("series_id.*", "date", "log_close", "is_test", *names)
    keys = ["series_id", "pos", "cutoff"]
    return dealt(built, keys).applyInPandas(_evaluated(keys, names, rounds, False, test_rows + 30), "series_id string, pos long, cutoff date, acc double, mae double, mse double, days long")


def fold_rows(df: DataFrame, features=DEFAULT, window: int = 90, n_folds: int = 4, least: int = 730, chosen: DataFrame | None = None) -> DataFrame:
    """Rows of every expanding fold, of those complete in the features that their series uses (_used)."""
    rows = _with_choice(df, features, chosen).where(F.col("ret").isNotNull() & F.col("log_close").isNotNull())
    there = [~F.array_contains("_used", f.name) | F.col(f.name).isNotNull() for f in features]
    return frames.folds(rows.where(F.forall(F.array(*there), lambda x: x)), window, n_folds, least)


def walk_forward(df: DataFrame, features=DEFAULT, window: int = 90, n_folds: int = 4, least: int = 730, rounds: int = FOLD_ROUNDS, chosen: DataFrame | None = None) -> DataFrame:
    """series_id, fold, acc, mae, mse, days, and the dates train_end, test_start and test_end of expanding folds; chosen: (series_id, features) that a series uses."""
    rows = fold_rows(df, features, window, n_folds, least, chosen)
    run = _evaluated(["series_id", "fold"], None, rounds, True, 0)

    def dated(pdf: pd.DataFrame) -> pd.DataFrame:
        test = pdf["is_test"].to_numpy(bool)
        return run(pdf).assign(train_end=pdf["date"][~test].max(), test_start=pdf["date"][test].min(), test_end=pdf["date"][test].max())

    return dealt(rows, ["series_id", "fold"]).applyInPandas(dated, "series_id string, fold int, acc double, mae double, mse double, days long, train_end date, test_start date, test_end date")


def evaluated_folds(pdf: pd.DataFrame, names: list[str], window: int, n_folds: int, least: int, rounds: int):
    """(fold, its one row of scores) for the expanding folds of one series of complete rows, as frames.folds cuts them."""
    run, n = _evaluated(["series_id", "fold"], names, rounds, True, 0), len(pdf)
    if n - window <= least:
        return
    pdf = pdf.sort_values("date").reset_index(drop=True)
    ends = sorted({least + i * (n - window - least) // max(1, n_folds - 1) for i in range(n_folds)})
    for fold, end in enumerate(ends):
        part = pdf.iloc[: end + window].assign(fold=fold)
        for _, r in run(part.assign(is_test=np.arange(len(part)) >= end)).iterrows():
            yield fold, r


def learning_curve(df: DataFrame, features=DEFAULT, fractions=(0.2, 0.4, 0.6, 0.8, 1.0), test_rows: int = 90, rounds: int = ROUNDS) -> DataFrame:
    """The same for models that learn from the first part of the training rows."""
    rows = frames.split(w.build(df, features), test_rows)
    rows = rows.withColumns({"rn": w.position(), "n": F.count_if(~F.col("is_test")).over(Window.partitionBy("series_id"))})
    rows = rows.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    rows = rows.where(F.col("is_test") | (F.col("rn") <= F.floor(F.col("fraction") * F.col("n"))))
    run = _evaluated(["series_id", "fraction"], [f.name for f in features], rounds, True, 30)
    return rows.groupBy("series_id", "fraction").applyInPandas(run, "series_id string, fraction double, acc double, mae double, mse double, days long")


#: Names of a trial's settings in the rows and in BoostedTrees.
SETTINGS = ("depth", "rate", "row_share", "column_share")


def tree_trials(trials: int, seed: int = 42) -> list[tuple[int, int, float, float, float]]:
    """(trial, depth, rate, row_share, column_share) drawn from the ranges of the search: 3 to 8, 0.01 to 0.2 by logarithm, 0.6 to 1."""
    rng = np.random.default_rng(seed)
    return [(i, int(rng.integers(3, 9)), float(np.exp(rng.uniform(np.log(0.01), np.log(0.2)))), float(rng.uniform(0.6, 1)), float(rng.uniform(0.6, 1))) for i in range(trials)]


def search_trees(df: DataFrame, trials: int = 20, features=DEFAULT, k: int = 4, test_rows: int = 90, rounds: int = ROUNDS) -> DataFrame:
    """series_id, trial, depth, rate, row_share, column_share, mse: seeded random search scored on expanding folds of the training rows."""
    names = [f.name for f in features]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date").reset_index(drop=True)
        errors, own = [], {c: pdf[c].iloc[0] for c in SETTINGS}
        for train, end in frames.expanding_cv(len(pdf), k):
            part = pdf.iloc[:end]
            test = np.arange(end) >= train
            if train > 30:
                base, more, _, _ = fit_predict(part, names, test, rounds, **own)
                errors.append(np.square(part["log_close"].to_numpy(float) - base - more)[test].mean())
        return pdf[["series_id", "trial", *SETTINGS]].iloc[:1].assign(mse=float(np.mean(errors)) if errors else None)

    rows = frames.split(w.build(df, features), test_rows).where("not is_test")
    options = [F.struct(*[F.lit(v).cast(t).alias(c) for c, t, v in zip(("trial", *SETTINGS), ("long", "long", "double", "double", "double"), o)]) for o in tree_trials(trials)]
    rows = rows.withColumn("t", F.explode(F.array(*options)))
    schema = "series_id string, trial long, depth long, rate double, row_share double, column_share double, mse double"
    return dealt(rows.select("series_id", "date", "log_close", *names, "t.*"), ["series_id", "trial"]).applyInPandas(run, schema)


class Recursion:
    """State of a series one step ahead: a bounded tail of rows and the running averages."""

    def __init__(self, pdf: pd.DataFrame, features):
        self.features = features
        keep = max([f.n for f in features] + [1]) + 1
        self.close, self.ret, self.volume = (pdf[c].to_numpy(float)[-keep:].tolist() for c in ("close", "ret", "volume"))
        self.keep = keep
        self.ema = {f.n: float(pdf[f"ema_{f.n}"].iloc[-1]) for f in features if f.kind == "ema"}

    def row(self) -> list[float]:
        out = []
        for f in self.features:
            tail = {"lag": self.ret, "mean": self.ret, "std": self.ret, "vol": self.volume, "sma": self.close, "ema": self.close}[f.kind][-f.n :]
            match f.kind:
                case "lag":
                    out.append(tail[0] if len(tail) == f.n else 0.0)
                case "std":
                    out.append(float(np.std(tail, ddof=1)) if len(tail) > 1 else 0.0)
                case "ema":
                    out.append(self.ema[f.n])
                case _:
                    out.append(float(np.mean(tail)))
        return out

    def push(self, close: float, ret: float) -> None:
        for s in self.ema:
            self.ema[s] += 2 / (s + 1) * (close - self.ema[s])
        for xs, x in ((self.close, close), (self.ret, ret), (self.volume, self.volume[-1])):
            xs.append(x)
            del xs[: -self.keep]


def _with_choice(df: DataFrame, features, chosen: DataFrame | None) -> DataFrame:
    """Rows with all features, and the names of those that the series uses: chosen (series_id, features), else all."""
    rows = w.build(df, features, drop=False)
    return rows.withColumn("_used", F.array(*[F.lit(f.name) for f in features])) if chosen is None else rows.join(chosen.select("series_id", F.col("features").alias("_used")), "series_id")


def _used(pdf: pd.DataFrame, features) -> tuple[pd.DataFrame, list]:
    """Complete rows in date order, and the features in use."""
    names = set(pdf["_used"].iloc[0])
    own = [f for f in features if f.name in names]
    columns = ["series_id", "date", "close", "volume", "ret", "log_close", *[f.name for f in own]]
    return pdf[columns].dropna().sort_values("date").reset_index(drop=True), own


def evaluate(df: DataFrame, features=DEFAULT, test_rows: int = 90, rounds: int = ROUNDS, chosen: DataFrame | None = None) -> DataFrame:
    """series_id, hits, n, acc, mse of the last test_rows, learned from the rows before: directions that agree, and squared errors of the logarithm."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, own = _used(pdf, features)
        if len(pdf) < test_rows + 60:
            return pd.DataFrame({c: [] for c in ("series_id", "hits", "n", "acc", "mse")})
        test = np.arange(len(pdf)) >= len(pdf) - test_rows
        base, more, _, _ = fit_predict(pdf, [f.name for f in own], test, rounds)
        y, p = pdf["log_close"].to_numpy(float)[test], (base + more)[test]
        same = (np.diff(y) > 0) == (np.diff(p) > 0)
        return pd.DataFrame({"series_id": [pdf["series_id"].iloc[0]], "hits": [int(same.sum())], "n": [len(same)], "acc": [float(same.mean())], "mse": [float(np.square(y - p).mean())]})

    return _with_choice(df, features, chosen).groupBy("series_id").applyInPandas(run, "series_id string, hits long, n long, acc double, mse double")


def forecast(df: DataFrame, features=DEFAULT, horizon: int = 90, test_rows: int = 90, rounds: int = ROUNDS, feedback: str = "predicted", chosen: DataFrame | None = None) -> DataFrame:
    """series_id, h, date, baseline, residual, price, sigma for each future day; chosen: (series_id, features) names that a series uses.

    feedback tells what a step leaves behind for the next one: `predicted` its own
    price and return, `repeat` the last row again (with its return), `flat` the last
    close with no return.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, own = _used(pdf, features)
        if len(pdf) < test_rows + 60:
            return pd.DataFrame({c: [] for c in ("series_id", "h", "date", "baseline", "residual", "price", "sigma")})
        names = [f.name for f in own]
        test = np.arange(len(pdf)) >= len(pdf) - test_rows
        base, more, trend, trees = fit_predict(pdf, names, test, rounds)
        left = (pdf["log_close"].to_numpy(float) - base - more)[~test]
        sigma = np.sqrt(Garch().fit(left * 100).path(horizon) / 10_000)
        last = pd.Timestamp(pdf["date"].iloc[-1])
        dates = pd.date_range(last + pd.Timedelta(days=1), periods=horizon)
        ahead = trend.predict(_days(dates))
        state, prices, residuals = Recursion(pdf, own), [], []
        for h in range(horizon):
            r = float(trees.predict(np.array([state.row()]))[0])
            price = float(np.exp(ahead[h] + r))
            prices.append(price)
            residuals.append(r)
            before = state.close[-1]
            if feedback == "predicted":
                state.push(price, price / before - 1 if before else 0.0)
            else:
                state.push(before, state.ret[-1] if feedback == "repeat" else 0.0)
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "h": np.arange(1, horizon + 1), "date": dates.date, "baseline": np.exp(ahead), "residual": residuals, "price": prices, "sigma": sigma})

    schema = "series_id string, h long, date date, baseline double, residual double, price double, sigma double"
    return _with_choice(df, features, chosen).groupBy("series_id").applyInPandas(run, schema)


def baseline(df: DataFrame, horizon: int = 90, runs: int = 1000, seed: int = 42, change_scale: float = CHANGE_SCALE) -> DataFrame:
    """series_id, date, yhat, yhat_lower, yhat_upper: the seasonal trend over history and future, with 95 % bounds.

    In the history the bounds hold the noise; in the future also changes of slope, as
    often and as large as those found, drawn by step and run. The model has no changes in
    the last fifth of the history, and its bounds know of none there. A small change_scale
    (of the prior) shrinks the changes found, and so the bounds: trends that turn often
    need a larger one to be covered as often as the bounds say.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        model = SeasonalTrend(laplace=change_scale).fit(_days(pdf["date"]), np.log(pdf["close"].to_numpy(float)))
        dates = list(pdf["date"]) + list(pd.date_range(pd.Timestamp(pdf["date"].iloc[-1]) + pd.Timedelta(days=1), periods=horizon).date)
        rate, scale = model.change()
        h = np.arange(len(dates)) - len(pdf) + 1
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "date": dates, "h": h, "yhat": model.predict(_days(dates)), "rate": rate, "scale": scale, "sigma": model.sigma})

    schema = "series_id string, date date, h long, yhat double, rate double, scale double, sigma double"
    rows = settled(dealt(df.where("close > 0"), ["series_id"]).applyInPandas(run, schema))
    ahead = montecarlo.trend_bounds(rows.where("h > 0").drop("date"), runs, seed).select("series_id", "h", "mc_low", "mc_high")
    out, noise = rows.join(ahead, ["series_id", "h"], "left"), 1.959963984540054 * F.col("sigma")
    return out.select("series_id", "date", "yhat", F.coalesce("mc_low", F.col("yhat") - noise).alias("yhat_lower"), F.coalesce("mc_high", F.col("yhat") + noise).alias("yhat_upper"))


def garch(df: DataFrame) -> DataFrame:
    """series_id, omega, alpha, beta, next_variance of the returns in percent."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        e = pdf.sort_values("date")["ret"].dropna().to_numpy(float) * 100
        m = Garch().fit(e) if len(e) > 10 else Garch()
        return pd.DataFrame({"series_id": [pdf["series_id"].iloc[0]], "omega": [m.omega], "alpha": [m.alpha], "beta": [m.beta], "next_variance": [m.last]})

    return w.with_returns(df).groupBy("series_id").applyInPandas(run, "series_id string, omega double, alpha double, beta double, next_variance double")
