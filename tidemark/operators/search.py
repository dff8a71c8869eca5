"""Model-based search of tree settings: a tree-structured Parzen estimator whose trials run in rounds.

A round's trials of every series are fitted side by side, one group each; the next round's
settings are drawn where good trials of that series (the best `GOOD` share so far) lie
denser than the others. Every draw is seeded by the series and the round, so results don't
depend on how rows are dealt out. Between rounds only trials and their errors are kept,
written to the checkpoint folder so that a lost executor repeats no fit.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import windows as w
from tidemark.operators import frames, grouped
from tidemark.operators.models import ROUNDS
from tidemark.sources.series import settled

GOOD, MOST_GOOD, DRAWS = 0.25, 25, 24


@dataclass(frozen=True)
class Range:
    """A setting's bounds; whole numbers and logarithms are told."""

    name: str
    low: float
    high: float
    whole: bool = False
    log: bool = False

    def unit(self, v):
        """Values as places from 0 to 1; a whole number lies in the middle of its share."""
        v = np.asarray(v, float)
        if self.whole:
            return (v - self.low + 0.5) / (self.high - self.low + 1)
        lo, hi = (math.log(self.low), math.log(self.high)) if self.log else (self.low, self.high)
        return ((np.log(v) if self.log else v) - lo) / (hi - lo)

    def value(self, u: float) -> float:
        if self.whole:
            return float(min(self.high, self.low + math.floor(u * (self.high - self.low + 1))))
        if self.log:
            return math.exp(math.log(self.low) + u * (math.log(self.high) - math.log(self.low)))
        return self.low + u * (self.high - self.low)


#: The searched settings of the boosted trees and their bounds.
TREES = (Range("depth", 3, 8, whole=True), Range("rate", 0.01, 0.2, log=True), Range("row_share", 0.6, 1.0), Range("column_share", 0.6, 1.0))


class Parzen:
    """A mixture of normals around places in 0 to 1, cut off at the ends, and one wide normal for what is unknown."""

    def __init__(self, places: np.ndarray):
        at = np.append(np.asarray(places, float), 0.5)
        order = np.argsort(at, kind="stable")
        padded = np.concatenate([[0.0], at[order], [1.0]])
        gaps = np.maximum(padded[1:-1] - padded[:-2], padded[2:] - padded[1:-1])
        width = np.empty(len(at))
        width[order] = np.clip(gaps, 1 / min(100, len(at) + 1), 1.0)
        width[-1] = 1.0
        self.at, self.width = at, width
        self.inside = self._cumulated(1.0) - self._cumulated(0.0)

    def _cumulated(self, x: float) -> np.ndarray:
        return np.array([0.5 * (1 + math.erf((x - m) / (s * math.sqrt(2)))) for m, s in zip(self.at, self.width)])

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        out = []
        while len(out) < n:
            k = int(rng.integers(len(self.at)))
            x = rng.normal(self.at[k], self.width[k])
            if 0 <= x < 1:
                out.append(x)
        return np.array(out)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (np.asarray(x)[:, None] - self.at) / self.width
        return np.log((np.exp(-0.5 * z * z) / (self.width * math.sqrt(2 * math.pi) * self.inside)).mean(axis=1))


def suggest(ranges: tuple[Range, ...], tried: np.ndarray, errors: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """n settings (rows of values) to try next; at random without earlier trials (rows of values) and their errors.

    A round's later settings take its earlier ones for bad trials, so that they spread.
    """
    out: list[list[float]] = []
    for _ in range(n):
        if not len(errors):
            out.append([r.value(rng.random()) for r in ranges])
            continue
        order = np.argsort(errors, kind="stable")
        good = order[: min(MOST_GOOD, math.ceil(GOOD * len(errors)))]
        bad = np.setdiff1d(order, good)
        pending = np.array(out).reshape(-1, len(ranges))
        row = []
        for k, r in enumerate(ranges):
            near, far = Parzen(r.unit(tried[good, k])), Parzen(r.unit(np.concatenate([tried[bad, k], pending[:, k]])))
            x = near.draw(rng, DRAWS)
            row.append(r.value(float(x[np.argmax(near.log_density(x) - far.log_density(x))])))
        out.append(row)
    return np.array(out)


def _seed(*parts) -> int:
    return zlib.crc32(":".join(map(str, parts)).encode())


def propose(series: DataFrame, done: DataFrame | None, ranges: tuple[Range, ...], first: int, n: int, seed: int) -> DataFrame:
    """series_id, trial and settings of the next n trials of every series. done: earlier trials with mse; failed ones (null) tell nothing."""
    names = [r.name for r in ranges]
    schema = "series_id string, trial long, " + ", ".join(f"{c} double" for c in names)

    def run(key, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        old = old[old["mse"].notna()].sort_values("trial")
        rng = np.random.default_rng(_seed(seed, first, key[0]))
        rows = suggest(ranges, old[names].to_numpy(float), old["mse"].to_numpy(float), n, rng)
        return pd.DataFrame(rows, columns=names).assign(series_id=key[0], trial=np.arange(first, first + n))[["series_id", "trial", *names]]

    if done is None:
        done = series.sparkSession.createDataFrame([], schema + ", mse double")
    return series.groupBy("series_id").cogroup(done.groupBy("series_id")).applyInPandas(run, schema)


def _fitted(names: list[str], ranges: tuple[Range, ...], rounds: int, folds: int | None):
    """A trial's error: the mean over expanding folds of the training rows, or that of the test rows."""
    settings = [r.name for r in ranges]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date").reset_index(drop=True)
        own = {r.name: int(pdf[r.name].iloc[0]) if r.whole else float(pdf[r.name].iloc[0]) for r in ranges}
        spans = frames.expanding_cv(len(pdf), folds) if folds else [(int((~pdf["is_test"]).sum()), len(pdf))]
        errors = []
        for train, end in spans:
            if train > 30 and end > train:
                part = pdf.iloc[:end]
                test = np.arange(end) >= train
                base, more, _, _ = grouped.fit_predict(part, names, test, rounds, **own)
                errors.append(float(np.square(part["log_close"].to_numpy(float) - base - more)[test].mean()))
        return pdf[["series_id", "trial", *settings]].iloc[:1].assign(mse=float(np.mean(errors)) if errors else None)

    return run


def tuned_trees(df: DataFrame, trials: int = 20, features=grouped.DEFAULT, folds: int | None = 4, test_rows: int = 90, rounds: int = ROUNDS, start: int = 8, batch: int = 4, seed: int = 42, ranges: tuple[Range, ...] = TREES) -> DataFrame:
    """series_id, trial, settings, mse and best (the first of the least errors) of every trial.

    folds: the error is the mean over that many expanding folds of the training rows, or
    with None the error on the test rows. start: trials drawn at random; the others come
    in rounds of batch. Series too short for a fit have trials without an error.
    """
    names, own = [f.name for f in features], [r.name for r in ranges]
    rows = frames.split(w.build(df, features), test_rows)
    rows = settled((rows.where("not is_test") if folds else rows).select("series_id", "date", "log_close", "is_test", *names))
    series = rows.select("series_id").distinct()
    schema = "series_id string, trial long, " + ", ".join(f"{c} double" for c in own) + ", mse double"
    done, first = None, 0
    while first < trials:
        n = min(start if done is None else batch, trials - first)
        new = propose(series, done, ranges, first, n, seed)
        # a group for each trial: the series' rows go to each of its trials' tasks
        fitted = grouped.dealt(rows.join(new, "series_id"), ["series_id", "trial"]).applyInPandas(_fitted(names, ranges, rounds, folds), schema)
        done = settled(fitted if done is None else done.unionByName(fitted))
        first += n
    least = done.where("mse is not null").groupBy("series_id").agg(F.min(F.struct("mse", "trial")).alias("l")).select("series_id", F.col("l.trial").alias("best_trial"))
    return done.join(least, "series_id", "left").select("series_id", "trial", *own, "mse", F.coalesce(F.col("trial") == F.col("best_trial"), F.lit(False)).alias("best"))
