"""Table functions that SQL calls on a partitioned and ordered table argument.

    select * from series_regime(TABLE(prices) PARTITION BY series_id ORDER BY (date), 30)
    select * from fold_scores(TABLE(features) PARTITION BY series_id ORDER BY (date), array('lag_ret_1'), 90, 4, 730, 120)

Arguments and columns are checked when the query is analysed, and series_id keeps its
type. Other columns of the table are ignored. An empty table gives no rows; series_id
may be null, such rows are one series.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tidemark.operators.grouped import evaluated_folds


def _output(table: AnalyzeArgument, needed: list[str], rest: list[tuple[str, object]]) -> AnalyzeResult:
    """The output's schema, series_id first; an error where the argument is no table or lacks a column."""
    if not table.isTable:
        raise ValueError("the first argument must be a table: TABLE(...) PARTITION BY series_id ORDER BY date")
    if missing := [c for c in needed if c not in table.dataType.names]:
        raise ValueError(f"the table lacks the columns {', '.join(missing)}")
    schema = StructType().add("series_id", table.dataType["series_id"].dataType)
    for name, kind in rest:
        schema = schema.add(name, kind)
    return AnalyzeResult(schema=schema)


def _constant(argument: AnalyzeArgument, name: str, least: int = 1):
    if argument.isTable or argument.value is None or (not isinstance(argument.value, list) and argument.value < least):
        raise ValueError(f"{name} must be a constant of at least {least}")
    return argument.value


def _over(x: float | None, y: float | None) -> float | None:
    return None if x is None or not y else x / y - 1


class SeriesRegime:
    """series_id, trend, vol and regime at the end of a series in date order, as stats.regime; holds `window` + 1 rows."""

    @staticmethod
    def analyze(table: AnalyzeArgument, window: AnalyzeArgument) -> AnalyzeResult:
        _constant(window, "window", 2)
        return _output(table, ["series_id", "date", "close"], [("trend", DoubleType()), ("vol", DoubleType()), ("regime", StringType())])

    def __init__(self):
        self.series, self.window, self.closes = None, 0, None

    def eval(self, row: Row, window: int) -> None:
        if self.closes is None:
            self.series, self.window, self.closes = row["series_id"], window, deque(maxlen=window + 1)
        self.closes.append(None if row["close"] is None else float(row["close"]))

    def terminate(self) -> Iterator[tuple]:
        if not self.closes:
            return
        x = list(self.closes)
        trend = _over(x[-1], x[-self.window]) if len(x) >= self.window else None
        moves = [r for r in map(_over, x[1:], x) if r is not None]
        vol = float(np.std(moves, ddof=1)) if len(moves) > 1 else None
        yield self.series, trend, vol, self._label(trend, vol)

    @staticmethod
    def _label(t: float | None, v: float | None) -> str:
        # Bounds and names of the regimes, first match first.
        if t is None:
            return "NEUTRAL"
        if t > 0.10 and v is not None and v < 0.05:
            return "BULL_STABLE"
        if t > 0.05:
            return "BULL_VOLATILE"
        if t < -0.10:
            return "BEAR"
        return "CONSOLIDATION" if abs(t) < 0.05 else "NEUTRAL"


class FoldScores:
    """series_id, fold, acc, mae, mse, days of the expanding folds of a series, as grouped.walk_forward over complete rows.

    All folds of a series are fitted in its partition's task, which holds the series
    (a row a day); walk_forward deals the folds out too.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, features: AnalyzeArgument, window: AnalyzeArgument, folds: AnalyzeArgument, least: AnalyzeArgument, rounds: AnalyzeArgument) -> AnalyzeResult:
        names = _constant(features, "features")
        for argument, name in ((window, "window"), (folds, "folds"), (least, "least"), (rounds, "rounds")):
            _constant(argument, name)
        return _output(table, ["series_id", "date", "ret", "log_close", *names], [("fold", IntegerType()), *[(c, DoubleType()) for c in ("acc", "mae", "mse")], ("days", LongType())])

    def __init__(self):
        self.rows, self.settings = [], None

    def eval(self, row: Row, features: list, window: int, folds: int, least: int, rounds: int) -> None:
        self.settings = (list(features), window, folds, least, rounds)
        values = [row[c] for c in ("date", "log_close", "ret", *features)]
        if not any(v is None or v != v for v in values):
            self.rows.append([row["series_id"], *values])

    def terminate(self) -> Iterator[tuple]:
        if self.rows:
            names, window, folds, least, rounds = self.settings
            pdf = pd.DataFrame(self.rows, columns=["series_id", "date", "log_close", "ret", *names])
            for fold, r in evaluated_folds(pdf, names, window, folds, least, rounds):
                yield self.rows[0][0], fold, float(r["acc"]), float(r["mae"]), float(r["mse"]), int(r["days"])


def register(spark: SparkSession) -> None:
    """Makes series_regime and fold_scores known to the session's SQL."""
    spark.udtf.register("series_regime", udtf(SeriesRegime))
    spark.udtf.register("fold_scores", udtf(FoldScores))
