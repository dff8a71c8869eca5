"""Splits, folds, spines, candidate starts, and the joins between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import position, position_from_end

#: Steps of the candidate grid by their codes.
FREQUENCIES = {"D": "interval 1 day", "W": "interval 7 days", "MS": "interval 1 month", "QS": "interval 3 months", "YS": "interval 1 year"}


def split(df: DataFrame, test_rows: int) -> DataFrame:
    """df with is_test: the last test_rows rows of each series."""
    return df.withColumn("is_test", position_from_end() <= test_rows)


def spine(df: DataFrame, horizon: int = 0) -> DataFrame:
    """One row a day from each series' first to its last day and horizon days beyond."""
    span = df.groupBy("series_id").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    return span.select("series_id", F.explode(F.expr(f"sequence(lo, date_add(hi, {horizon}), interval 1 day)")).alias("date"))


def on_spine(df: DataFrame, horizon: int = 0) -> DataFrame:
    """df over every day, its columns filled forward."""
    frame = Window.partitionBy("series_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rest = [c for c in df.columns if c not in ("series_id", "date")]
    wide = spine(df, horizon).join(df, ["series_id", "date"], "left")
    return wide.withColumns({c: F.last(c, ignorenulls=True).over(frame) for c in rest})


def cutoff_grid(df: DataFrame, frequency: str = "MS", least_days: int = 730, most: int = 48) -> DataFrame:
    """series_id, pos, cutoff: candidate starts on a calendar grid and both ends, thinned evenly to `most`."""
    step = FREQUENCIES.get(frequency, FREQUENCIES["MS"])
    unit = {"MS": "month", "QS": "quarter", "YS": "year"}.get(frequency if frequency in FREQUENCIES else "MS")
    span = df.groupBy("series_id").agg(F.min("date").alias("lo"), F.date_sub(F.max("date"), least_days).alias("hi")).where("hi > lo")
    first = F.expr(f"case when trunc(lo, '{unit}') = lo then lo else add_months(trunc(lo, '{unit}'), {dict(month=1, quarter=3, year=12)[unit]}) end") if unit else F.col("lo")
    grid = span.withColumn("first", first).select("series_id", "lo", "hi", F.expr(f"case when first <= hi then sequence(first, hi, {step}) else array() end").alias("g"))
    days = grid.select("series_id", F.explode(F.array_distinct(F.concat("g", F.array("lo", "hi")))).alias("cutoff"))
    by = Window.partitionBy("series_id")
    ranked = days.withColumns({"i": F.row_number().over(by.orderBy("cutoff")).cast("long") - 1, "n": F.count("*").over(by)})
    chosen = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda j: F.floor(j * (F.col("n") - 1) / (most - 1))))
    kept = ranked.where((F.col("n") <= most) | F.array_contains(chosen, F.col("i")))
    return kept.select("series_id", (F.row_number().over(by.orderBy("cutoff")).cast("long") - 1).alias("pos"), "cutoff")


def integer_steps(lo: int, hi: int, k: int) -> list[int]:
    """k evenly spaced integers from lo to hi, cut toward zero."""
    return [lo] if k == 1 else [lo + i * (hi - lo) // (k - 1) for i in range(k)]


def fold_ends(n: int, window: int, folds: int, least: int) -> list[int]:
    """Sorted distinct sizes of the training part of each fold."""
    return sorted(set(integer_steps(least, n - window, folds))) if n - window > least else []


def folds(df: DataFrame, window: int = 90, n_folds: int = 4, least: int = 730) -> DataFrame:
    """Rows of every fold: fold, train_end, is_test; training grows, tests are the next window rows."""
    rows = df.withColumn("rn", position())
    sizes = rows.groupBy("series_id").agg(F.count("*").alias("n")).where(F.col("n") - window > least)
    step = F.transform(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda i: F.lit(least) + F.floor(i * (F.col("n") - window - least) / max(1, n_folds - 1)))
    ends = sizes.select("series_id", F.posexplode(F.array_sort(F.array_distinct(step))).alias("fold", "train_end"))
    joined = rows.join(ends, "series_id")
    return joined.where(F.col("rn") <= F.col("train_end") + window).withColumn("is_test", F.col("rn") > F.col("train_end"))


def expanding_cv(n: int, k: int) -> list[tuple[int, int]]:
    """(train size, test end) of an expanding split in k folds whose tests have n // (k + 1) rows at the tail."""
    size = n // (k + 1)
    return [(n - (k - i) * size, n - (k - i - 1) * size) for i in range(k)]


def after_each(df: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Every row with every candidate start of its series that isn't later."""
    return df.join(cutoffs, "series_id").where(F.col("date") >= F.col("cutoff"))


def latest(df: DataFrame, k: int = 1) -> DataFrame:
    """The k-th row of each series from the end, or its first if it is shorter."""
    by = Window.partitionBy("series_id")
    return df.withColumns({"_r": position_from_end(), "_n": F.count("*").over(by)}).where(F.col("_r") == F.least(F.lit(k), F.col("_n"))).drop("_r", "_n")


def kth(df: DataFrame, k: int) -> DataFrame:
    """The k-th row of each series, or its last if it is shorter."""
    by = Window.partitionBy("series_id")
    return df.withColumns({"_r": position(), "_n": F.count("*").over(by)}).where(F.col("_r") == F.least(F.lit(k), F.col("_n"))).drop("_r", "_n")


def prefix(df: DataFrame, fraction: float) -> DataFrame:
    """The first rows of each series, as many as the fraction cut down to a whole number."""
    by = Window.partitionBy("series_id")
    return df.withColumns({"_r": position(), "_n": F.count("*").over(by)}).where(F.col("_r") <= F.floor(fraction * F.col("_n"))).drop("_r", "_n")
