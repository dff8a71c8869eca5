"""Table functions against the DataFrame forms."""

import datetime as dt

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark.functions import stats, tables
from tidemark.functions import windows as w
from tidemark.operators import grouped

LAGS = [w.Feature("lag", 1), w.Feature("mean", 7)]


def series(spark, name, closes):
    rows = [(name, dt.date(2021, 1, 1) + dt.timedelta(days=i), c, 1.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "series_id string, date date, close double, volume double")


@pytest.fixture(scope="module")
def prices(spark):
    tables.register(spark)
    rng = np.random.default_rng(5)
    walk = lambda drift, noise, n: (100 * np.exp(np.cumsum(drift + noise * rng.normal(size=n)))).tolist()
    parts = [("up", walk(0.01, 0.001, 60)), ("wild", walk(0.004, 0.08, 60)), ("down", walk(-0.01, 0.001, 60)), ("flat", walk(0, 0.0001, 60)), ("short", [1.0, 2.0]), ("one", [1.0]), ("gaps", [1.0, None, 0.0, 2.0] * 20), (None, walk(0.003, 0.001, 40))]
    out = series(spark, *parts[0])
    for name, closes in parts[1:]:
        out = out.unionByName(series(spark, name, closes))
    return out.withColumn("regime", F.lit("clash"))


def values(rows):
    return sorted(((str(r.series_id), *[None if v is None else round(v, 10) if isinstance(v, float) else v for v in r[1:]]) for r in rows), key=str)


@pytest.mark.parametrize("window", [2, 10, 30])
def test_regime_of_each_series(spark, prices, window):
    got = spark.sql(f"select * from series_regime(table(select * from {{p}}) partition by series_id order by (date), {window})", p=prices)
    want = stats.regime(prices.drop("regime"), window).drop("regime_emoji")
    assert got.columns == want.columns and got.schema["series_id"].dataType == want.schema["series_id"].dataType
    assert values(got.collect()) == values(want.collect())
    empty = spark.sql(f"select * from series_regime(table(select * from {{p}} where false) partition by series_id order by (date), {window})", p=prices)
    assert empty.count() == 0


def test_fold_scores_equal_the_walk_forward(spark):
    tables.register(spark)
    rng = np.random.default_rng(9)
    price = 100 * np.exp(np.cumsum(0.01 * rng.normal(size=260)))
    df = series(spark, "a", price.tolist()).unionByName(series(spark, "b", price[:200][::-1].tolist())).unionByName(series(spark, "short", price[:90].tolist()))
    want = grouped.walk_forward(df, LAGS, 20, 3, 100, 10).select("series_id", "fold", "acc", "mae", "mse", "days")
    names = ", ".join(f"'{f.name}'" for f in LAGS)
    got = spark.sql(f"select * from fold_scores(table(select * from {{r}}) partition by series_id order by (date), array({names}), 20, 3, 100, 10)", r=w.build(df, LAGS, drop=False))
    assert values(got.collect()) == values(want.collect()) and got.count() == 6


@pytest.mark.parametrize("call", ["series_regime(3, 30)", "series_regime(table(select 1 as series_id) partition by series_id, 30)", "series_regime(table(select * from {p}) partition by series_id order by (date), 1)", "fold_scores(table(select * from {p}) partition by series_id order by (date), array('lag_ret_9'), 20, 3, 100, 10)"])
def test_arguments_are_checked_in_analysis(spark, prices, call):
    with pytest.raises(AnalysisException):
        spark.sql(f"select * from {call}", p=prices)
