"""The price source: headers of any order, planning from names, predicates taken over."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, Not

from tidemark.sources import tickers

D = datetime.date


def put(folder, ticker, year, text, name="a.csv"):
    at = folder / f"ticker={ticker}" / (f"year={year}" if year else "")
    at.mkdir(parents=True, exist_ok=True)
    (at / name).write_bytes(text.encode())


@pytest.fixture
def odd(tmp_path):
    """Files whose headers differ, and some with little in them."""
    put(tmp_path, "BTC-USD", 2020, "Date,Open,Close,Volume\n2020-01-01,1,2.5,10\n2020-12-31,1,3e2,\n2020-12-31,1,3e2,\n")
    put(tmp_path, "BTC-USD", 2021, '﻿Volume,"Adj, Close",date,Extra\n7,4,2021-01-01 00:00:00+00:00,x\n8,n/a,2021-01-02,y\n')
    put(tmp_path, "A%2FB", None, "DATE,CLOSE\n2019-05-05,1\nnonsense,2\n")
    put(tmp_path, "__HIVE_DEFAULT_PARTITION__", 2020, "date,close,volume\n2020-02-02,5,6\n")
    put(tmp_path, "EMPTY", 2020, "")
    put(tmp_path, "EMPTY", 2021, "date,close\n")
    put(tmp_path, "EMPTY", 2021, "no csv", "_SUCCESS")
    return tmp_path


ROWS = [
    ("BTC-USD", D(2020, 1, 1), 2.5, 10.0), ("BTC-USD", D(2020, 12, 31), 300.0, None), ("BTC-USD", D(2020, 12, 31), 300.0, None),
    ("BTC-USD", D(2021, 1, 1), 4.0, 7.0), ("BTC-USD", D(2021, 1, 2), None, 8.0),
    ("A/B", D(2019, 5, 5), 1.0, 0.0), ("A/B", None, 2.0, 0.0), (None, D(2020, 2, 2), 5.0, 6.0),
]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_headers_of_any_kind(spark, odd):
    assert rows(tickers.read(spark, str(odd))) == sorted(ROWS, key=str)


def test_predicates_as_by_spark(spark, odd):
    draw = random.Random(3)
    days = ["2019-05-05", "2020-01-01", "2020-06-01", "2020-12-31", "2021-01-01", "2022-01-01"]
    tests = ["series_id = 'A/B'", "series_id in ('A/B', 'EMPTY')", "series_id in ('BTC-USD', null)", "series_id is null", "date is null", "close > 3", "series_id <=> null", "series_id > 'A'", "not (series_id = 'A/B')"]
    tests += [f"date {op} date '{d}'" for op in ("=", "<", "<=", ">", ">=", "<>") for d in draw.sample(days, 2)]
    plain = spark.createDataFrame(ROWS, tickers.SCHEMA)
    for _ in range(12):
        where = " and ".join(draw.sample(tests, draw.choice([1, 2])))
        assert rows(tickers.read(spark, str(odd), where)) == rows(plain.where(where)), where


def test_skipped_files_are_counted_and_not_opened(spark, odd):
    def reader(*filters):
        r = tickers.FilteredPriceReader(str(odd), False)
        assert not list(r.pushFilters(list(filters)))
        return r

    assert len(reader().chosen()) == 6
    assert [f.year for f in reader(EqualTo(("series_id",), "BTC-USD")).chosen()] == [2020, 2021]
    assert [f.year for f in reader(EqualTo(("series_id",), "BTC-USD"), GreaterThan(("date",), D(2020, 12, 31))).chosen()] == [2021]
    # a name without a year may hold any date
    assert [f.ticker for f in reader(LessThanOrEqual(("date",), D(2019, 12, 31))).chosen()] == ["A/B"]
    assert reader(In(("date",), (D(1990, 1, 1),)), EqualTo(("series_id",), "EMPTY")).partitions()[0].files == []
    r = tickers.FilteredPriceReader(str(odd), False)
    assert len(list(r.pushFilters([Not(EqualTo(("series_id",), "x")), EqualTo(("close",), 1.0)]))) == 2
    # a file that can't be read spoils only reads that need it
    put(odd, "BAD", 2020, "nothing,here\n1,2\n")
    with pytest.raises(Exception, match="no date column"):
        tickers.read(spark, str(odd)).collect()
    assert tickers.read(spark, str(odd), "series_id = 'BTC-USD'").count() == 5
    assert tickers.read(spark, str(odd), "date > date '2020-12-31'").count() == 2


def test_round_trip_and_partitions(spark, sf, tmp_path, monkeypatch):
    from tidemark.plans import catalog

    prices = catalog.each(spark, sf)
    tickers.write(prices, str(tmp_path / "p"))
    back = tickers.read(spark, str(tmp_path / "p"))
    assert rows(back) == rows(prices) and back.count() > 0
    files = tickers.listed(str(tmp_path / "p"))
    assert len({(f.ticker, f.year) for f in files}) == len(files) == prices.select("series_id", F.year("date")).distinct().count()
    monkeypatch.setattr(tickers, "PART_BYTES", 2 * tickers.OPEN_BYTES)
    parts = tickers.PriceReader(str(tmp_path / "p"), False).partitions()
    assert len(parts) == len(files) and sorted(f.path for p in parts for f in p.files) == sorted(f.path for f in files)


def test_nothing_there(spark, tmp_path):
    assert tickers.read(spark, str(tmp_path / "none")).count() == 0
    assert tickers.read(spark, str(tmp_path), "series_id = 'x'").count() == 0
    put(tmp_path, "x", 2020, "date,open\n")
    with pytest.raises(Exception, match="no close column"):
        tickers.read(spark, str(tmp_path)).count()


def test_adjusted_prices(spark, tmp_path):
    put(tmp_path, "x", 2020, "Date,Adj Price,Close\n2020-01-01,1,2\n")
    assert rows(tickers.read(spark, str(tmp_path))) == [("x", D(2020, 1, 1), 2.0, 0.0)]
    assert rows(tickers.read(spark, str(tmp_path), adjusted=True)) == [("x", D(2020, 1, 1), 1.0, 0.0)]
