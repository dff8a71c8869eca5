"""Registered queries of the library, each with its DuckDB twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import stats, tables
from tidemark.functions import windows as w
from tidemark.operators import boosting, frames, grouped, montecarlo, search, selection
from tidemark.operators.models import FOLD_ROUNDS, BoostedTrees
from tidemark.plans import forecast
from tidemark.sources import series as src
from tidemark.sources import tickers
from tidemark.streaming import running

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

_BY = "o_orderpriority"
_ALL = "p as (select 'all' as series_id, cast(o_orderdate as date) as date, arg_max(o_totalprice, o_orderkey) as close, cast(count(*) as double) as volume from orders group by 2)"
_EACH = f"p as (select {_BY} as series_id, cast(o_orderdate as date) as date, arg_max(o_totalprice, o_orderkey) as close, cast(count(*) as double) as volume from orders group by 1, 2)"
_FLOW = "f as (select cast(l_shipdate as date) as date, cast(sum(l_quantity) as double) as qty from lineitem group by 1)"
_W = "over (partition by series_id order by date)"
_RET = f"r as (select *, close / lag(close) {_W} - 1 as ret from p)"


def _frame(n: int) -> str:
    return f"over (partition by series_id order by date rows between {n - 1} preceding and current row)"


def _rolling(fn: str, x: str, n: int) -> str:
    return f"case when count({x}) {_frame(n)} = {n} then {fn}({x}) {_frame(n)} end"


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def each(spark: SparkSession, d: str) -> DataFrame:
    return src.prices(spark, d, _BY)


def whole(spark: SparkSession, d: str) -> DataFrame:
    return src.prices(spark, d)


def _r(x: Column | str, n: int, name: str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, n).alias(name)


# ---- scans and projections


@query(f"with {_EACH} select * from p")
def scan_daily_prices(spark, d):
    return each(spark, d)


@query("select cast(l_shipdate as date) as date, cast(sum(l_quantity) as double) as close, cast(count(*) as double) as volume from lineitem group by 1")
def scan_daily_flow(spark, d):
    return src.flow(spark, d).select("date", "close", "volume")


@query("select event_type as series_id, date_trunc('hour', ts) as date, round(arg_max(value, event_id), 6) as close, cast(count(*) as double) as volume from events group by 1, 2")
def scan_hourly_events(spark, d):
    return src.hourly(spark, d).select("series_id", "date", _r("close", 6, "close"), "volume")


@query("select event_type, count(*) as n, count(props) as n_props, cast(sum(length(props)) as bigint) as size from events where json_valid(props) group by 1")
def scan_json_props(spark, d):
    e = src.table(spark, d, "events").where(F.from_json("props", "map<string,string>").isNotNull())
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count("props").alias("n_props"), F.sum(F.length("props")).alias("size"))


@query("with t as (select cast(o_orderdate as date) as date, o_totalprice as c, cast(o_custkey as double) as v from orders) select 'all' as series_id, date, c as close, v as volume from t")
def project_rename(spark, d):
    raw = src.table(spark, d, "orders").select("o_orderdate", "o_totalprice", "o_custkey").toDF(*src.flat_names(["date", ("Close", "ORD"), ("Volume", "ORD")]))
    return src.normalise(raw)


@query("select 'all' as series_id, cast(o_orderdate as date) as date, o_totalprice as close, cast(0 as double) as volume from orders")
def constant_volume(spark, d):
    raw = src.table(spark, d, "orders").select(F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("Adj Price"))
    return src.normalise(raw, adjusted=True)


@query(f"with {_EACH} select * from p where date >= date '1997-01-01'")
def filter_cutoff(spark, d):
    return each(spark, d).where("date >= date '1997-01-01'")


@query(f"with {_EACH} select * from p where series_id in ('1-URGENT', '5-LOW') and date >= date '1995-06-15' and date < date '1997-03-01'")
def ticker_files(spark, d):
    """Two tickers over some years, out of a folder of price files by ticker and year."""
    path = tickers.new_folder(spark)
    tickers.write(each(spark, d), path)
    return tickers.read(spark, path, "series_id in ('1-URGENT', '5-LOW') and date >= date '1995-06-15' and date < date '1997-03-01'")


@query(f"with {_EACH}, {_RET} select series_id, date, round(ret, 8) as ret, round(ln(close), 8) as log_close from r where ret is not null")
def dropna_complete(spark, d):
    return w.with_returns(each(spark, d)).na.drop("any").select("series_id", "date", _r("ret", 8, "ret"), _r("log_close", 8, "log_close"))


@query(f"with {_EACH}, n as (select *, row_number() over (partition by series_id order by date desc) as k from p) select series_id, count(*) filter (where k > 90) as n_train, count(*) filter (where k <= 90) as n_test, min(date) filter (where k <= 90) as first_test from n group by 1")
def split_train_test(spark, d):
    s = frames.split(each(spark, d), 90)
    return s.groupBy("series_id").agg(F.count_if(~F.col("is_test")).alias("n_train"), F.count_if("is_test").alias("n_test"), F.min(F.when(F.col("is_test"), F.col("date"))).alias("first_test"))


@query(f"with {_ALL} select date, close from p order by date desc limit 365")
def head_tail(spark, d):
    return src.tail(whole(spark, d)).select("date", "close")


@query(f"with {_EACH} select series_id, min(date) as first_date, arg_min(close, date) as first_close, max(date) as last_date, arg_max(close, date) as last_close from p group by 1")
def first_last_row(spark, d):
    return each(spark, d).groupBy("series_id").agg(F.min("date").alias("first_date"), F.min_by("close", "date").alias("first_close"), F.max("date").alias("last_date"), F.max_by("close", "date").alias("last_close"))


@query(f"with {_EACH}, n as (select *, row_number() {_W} as k, count(*) over (partition by series_id) as c from p) select series_id, date, close from n where k = least(30, c)")
def kth_row_clamped(spark, d):
    return frames.kth(each(spark, d), 30).select("series_id", "date", "close")


@query(f"with {_EACH}, n as (select *, row_number() {_W} as k, count(*) over (partition by series_id) as c from p) select series_id, count(*) as n, max(date) as last_date from n where k <= floor(0.4 * c) group by 1")
def learning_prefix(spark, d):
    return frames.prefix(each(spark, d), 0.4).groupBy("series_id").agg(F.count("*").alias("n"), F.max("date").alias("last_date"))


@query(f"with {_EACH} select series_id, count(*) as n from p group by 1 having count(*) >= 120")
def size_guard(spark, d):
    return each(spark, d).groupBy("series_id").agg(F.count("*").alias("n")).where("n >= 120")


# ---- windows


@query(f"with {_EACH}, {_RET} select series_id, date, round(ret, 8) as ret from r")
def return_pct(spark, d):
    return each(spark, d).select("series_id", "date", _r(w.simple_return(), 8, "ret"))


@query(f"with {_EACH}, {_RET} select series_id, date, " + ", ".join(f"round(lag(ret, {k}) {_W}, 8) as lag_ret_{k}" for k in (1, 2, 7)) + " from r")
def lag_features(spark, d):
    return w.build(each(spark, d), [w.Feature("lag", k) for k in (1, 2, 7)], drop=False).select("series_id", "date", *[_r(f"lag_ret_{k}", 8, f"lag_ret_{k}") for k in (1, 2, 7)])


@query(f"with {_EACH}, {_RET} select series_id, date, round(lead(ret) {_W}, 8) as next_ret from r")
def lead_target(spark, d):
    return w.with_returns(each(spark, d)).select("series_id", "date", _r(F.lead("ret", 1).over(w.order()), 8, "next_ret"))


def _feature(name, kind, n, fn, x, places):
    @query(f"with {_EACH}, {_RET} select series_id, date, round({_rolling(fn, x, n)}, {places}) as {w.Feature(kind, n).name} from r")
    def run(spark, d):
        f = w.Feature(kind, n)
        return w.build(each(spark, d), [f], drop=False).select("series_id", "date", _r(f.name, places, f.name))

    run.__name__ = name
    _QUERIES[name], _SQL[name] = _QUERIES.pop("run"), _SQL.pop("run")


_feature("roll_mean", "mean", 7, "avg", "ret", 6)
_feature("roll_std", "std", 7, "stddev_samp", "ret", 6)
_feature("roll_vol", "vol", 14, "avg", "volume", 6)
_feature("sma", "sma", 14, "avg", "close", 4)


@query(f"with recursive {_EACH}, n as (select *, row_number() {_W} as k from p), e as (select series_id, date, k, close as v from n where k = 1 union all select n.series_id, n.date, n.k, 0.25 * n.close + 0.75 * e.v from e join n on n.series_id = e.series_id and n.k = e.k + 1) select series_id, date, round(v, 4) as ema_7 from e")
def ema(spark, d):
    return w.exponential(each(spark, d), [7]).select("series_id", "date", _r("ema_7", 4, "ema_7"))


@query(f"with {_EACH} select series_id, date, round((" + " + ".join(f"coalesce(lag(close, {i}) {_W}, 0) * {0.5**i}" for i in range(3)) + ") / (" + " + ".join(f"case when lag(close, {i}) {_W} is null then 0 else {0.5**i} end" for i in range(3)) + "), 4) as ema_3 from p")
def ema_adjusted_tail(spark, d):
    return each(spark, d).select("series_id", "date", _r(w.adjusted_tail_average("close", 3), 4, "ema_3"))


@query(f"with {_EACH}, x as (select *, close - lag(close) {_W} as d from p) select series_id, count(*) filter (where d > 0) as up, count(*) filter (where d <= 0) as down from x group by 1")
def diff_direction(spark, d):
    x = each(spark, d).withColumn("d", w.difference("close"))
    return x.groupBy("series_id").agg(F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") <= 0).alias("down"))


_SPINE = "b as (select series_id, min(date) as lo, max(date) as hi from p group by 1), s as (select series_id, cast(unnest(generate_series(lo::timestamp, hi::timestamp, interval 1 day)) as date) as date from b)"


@query(f"with {_EACH}, {_SPINE}, j as (select s.series_id, s.date, p.close from s left join p on s.series_id = p.series_id and s.date = p.date) select series_id, date, last_value(close ignore nulls) over (partition by series_id order by date rows between unbounded preceding and current row) as close from j")
def ffill_spine(spark, d):
    return frames.on_spine(each(spark, d)).select("series_id", "date", "close")


@query(f"with {_EACH}, x as (select *, avg(volume) over (partition by series_id order by date rows between unbounded preceding and current row) as a from p) select series_id, date, round(a, 6) as mean_volume from x")
def expanding_train(spark, d):
    return each(spark, d).select("series_id", "date", _r(F.avg("volume").over(w.order().rowsBetween(Window.unboundedPreceding, 0)), 6, "mean_volume"))


@query(f"with {_EACH} select series_id, date, row_number() {_W} as position from p")
def row_position(spark, d):
    return each(spark, d).select("series_id", "date", w.position().alias("position"))


# ---- joins


@query(f"with {_ALL}, {_FLOW} select p.date, close, qty from p join f on p.date = f.date")
def inner_align(spark, d):
    return whole(spark, d).join(src.flow(spark, d).select("date", F.col("close").alias("qty")), "date").select("date", "close", "qty")


@query(f"with {_EACH}, {_SPINE} select s.series_id, count(*) as days, count(p.date) as present from s left join p on s.series_id = p.series_id and s.date = p.date group by 1")
def left_spine_join(spark, d):
    p = each(spark, d)
    return frames.spine(p).join(p, ["series_id", "date"], "left").groupBy("series_id").agg(F.count("*").alias("days"), F.count("close").alias("present"))


@query(f"with {_ALL}, {_FLOW} select date, close from p where date in (select date from f)")
def semi_subset(spark, d):
    return whole(spark, d).join(src.flow(spark, d), "date", "left_semi").select("date", "close")


@query(f"with {_ALL}, {_FLOW}, m as (select max(qty) as top from f) select p.date, coalesce(f.qty, m.top) as qty from p left join f on p.date = f.date cross join m")
def lookup_fallback(spark, d):
    f = src.flow(spark, d).select("date", F.col("close").alias("qty"))
    return whole(spark, d).join(f, "date", "left").crossJoin(F.broadcast(f.agg(F.max("qty").alias("top")))).select("date", F.coalesce("qty", "top").alias("qty"))


@query(f"with {_ALL}, t as (select date, close from p order by date desc limit 30) select date, count(*) as runs, cast(sum(run) as bigint) as total from t cross join range(200) r(run) group by 1")
def cross_runs(spark, d):
    path = src.tail(whole(spark, d), 30).select("date", F.lit(0).alias("h"))
    return montecarlo.runs(path, 200).groupBy("date").agg(F.count("*").alias("runs"), F.sum("run").alias("total"))


_GRID = """b as (select series_id, min(date) as lo, cast(max(date) - interval 730 day as date) as hi from p group by 1 having cast(max(date) - interval 730 day as date) > min(date)),
g as (select series_id, cast(unnest(generate_series(case when date_trunc('month', lo) = lo then lo::timestamp else date_trunc('month', lo)::timestamp + interval 1 month end, hi::timestamp, interval 1 month)) as date) as cutoff from b union select series_id, lo from b union select series_id, hi from b),
k as (select *, row_number() over (partition by series_id order by cutoff) - 1 as i, count(*) over (partition by series_id) as n from g),
c as (select series_id, row_number() over (partition by series_id order by cutoff) - 1 as pos, cutoff from k where n <= 48 or i in (select cast(floor(j * (n - 1) / 47) as bigint) from range(48) t(j)))"""


@query(f"with {_EACH}, {_GRID} select series_id, pos, cutoff from c")
def cutoff_grid(spark, d):
    return frames.cutoff_grid(each(spark, d))


@query(f"with {_EACH}, {_GRID} select c.series_id, pos, cutoff, count(*) as days, max(close) as top from c join p on p.series_id = c.series_id and p.date >= c.cutoff group by 1, 2, 3")
def theta_cutoffs(spark, d):
    p = each(spark, d)
    return frames.after_each(p, frames.cutoff_grid(p)).groupBy("series_id", "pos", "cutoff").agg(F.count("*").alias("days"), F.max("close").alias("top"))


_FOLDS = "n as (select *, row_number() over (partition by series_id order by date) as rn, count(*) over (partition by series_id) as c from p), e as (select series_id, cast(100 + floor(i * (max(c) - 30 - 100) / 3) as bigint) as train_end from n cross join range(4) t(i) where c - 30 > 100 group by series_id, i), o as (select series_id, train_end, row_number() over (partition by series_id order by train_end) - 1 as fold from (select distinct * from e))"


@query(f"with {_EACH}, {_FOLDS} select o.series_id, fold, train_end, count(*) filter (where rn <= train_end) as n_train, count(*) filter (where rn > train_end) as n_test, max(date) as last_date from o join n on n.series_id = o.series_id and rn <= train_end + 30 group by 1, 2, 3")
def fold_expansion(spark, d):
    f = frames.folds(each(spark, d), 30, 4, 100)
    return f.groupBy("series_id", F.col("fold").cast("long").alias("fold"), F.col("train_end").cast("long").alias("train_end")).agg(F.count_if(~F.col("is_test")).alias("n_train"), F.count_if("is_test").alias("n_test"), F.max("date").alias("last_date"))


# ---- aggregates and statistics


@query(f"with {_EACH} select series_id, min(date) as lo, max(date) as hi, count(*) as n, count(distinct volume) as n_volumes from p group by 1")
def agg_minmax_count(spark, d):
    return each(spark, d).groupBy("series_id").agg(F.min("date").alias("lo"), F.max("date").alias("hi"), F.count("*").alias("n"), F.countDistinct("volume").alias("n_volumes"))


@query(f"with {_EACH}, x as (select series_id, volume, {_rolling('avg', 'volume', 7)} as guess from p) select series_id, round(avg((volume - guess) * (volume - guess)), 6) as mse, round(avg(abs(volume - guess)), 6) as mae from x where guess is not null group by 1")
def mse_mae(spark, d):
    x = each(spark, d).withColumn("guess", w.rolling(F.avg, "volume", 7)).where("guess is not null")
    return stats.errors(x, "volume", "guess").select("series_id", _r("mse", 6, "mse"), _r("mae", 6, "mae"))


@query(f"with {_EACH}, {_RET}, x as (select series_id, {_rolling('avg', 'ret', 7)} as m, lead(ret) {_W} as nxt from r) select series_id, round(corr(m, nxt), 6) as corr from x where m is not null and nxt is not null group by 1")
def corr_next_return(spark, d):
    x = w.with_returns(each(spark, d)).withColumns({"m": w.rolling(F.avg, "ret", 7), "nxt": F.lead("ret", 1).over(w.order())})
    return x.groupBy("series_id").agg(_r(stats.safe_corr("m", "nxt"), 6, "corr"))


@query(f"with {_EACH} select series_id, round(quantile_cont(close, 0.025), 4) as low, round(quantile_cont(close, 0.975), 4) as high from p group by 1")
def percentile_ci(spark, d):
    q = each(spark, d).groupBy("series_id").agg(F.percentile("close", [0.025, 0.975]).alias("q"))
    return q.select("series_id", _r(F.col("q")[0], 4, "low"), _r(F.col("q")[1], 4, "high"))


@query(f"with {_EACH} select series_id, round(avg(volume), 6) as mean, round(stddev_samp(volume), 6) as sd, round(stddev_pop(volume), 6) as sd_pop from p group by 1")
def stddev_pop_samp(spark, d):
    return each(spark, d).groupBy("series_id").agg(_r(F.avg("volume"), 6, "mean"), _r(F.stddev_samp("volume"), 6, "sd"), _r(F.stddev_pop("volume"), 6, "sd_pop"))


_YEARS = f"y as (select year(date) as pos, avg(volume) / 100 as acc, stddev_samp(volume) as mae, cast(count(*) as double) as days from p group by 1)"


def _yearly(spark, d):
    return whole(spark, d).groupBy(F.year("date").cast("long").alias("pos")).agg((F.avg("volume") / 100).alias("acc"), F.stddev_samp("volume").alias("mae"), F.count("*").cast("double").alias("days"))


@query(f"with {_ALL}, {_YEARS} select cast(pos as bigint) as pos, round(0.6 * acc + 0.2 * (1 - mae / max(mae) over ()) + 0.2 * days / max(days) over (), 8) as score from y")
def max_normalised_score(spark, d):
    return selection.weighted_score(_yearly(spark, d)).select("pos", _r("score", 8, "score"))


@query(f"with {_ALL}, {_YEARS} select cast(pos as bigint) as pos, days from y order by days desc, pos limit 1")
def argmax_cutoff(spark, d):
    return selection.first_best(_yearly(spark, d), "days", "pos").select("pos", "days")


@query(f"with {_ALL}, {_YEARS}, e as (select pos, acc, exp((acc - max(acc) over ()) / 2.0) as v from y) select cast(pos as bigint) as pos, round(v / sum(v) over (), 8) as posterior from e")
def softmax_posterior(spark, d):
    return stats.posterior(_yearly(spark, d), 2.0).select("pos", _r("posterior", 8, "posterior"))


@query(f"with {_EACH}, x as (select *, avg(close) {_frame(3)} as g from p), y as (select series_id, close - lag(close) {_W} as t, g - lag(g) {_W} as u from x) select series_id, cast(sum(case when (t > 0) = (u > 0) then 1 else 0 end) as bigint) as hits, count(*) as n from y where t is not null and u is not null group by 1")
def direction_accuracy(spark, d):
    x = each(spark, d).withColumn("g", F.avg("close").over(w.order().rowsBetween(-2, 0)))
    return stats.direction_accuracy(x, "close", "g").select("series_id", "hits", "n")


def _score_sql(n: int) -> str:
    return f"(select series_id, cast({n} as bigint) as n, coalesce(abs(corr({{x}}_{n}, nxt)), 0) as s from x where {{x}}_{n} is not null and nxt is not null group by 1)"


_TOP = "select series_id, rank, n, round(score, 6) as score from (select *, row_number() over (partition by series_id order by score desc, n) as rank from t) where rank <= 3"


@query(
    f"with {_EACH}, {_RET}, x as (select series_id, lead(ret) {_W} as nxt, " + ", ".join(f"{_rolling(f, c, n)} as {k}_{n}" for n in selection.ROLLING for k, f, c in (("m", "avg", "ret"), ("s", "stddev_samp", "ret"), ("v", "avg", "volume"))) + " from r), u as (" + " union all ".join(_score_sql(n).format(x=k) for n in selection.ROLLING for k in "msv") + f"), t as (select series_id, n, sum(s) / 3 as score from u group by 1, 2) {_TOP}"
)
def topk_windows(spark, d):
    return selection.top(selection.score_windows(each(spark, d))).select("series_id", "rank", "n", _r("score", 6, "score"))


@query(f"with {_EACH}, {_RET}, x as (select series_id, lead(ret) {_W} as nxt, " + ", ".join(f"{_rolling('avg', 'close', n)} as a_{n}" for n in selection.AVERAGES) + " from r), u as (" + " union all ".join(_score_sql(n).format(x="a") for n in selection.AVERAGES) + f"), t as (select series_id, n, s as score from u) {_TOP}")
def topk_sma(spark, d):
    return selection.top(selection.score_averages(each(spark, d))).select("series_id", "rank", "n", _r("score", 6, "score"))


@query(f"with recursive {_EACH}, {_RET}, b as (select *, row_number() {_W} as k from r), e as (select series_id, k, " + ", ".join(f"close as a_{n}" for n in selection.AVERAGES) + " from b where k = 1 union all select b.series_id, b.k, " + ", ".join(f"e.a_{n} + {2 / (n + 1)} * (b.close - e.a_{n})" for n in selection.AVERAGES) + f" from e join b on b.series_id = e.series_id and b.k = e.k + 1), y as (select series_id, k, lead(ret) {_W} as nxt from b), x as (select e.*, y.nxt from e join y on y.series_id = e.series_id and y.k = e.k), u as (" + " union all ".join(_score_sql(n).format(x="a") for n in selection.AVERAGES) + f"), t as (select series_id, n, s as score from u) {_TOP}")
def topk_ema(spark, d):
    return selection.top(selection.score_averages(each(spark, d), "ema")).select("series_id", "rank", "n", _r("score", 6, "score"))


@query(f"with {_ALL} select cast(date_trunc('month', date) as date) as date from p union select min(date) from p union select max(date) from p")
def union_grid(spark, d):
    p = whole(spark, d)
    ends = p.agg(F.array(F.min("date"), F.max("date")).alias("e")).select(F.explode("e").alias("date"))
    return p.select(F.trunc("date", "month").alias("date")).union(ends).distinct()


@query(f"with {_ALL}, b as (select min(date) as lo, max(date) as hi from p) select cast(unnest(generate_series(date_trunc('month', lo)::timestamp, hi::timestamp, interval 1 month)) as date) as date from b")
def month_starts(spark, d):
    return whole(spark, d).agg(F.min("date").alias("lo"), F.max("date").alias("hi")).select(F.explode(F.expr("sequence(trunc(lo, 'month'), hi, interval 1 month)")).alias("date"))


@query(f"with {_EACH}, c as (select series_id, count(*) as n from p group by 1) select series_id, i as step, 10 + (i * (n - 10)) // 4 as rows from c cross join range(5) t(i)")
def linspace_folds(spark, d):
    n = each(spark, d).groupBy("series_id").agg(F.count("*").alias("n"))
    return n.select("series_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("step"), "n").select("series_id", "step", F.expr("10 + (step * (n - 10)) div 4").alias("rows"))


@query(f"with {_EACH}, l as (select series_id, arg_max(close, date) as last, stddev_samp(close) as sd from p group by 1) select p.series_id, date, round(1 / (1 + exp(-(close - last) / (sd + 1e-9))), 8) as prob_up from p join l on p.series_id = l.series_id")
def logistic_prob_up(spark, d):
    p = each(spark, d)
    last = p.groupBy("series_id").agg(F.max_by("close", "date").alias("last"), F.stddev_samp("close").alias("sd"))
    return p.join(last, "series_id").select("series_id", "date", _r(stats.logistic(F.col("close"), F.col("last"), F.col("sd")), 8, "prob_up"))


_LF = "(select coalesce(sum(ln(cast(z as double))), 0) from range(1, {} + 1) t(z))"


@query(f"with {_EACH}, x as (select series_id, close - lag(close) {_W} as d, row_number() over (partition by series_id order by date desc) as k from p), h as (select series_id, cast(count(*) filter (where d > 0) as bigint) as hits, cast(count(*) as bigint) as n from x where k <= 40 and d is not null group by 1), lf as (select m, (select coalesce(sum(ln(cast(z as double))), 0) from range(1, 41) t(z) where z <= m) as v from range(0, 41) u(m)), t as (select series_id, hits, n, sum(exp(a.v - b.v - c.v + n * ln(0.5))) as p_value from h join lf a on a.m = n join lf b on b.m >= hits and b.m <= n join lf c on c.m = n - b.m group by 1, 2, 3) select series_id, hits, n, round(least(p_value, 1), 8) as p_value from t")
def binomial_tail(spark, d):
    x = each(spark, d).withColumns({"d": w.difference("close"), "k": w.position_from_end()}).where("k <= 40 and d is not null")
    h = x.groupBy("series_id").agg(F.count_if(F.col("d") > 0).alias("hits"), F.count("*").alias("n"))
    return h.select("series_id", "hits", "n", _r(stats.binomial_at_least(F.col("hits"), F.col("n")), 8, "p_value"))


_REGIME = f"with {_EACH}, {_RET}, x as (select series_id, close / lag(close, 29) {_W} - 1 as trend, stddev_samp(ret) {_frame(30)} as vol, row_number() over (partition by series_id order by date desc) as k from r) select series_id, round(trend, 6) as trend, round(vol, 6) as vol, case when trend > 0.10 and vol < 0.05 then 'BULL_STABLE' when trend > 0.05 then 'BULL_VOLATILE' when trend < -0.10 then 'BEAR' when abs(trend) < 0.05 then 'CONSOLIDATION' else 'NEUTRAL' end as regime from x where k = 1"


@query(_REGIME)
def regime_case(spark, d):
    return stats.regime(each(spark, d)).select("series_id", _r("trend", 6, "trend"), _r("vol", 6, "vol"), "regime")


@query(_REGIME)
def regime_table(spark, d):
    """The same by a table function that SQL calls."""
    tables.register(spark)
    return spark.sql("select series_id, round(trend, 6) as trend, round(vol, 6) as vol, regime from series_regime(table(select * from {p}) partition by series_id order by (date), 30)", p=each(spark, d))


_ACF = f"x as (select series_id, date, volume - avg(volume) over (partition by series_id) as d from p), l as (select series_id, d, " + ", ".join(f"lag(d, {k}) {_W} as l{k}" for k in range(1, 4)) + " from x), a as (select series_id, count(*) as n, sum(d * d) / count(*) as c0, " + ", ".join(f"sum(d * l{k}) / (count(*) - {k}) as c{k}" for k in range(1, 4)) + " from l group by 1), q as (select series_id, n, c1 / c0 as r1, c2 / c0 as r2, c3 / c0 as r3 from a)"


@query(f"with {_EACH}, {_ACF} select series_id, cast(k as bigint) as lag, round(case k when 0 then 1.0 when 1 then r1 when 2 then r2 else r3 end, 6) as acf from q cross join range(4) t(k)")
def acf(spark, d):
    return stats.autocorrelations(each(spark, d), "volume", 3).select("series_id", "lag", _r("acf", 6, "acf"))


@query(f"with {_EACH}, {_ACF}, f as (select *, (r2 - r1 * r1) / (1 - r1 * r1) as f2 from q), h as (select *, r1 * (1 - f2) as g1 from f) select series_id, cast(k as bigint) as lag, round(case k when 0 then 1.0 when 1 then r1 when 2 then f2 else (r3 - g1 * r2 - f2 * r1) / (1 - g1 * r1 - f2 * r2) end, 6) as pacf from h cross join range(4) t(k)")
def pacf(spark, d):
    return stats.partial_autocorrelations(each(spark, d), "volume", 3).select("series_id", "lag", _r("pacf", 6, "pacf"))


_LAGS = 30


@query(f"with recursive {_EACH}, {_RET}, x as (select series_id, date, ret - avg(ret) over (partition by series_id) as d from r where ret is not null), l as (select series_id, d, " + ", ".join(f"lag(d, {k}) {_W} as l{k}" for k in range(1, _LAGS + 1)) + " from x), c as (select series_id, count(*) as n, [1.0::double, " + ", ".join(f"sum(d * l{k}) / (count(*) - {k}) / (sum(d * d) / count(*))" for k in range(1, _LAGS + 1)) + f"] as rho from l group by 1), s(series_id, n, rho, k, phi, last) as (select series_id, n, rho, 1, [rho[2]], rho[2] from c union all select series_id, n, rho, k + 1, list_append(list_transform(range(k), lambda i: phi[i + 1] - nxt * phi[k - i]), nxt), nxt from (select *, (rho[k + 2] - list_dot_product(phi, list_reverse(rho[2:k + 1]))) / (1 - list_dot_product(phi, rho[2:k + 1])) as nxt from s where k < {_LAGS})), h as (select series_id, k from s where abs(last) > 2 / sqrt(n)) select series_id, cast(k as bigint) as lag from h union all select series_id, cast(1 as bigint) as lag from c where series_id not in (select series_id from h)")
def pacf_lags(spark, d):
    return stats.significant_lags(stats.partial_autocorrelations(w.with_returns(each(spark, d)), "ret", 30))


@query(f"with {_EACH}, x as (select series_id, cast(date_diff('day', date '1995-01-01', date) as double) as t, volume from p) select series_id, round(regr_slope(volume, t), 8) as slope, round(regr_intercept(volume, t), 6) as intercept from x group by 1")
def trend_regression(spark, d):
    x = each(spark, d).withColumn("t", F.datediff("date", F.lit("1995-01-01").cast("date")).cast("double"))
    return x.groupBy("series_id").agg(_r(F.regr_slope("volume", "t"), 8, "slope"), _r(F.regr_intercept("volume", "t"), 6, "intercept"))


@query(f"with {_EACH} select series_id, cast(month(date) as bigint) as month, cast(isodow(date) as bigint) as weekday, round(avg(volume), 6) as mean from p group by 1, 2, 3")
def seasonal_means(spark, d):
    return each(spark, d).groupBy("series_id", F.month("date").cast("long").alias("month"), (F.weekday("date") + 1).cast("long").alias("weekday")).agg(_r(F.avg("volume"), 6, "mean"))


@query(f"with {_EACH}, {_RET}, v as (select series_id, var_samp(ret) as s from r group by 1) select series_id, h, round(0.02 / 0.1 + power(0.9, h - 1) * (s - 0.02 / 0.1), 8) as variance from v cross join range(1, 91) t(h)")
def garch_variance_path(spark, d):
    v = w.with_returns(each(spark, d)).groupBy("series_id").agg(F.var_samp("ret").alias("s"))
    steps = v.withColumn("h", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(90).cast("long"))))
    return steps.select("series_id", "h", _r(stats.garch_path(0.02, 0.1, 0.8, F.col("s"), F.col("h")), 8, "variance"))


# ---- simulation and intervals

_UNI = "(cast(('0x' || substr(md5(key), {}, 8)) as bigint) + 0.5) / 4294967296.0"
_PATH = "t as (select row_number() over (order by date desc) as h, ln(close) as lp, 0.05 as sigma from p order by date desc limit 30)"


def _path(spark, d):
    tail = src.tail(whole(spark, d), 30)
    return tail.select("series_id", F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("date"))).cast("long").alias("h"), F.ln("close").alias("log_price"), F.lit(0.05).alias("sigma"))


def _mc(out: DataFrame) -> DataFrame:
    return out.select("h", _r("mc_mean", 3, "mc_mean"), _r("mc_low", 3, "mc_low"), _r("mc_high", 3, "mc_high"))


@query(f"with {_ALL}, {_PATH}, k as (select h, lp, sigma, '42:' || run || ':' || h as key from t cross join range(1000) r(run)), z as (select h, exp(lp + sigma * sqrt(-2 * ln({_UNI.format(1)})) * cos(2 * pi() * {_UNI.format(9)})) as price from k) select h, round(avg(price), 3) as mc_mean, round(quantile_cont(price, 0.025), 3) as mc_low, round(quantile_cont(price, 0.975), 3) as mc_high from z group by 1")
def mc_gaussian(spark, d):
    return _mc(montecarlo.gaussian(_path(spark, d), 1000))


@query(f"with {_ALL}, {_PATH}, {_RET}, n as (select row_number() over (order by date) - 1 as i, ret as r from r where ret is not null), c as (select count(*) as m from n), k as (select h, lp, '42:' || run || ':' || h as key from t cross join range(5000) r(run)), z as (select h, lp, cast(floor({_UNI.format(1)} * m) as bigint) as i from k cross join c), y as (select h, exp(lp + n.r) as price from z join n on n.i = z.i) select h, round(avg(price), 3) as mc_mean, round(quantile_cont(price, 0.05), 3) as mc_low, round(quantile_cont(price, 0.95), 3) as mc_high from y group by 1")
def mc_bootstrap(spark, d):
    r = w.with_returns(whole(spark, d)).where("ret is not null").select("series_id", "date", F.col("ret").alias("r"))
    return _mc(montecarlo.bootstrap(_path(spark, d), r, 5000))


@query(f"with {_EACH}, {_RET}, s as (select series_id, stddev_samp(ret) / 100 as sd from r group by 1) select p.series_id, date, round(close * exp(-1.96 * sd), 3) as low, round(close * exp(1.96 * sd), 3) as high, round(close + volume * (exp(-1.96 * sd) - 1), 3) as low_add, round(close + volume * (exp(1.96 * sd) - 1), 3) as high_add from p join s on p.series_id = s.series_id")
def ci_lognormal_additive(spark, d):
    p = each(spark, d)
    sd = w.with_returns(p).groupBy("series_id").agg((F.stddev_samp("ret") / 100).alias("sd"))
    lo, hi = montecarlo.lognormal("close", F.col("sd"))
    lo2, hi2 = montecarlo.additive("close", "volume", F.col("sd"))
    return p.join(sd, "series_id").select("series_id", "date", _r(lo, 3, "low"), _r(hi, 3, "high"), _r(lo2, 3, "low_add"), _r(hi2, 3, "high_add"))


@query()
def mc_gaussian_sketch(spark, d):
    """20,000 runs with percentiles by a sketch; ranks within 0.07 %."""
    return montecarlo.gaussian(_path(spark, d), 20_000, sketch=4096).select("h", "mc_mean", "mc_low", "mc_high")


@query(f"with {_ALL}, {_PATH}, k as (select h, run, lp, '42:' || run || ':' || h as key from t cross join range(500) r(run)), u as (select *, {_UNI.format(1)} as u0, {_UNI.format(9)} as u1, {_UNI.format(17)} as u2, {_UNI.format(25)} as u3 from k), c as (select *, case when u0 < 0.1 then 0.02 * (case when u1 < 0.5 then ln(2 * u1) else -ln(2 - 2 * u1) end) else 0.0 end as delta from u), z as (select h, lp + h * sum(delta) over w - sum(h * delta) over w + 0.05 * sqrt(-2 * ln(u2)) * cos(2 * pi() * u3) as y from c window w as (partition by run order by h rows unbounded preceding)) select h, round(avg(y), 6) as mc_mean, round(quantile_cont(y, 0.025), 6) as mc_low, round(quantile_cont(y, 0.975), 6) as mc_high from z group by 1")
def mc_trend_bounds(spark, d):
    path = _path(spark, d).withColumnRenamed("log_price", "yhat").withColumns({"rate": F.lit(0.1), "scale": F.lit(0.02)})
    return montecarlo.trend_bounds(path, 500).select("h", *[_r(c, 6, c) for c in ("mc_mean", "mc_low", "mc_high")])


# ---- reports


@query(f"with {_EACH} select series_id, count(*) as rows, cast(min(date) as varchar) as start_date, cast(max(date) as varchar) as end_date, arg_min(close, date) as first_close, arg_max(close, date) as last_close from p group by 1")
def latest_view(spark, d):
    return each(spark, d).groupBy("series_id").agg(F.count("*").alias("rows"), F.min("date").cast("string").alias("start_date"), F.max("date").cast("string").alias("end_date"), F.min_by("close", "date").alias("first_close"), F.max_by("close", "date").alias("last_close"))


@query(f"with {_ALL}, m as (select cast(date_trunc('month', date) as date) as month, avg(volume) as acc from p group by 1), e as (select month, exp((acc - max(acc) over ()) / 2.0) as v from m) select row_number() over (order by v desc, month) as rank, month, round(v / sum(v) over (), 6) as posterior from e order by v desc, month limit 8")
def dashboard_top8(spark, d):
    m = whole(spark, d).groupBy(F.trunc("date", "month").alias("month")).agg(F.avg("volume").alias("acc"))
    top = stats.posterior(m, 2.0).orderBy(F.desc("posterior"), "month").limit(8)
    return top.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("posterior"), "month")).cast("long").alias("rank"), "month", _r("posterior", 6, "posterior"))


@query(f"with {_EACH} select series_id, '{{\"n\":' || count(*) || ',\"last\":\"' || strftime(max(date), '%Y-%m-%d') || '\"}}' as doc from p group by 1")
def summary_json(spark, d):
    g = each(spark, d).groupBy("series_id").agg(F.count("*").alias("n"), F.date_format(F.max("date"), "yyyy-MM-dd").alias("last"))
    return g.select("series_id", F.to_json(F.struct("n", "last")).alias("doc"))


@query(f"with {_EACH} select series_id, lower(series_id) as low, cast(starts_with(series_id, '1') as boolean) as urgent, string_split(series_id, '-')[1] as code, upper(trim(series_id)) as name, count(*) as n from p group by 1")
def string_functions(spark, d):
    n = each(spark, d).groupBy("series_id").agg(F.count("*").alias("n"))
    return n.select("series_id", F.lower("series_id").alias("low"), F.startswith("series_id", F.lit("1")).alias("urgent"), F.element_at(F.split("series_id", "-"), 1).alias("code"), F.upper(F.trim("series_id")).alias("name"), "n")


@query(f"with {_EACH}, a as (select series_id, list(close order by date desc) as xs from p group by 1), c as (select series_id, xs[1:5] as xs from a) select series_id, array_to_string(list_reverse(xs), '|') as newest_last, len(xs) as n from c")
def array_functions(spark, d):
    p = each(spark, d).withColumn("k", w.position_from_end()).where("k <= 5")
    a = p.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "close"))), lambda s: s["close"]).alias("xs"))
    return a.select("series_id", F.array_join(F.transform(F.reverse("xs"), lambda x: x.cast("string")), "|").alias("newest_last"), F.size("xs").cast("long").alias("n"))


# ---- models (no SQL twin; tests/test_series.py has known answers for the models, folds and choices)


@query()
def baseline_forecast(spark, d):
    return grouped.baseline(each(spark, d))


_SO_FAR = "over (partition by series_id order by date rows unbounded preceding)"


@query(f"with e as (select event_type as series_id, cast(ts as date) as date, arg_max(value, event_id) as close from events group by 1, 2), p as (select * from e where date + interval 2 day <= (select max(ts) from events)), {_RET} select series_id, date, round(close, 6) as close, round(ret, 6) as ret, count(ret) {_SO_FAR} as n_returns, round(case when count(ret) {_SO_FAR} > 1 then stddev_samp(ret) {_SO_FAR} end, 5) as volatility from r")
def stream_running(spark, d):
    """Running figures of the events as a stream, on the days that its watermark has finished."""
    return running.replay(spark, d, [14]).select("series_id", "date", _r("close", 6, "close"), _r("ret", 6, "ret"), "n_returns", _r("volatility", 5, "volatility"))


@query()
def garch_fit(spark, d):
    return grouped.garch(each(spark, d))


@query()
def cutoff_scores(spark, d):
    p = each(spark, d)
    return forecast.choose_start(p, forecast.RunConfig())


@query()
def weighted_start(spark, d):
    p = each(spark, d)
    return forecast.choose_start(p, forecast.RunConfig(), choice="weighted").where("chosen")


@query()
def chosen_features(spark, d):
    return selection.choose(each(spark, d), 60)


@query()
def walk_forward(spark, d):
    f = grouped.walk_forward(each(spark, d))
    return f.groupBy("series_id").agg(F.count("*").alias("folds"), F.avg("acc").alias("mean_acc"), F.stddev_pop("acc").alias("std_acc"))


@query()
def fold_table(spark, d):
    """The folds of walk_forward by a table function that SQL calls."""
    tables.register(spark)
    names = [f.name for f in grouped.DEFAULT]
    listed = ", ".join(f"'{n}'" for n in names)
    return spark.sql(f"select * from fold_scores(table(select * from {{rows}}) partition by series_id order by (date), array({listed}), 90, 4, 730, {FOLD_ROUNDS})", rows=w.build(each(spark, d), grouped.DEFAULT))


@query()
def learning_curve(spark, d):
    return grouped.learning_curve(each(spark, d), test_rows=60)


@query()
def hyperparam_search(spark, d):
    return grouped.search_trees(each(spark, d))


@query()
def boosted_frame(spark, d):
    """One model of the returns over the rows of all series, by summed histograms."""
    rows = frames.split(w.build(each(spark, d), grouped.DEFAULT), 60)
    names = [f.name for f in grouped.DEFAULT]
    model = boosting.fit(rows.where("not is_test"), names, "ret", BoostedTrees(rounds=20, rate=0.1), key=["series_id", "date"])
    return boosting.score(rows, names, model).select("series_id", "date", "is_test", "ret", "guess")


@query()
def hyperparam_model_search(spark, d):
    """20 trials on four folds of the training rows."""
    return search.tuned_trees(each(spark, d))


@query()
def hyperparam_test_search(spark, d):
    """100 trials on the error of the test rows."""
    return search.tuned_trees(whole(spark, d), trials=100, folds=None, start=20, batch=16)


@query()
def recursive_forecast(spark, d):
    return grouped.forecast(each(spark, d), horizon=60, test_rows=60)


@query()
def recursive_forecast_repeat(spark, d):
    return grouped.forecast(each(spark, d), horizon=60, test_rows=60, feedback="repeat")


@query()
def recursive_forecast_flat(spark, d):
    return grouped.forecast(each(spark, d), horizon=60, test_rows=60, feedback="flat")


def _flagship(spark, d):
    config = forecast.RunConfig(horizon_days=60, test_last_days=60)
    return config, forecast.run(whole(spark, d), config)


@query()
def forecast_intervals(spark, d):
    return _flagship(spark, d)[1][0]


@query()
def forecast_summary(spark, d):
    config, parts = _flagship(spark, d)
    return forecast.summary(*parts, config)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return forecast_intervals(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
