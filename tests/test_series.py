"""Known answers and properties of the series operators and models."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.functions import windows as w
from tidemark.operators import frames, grouped, models, montecarlo, search, selection
from tidemark.plans.forecast import RunConfig
from tidemark.sources import series as src


def frame(spark, closes, start=dt.date(2020, 1, 1), volumes=None, series="s"):
    rows = [(series, start + dt.timedelta(days=i), None if c is None else float(c), float(v)) for i, (c, v) in enumerate(zip(closes, volumes or [1] * len(closes)))]
    return spark.createDataFrame(rows, "series_id string, date date, close double, volume double")


def test_rolling_needs_a_full_frame(spark):
    df = frame(spark, [1, None, 3, 4]).withColumn("r", w.rolling(F.avg, "close", 2))
    assert [r.r for r in df.orderBy("date").collect()] == [None, None, None, 3.5]


def test_frames_count_rows_not_days(spark):
    df = frame(spark, [1, 2, 3, 4]).where("close != 2").withColumn("r", w.rolling(F.avg, "close", 2))
    assert [r.r for r in df.orderBy("date").collect()] == [None, 2.0, 3.5]


def test_exponential_average_starts_with_the_first_value(spark):
    got = [r.ema_3 for r in w.exponential(frame(spark, [1, 1, 2]), [3]).orderBy("date").collect()]
    assert got == pytest.approx([1, 1, 1.5])


@pytest.mark.parametrize("block_rows", [2, 7, 64, None])
def test_exponential_averages_by_blocks_equal_the_recursion(spark, block_rows):
    rng = np.random.default_rng(7)
    closes = (100 + rng.normal(size=500).cumsum()).tolist()
    for i in (0, 1, 2, 40, 41, 300):
        closes[i] = None
    spans = [1, 2, 3, 30, 365]
    some = frame(spark, closes).where("date < '2020-03-01' or date > '2020-05-20'").unionByName(frame(spark, closes[:1] * 3 + [5.0], series="late")).unionByName(frame(spark, [None, None], series="none"))
    got = w.exponential(some.repartition(5), spans, block_rows=block_rows).orderBy("series_id", "date").collect()
    assert len(got) == some.count()
    for s in spans:
        now = {}
        for r in got:
            if r.close is not None:
                before = now.get(r.series_id, r.close)
                now[r.series_id] = before + 2 / (s + 1) * (r.close - before)
            want = now.get(r.series_id)
            assert (r[f"ema_{s}"] is None) if want is None else r[f"ema_{s}"] == pytest.approx(want, rel=1e-12)


def test_no_python_in_averages_and_partial_autocorrelations(spark):
    df = frame(spark, range(1, 90))
    for out in (w.exponential(df, [3, 7]), stats.partial_autocorrelations(w.with_returns(df), "ret", 5)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_integer_steps():
    assert frames.integer_steps(730, 3200, 4) == [730, 1553, 2376, 3200]


def test_binomial_tail(spark):
    p = spark.range(1).select(stats.binomial_at_least(F.lit(20), F.lit(29)).alias("p")).first().p
    assert p == pytest.approx(0.03071417286992073, abs=1e-12)
    two = spark.range(1).select(stats.binomial_two_sided(F.lit(20), F.lit(29)).alias("p")).first().p
    assert two == pytest.approx(2 * 0.03071417286992073, abs=1e-12)


def test_posterior_ties_go_to_the_first(spark):
    scores = spark.createDataFrame([(dt.date(2021, 7, 1), 0.75), (dt.date(2021, 5, 1), 0.75), (dt.date(2020, 1, 1), 0.6)], "cutoff date, acc double")
    post = stats.posterior(scores, 2.0)
    assert post.agg(F.sum("posterior")).first()[0] == pytest.approx(1)
    assert selection.first_best(post, "posterior", "cutoff").first().cutoff == dt.date(2021, 5, 1)


def test_cutoff_grid_of_the_published_run(spark):
    df = spark.createDataFrame([("s", dt.date(2017, 1, 1)), ("s", dt.date(2026, 4, 2))], "series_id string, date date")
    got = [r.cutoff for r in frames.cutoff_grid(df).orderBy("pos").collect()]
    assert len(got) == 48 and got[0] == dt.date(2017, 1, 1) and got[-1] == dt.date(2024, 4, 2)


def test_regime_edges(spark):
    def label(last):
        return stats.regime(frame(spark, [100.0] * 30 + [last])).first().regime

    assert label(104.0) == "CONSOLIDATION" and label(100.0) == "CONSOLIDATION" and label(85.0) == "BEAR" and label(92.0) == "NEUTRAL" and label(112.0) == "BULL_STABLE" and label(107.0) == "BULL_VOLATILE"


def test_partial_autocorrelation_solves_yule_walker(spark):
    rho = np.array([1, 0.6, 0.3, 0.2])
    want = [1.0]
    for k in range(1, 4):
        m = np.array([[rho[abs(i - j)] for j in range(k)] for i in range(k)])
        want.append(np.linalg.solve(m, rho[1 : k + 1])[-1])
    got = spark.createDataFrame([(k, float(r)) for k, r in enumerate(rho)], "lag long, acf double").groupBy().agg(F.array_sort(F.collect_list(F.struct("lag", "acf"))).alias("r"))
    assert got.select(stats.levinson(F.col("r.acf")).alias("p")).first().p == pytest.approx(want)


def test_no_lag_beyond_the_bound_gives_lag_one(spark):
    pacf = spark.createDataFrame([("a", 100, 0, 1.0), ("a", 100, 1, 0.1), ("b", 100, 0, 1.0), ("b", 100, 2, -0.5)], "series_id string, n long, lag long, pacf double")
    assert {(r.series_id, r.lag) for r in stats.significant_lags(pacf).collect()} == {("a", 1), ("b", 2)}


def test_correlation_without_spread_is_null(spark):
    assert frame(spark, [2, 2, 2]).agg(stats.safe_corr("close", "volume").alias("c")).first().c is None


def test_test_rows_leave_training_features_alone(spark):
    closes = list(np.random.default_rng(1).uniform(50, 60, 80))
    a = w.build(frame(spark, closes), grouped.DEFAULT).orderBy("date").limit(40).collect()
    b = w.build(frame(spark, closes[:70] + [500.0] * 10), grouped.DEFAULT).orderBy("date").limit(40).collect()
    assert a == b


def test_boosted_trees_fit_a_step():
    x = np.random.default_rng(0).uniform(size=(400, 2))
    y = (x[:, 0] > 0.5).astype(float)
    p = models.BoostedTrees(400).fit(x, y).predict(x)
    assert np.square(p - y).mean() < 0.03 < 0.2 < np.square(y.mean() - y).mean()


def test_search_draws_depth_rate_and_shares(spark):
    trials = grouped.tree_trials(200)
    for (lo, hi), values in zip(((3, 8), (0.01, 0.2), (0.6, 1), (0.6, 1)), list(zip(*trials))[1:]):
        assert lo <= min(values) < lo + 0.1 * (hi - lo) + 1e-9 and hi - 0.1 * (hi - lo) - 1e-9 < max(values) <= hi
    closes = 50 + np.cumsum(np.random.default_rng(4).normal(size=200))
    got = grouped.search_trees(frame(spark, closes.tolist()), rounds=5, test_rows=30).orderBy("trial").collect()
    assert [(r.trial, r.depth, r.rate, r.row_share, r.column_share) for r in got] == grouped.tree_trials(20)
    assert len({r.mse for r in got}) == 20


def test_trees_follow_their_depth():
    x = np.random.default_rng(0).uniform(size=(500, 3))
    y = ((x > 0.5).sum(axis=1) % 2).astype(float)
    error = [np.square(models.BoostedTrees(60, depth=d, rate=0.2, row_share=1, column_share=1).fit(x, y).predict(x) - y).mean() for d in (1, 3, 8)]
    assert error[0] > 2 * error[1] > 2 * error[2]


def test_seasonal_trend_finds_a_week():
    day = np.arange(400.0)
    y = 0.01 * day + np.sin(2 * np.pi * day / 7)
    model = models.SeasonalTrend(penalty=0.01).fit(day[:350], y[:350])
    assert np.abs(model.predict(day[350:]) - y[350:]).max() < 0.3


def test_garch_recovers_its_parameters():
    rng, s, e = np.random.default_rng(3), 1.0, []
    for _ in range(6000):
        e.append(rng.normal() * np.sqrt(s))
        s = 0.1 + 0.1 * e[-1] ** 2 + 0.8 * s
    m = models.Garch().fit(np.array(e))
    assert abs(m.alpha - 0.1) < 0.05 and abs(m.beta - 0.8) < 0.1
    assert m.path(3)[0] == pytest.approx(m.last)


def test_forecast_rows(spark):
    closes = 100 + np.cumsum(np.random.default_rng(2).normal(size=260))
    for feedback in ("predicted", "repeat", "flat"):
        out = grouped.forecast(frame(spark, closes), horizon=20, test_rows=30, rounds=20, feedback=feedback).orderBy("h").toPandas()
        assert list(out["h"]) == list(range(1, 21)) and out["price"].gt(0).all()
        assert np.allclose(np.log(out["price"]), np.log(out["baseline"]) + out["residual"])


def test_fold_rows_and_empty(spark):
    df = frame(spark, range(1, 61))
    ends = {r.train_end for r in frames.folds(df, 10, 4, 20).select("train_end").distinct().collect()}
    assert ends == {20, 30, 40, 50}
    assert frames.folds(df.limit(0), 10, 4, 20).count() == 0


def test_column_discovery(spark):
    raw = spark.createDataFrame(pd.DataFrame({"date": ["2020-01-01"], "Adj_X": [3.0]}))
    assert src.normalise(raw, adjusted=True).first().volume == 0.0
    with pytest.raises(ValueError):
        src.normalise(raw)
    assert src.flat_names([("Close", "BTC"), "date"]) == ["Close_BTC", "date"]


def test_run_bounds():
    with pytest.raises(ValueError):
        RunConfig(horizon_days=10)
    with pytest.raises(ValueError):
        RunConfig(bayesian_temperature=0)


def test_sinks(spark, tmp_path):
    df = frame(spark, [1, 2, 3])
    src.write_forecast(df, str(tmp_path / "f"), "csv")
    back = src.read_csv(spark, str(tmp_path / "f"), "series_id string, date date, close double, volume double")
    assert sorted(back.collect()) == sorted(df.collect())
    src.write_summary(df.limit(1), str(tmp_path / "s"))
    assert src.read_json(spark, str(tmp_path / "s"), "close double").first().close is not None
    assert src.artifacts(spark, str(tmp_path / "f")).count() > 0


def planted(values):
    """An error whose least value is at depth 6, rate 0.05, row_share 0.9, column_share 0.7."""
    depth, rate, rows, columns = values
    return ((depth - 6) / 6) ** 2 + (np.log(rate / 0.05) / 3) ** 2 + ((rows - 0.9) / 0.4) ** 2 + ((columns - 0.7) / 0.4) ** 2


def test_model_based_search_beats_random_search():
    found = []
    for seed in range(12):
        rng, tried = np.random.default_rng(seed), np.zeros((0, 4))
        while len(tried) < 60:
            new = search.suggest(search.TREES, tried, np.array([planted(t) for t in tried]), 4 if len(tried) else 12, rng)
            tried = np.concatenate([tried, new])
        for r, column in zip(search.TREES, tried.T):
            assert r.low <= column.min() and column.max() <= r.high and (not r.whole or (column == column.round()).all())
        random = search.suggest(search.TREES, np.zeros((0, 4)), np.zeros(0), 60, np.random.default_rng(100 + seed))
        found.append((min(map(planted, tried)), min(map(planted, random))))
    model, plain = np.array(found).T
    assert np.median(model) < 0.4 * np.median(plain) and (model < plain).mean() > 0.7


def test_whole_settings_have_equal_shares():
    depth = search.TREES[0]
    assert [depth.value(u) for u in (0, 0.99 / 6, 1.01 / 6, 0.999)] == [3, 3, 4, 8]
    assert all(depth.value(float(depth.unit(k))) == k for k in range(3, 9))


def test_parzen_density_sums_to_one():
    x = (np.arange(4000) + 0.5) / 4000
    for places in ([], [0.1], [0.2, 0.2, 0.9]):
        assert np.exp(search.Parzen(np.array(places)).log_density(x)).mean() == pytest.approx(1, abs=1e-3)


def test_tuned_trees_are_seeded_and_mark_the_best(spark):
    closes = 50 + np.cumsum(np.random.default_rng(4).normal(size=200))
    df = frame(spark, closes.tolist()).unionByName(frame(spark, (closes * 2)[:40].tolist(), series="short"))
    for folds in (3, None):
        got = [search.tuned_trees(x, trials=7, folds=folds, test_rows=30, rounds=4, start=4, batch=2).orderBy("series_id", "trial").collect() for x in (df, df.repartition(7))]
        assert got[0] == got[1]
        full = [r for r in got[0] if r.series_id == "s"]
        assert [r.trial for r in full] == list(range(7)) and len({r.rate for r in full}) == 7
        assert [r.trial for r in full if r.best] == [min(full, key=lambda r: (r.mse, r.trial)).trial]
        assert all(r.mse is None and not r.best for r in got[0] if r.series_id == "short")
    best = min(full, key=lambda r: r.mse)
    rows = frames.split(w.build(df.where("series_id = 's'"), grouped.DEFAULT), 30).orderBy("date").toPandas()
    test = rows["is_test"].to_numpy(bool)
    base, more, _, _ = grouped.fit_predict(rows, [f.name for f in grouped.DEFAULT], test, 4, depth=int(best.depth), rate=best.rate, row_share=best.row_share, column_share=best.column_share)
    assert best.mse == pytest.approx(np.square(rows["log_close"].to_numpy(float) - base - more)[test].mean())


def by_hand(closes, lags, windows, start=0):
    """Rows of a series from `start` on with returns, logarithms and rolling features, complete ones only."""
    pdf = pd.DataFrame({"date": pd.date_range("2020-01-01", periods=len(closes)).date, "close": closes})[start:].reset_index(drop=True)
    pdf["ret"], pdf["log_close"] = pdf["close"].pct_change(), np.log(pdf["close"])
    for n in lags:
        pdf[f"lag_ret_{n}"] = pdf["ret"].shift(n)
    for n in windows:
        pdf[f"roll_mean_ret_{n}"] = pdf["ret"].rolling(n).mean()
    return pdf.dropna().reset_index(drop=True)


def test_start_scores_by_hand(spark):
    closes = 100 * np.exp(np.cumsum(np.random.default_rng(9).normal(0, 0.02, 620)))
    starts = [0, 100, 255, 256]  # the last one has 364 rows
    grid = spark.createDataFrame([("s", i, dt.date(2020, 1, 1) + dt.timedelta(days=k)) for i, k in enumerate(starts)], "series_id string, pos long, cutoff date")
    got = {r.pos: r for r in grouped.score_cutoffs(frame(spark, closes.tolist()), grid, rounds=8).collect()}
    assert set(got) == {0, 1, 2}
    for pos, start in enumerate(starts[:3]):
        pdf = by_hand(closes, (1, 7), (7, 14), start)
        assert got[pos].days == len(pdf) == 620 - start - 14
        test = np.arange(len(pdf)) >= len(pdf) - 90
        base, more, _, _ = grouped.fit_predict(pdf, ["lag_ret_1", "lag_ret_7", "roll_mean_ret_7", "roll_mean_ret_14"], test, 8, False)
        truth, guess = pdf["close"].to_numpy()[test], np.exp(base + more)[test]
        assert got[pos].acc == pytest.approx(((np.diff(truth) > 0) == (np.diff(guess) > 0)).mean()) and got[pos].mae == pytest.approx(np.abs(truth - guess).mean())


def test_walk_forward_by_hand_on_the_chosen_features(spark):
    closes = 100 * np.exp(np.cumsum(np.random.default_rng(10).normal(0, 0.02, 500)))
    chosen = spark.createDataFrame([("s", ["lag_ret_2", "roll_mean_ret_30"])], "series_id string, features array<string>")
    got = grouped.walk_forward(frame(spark, closes.tolist()), selection.candidates(5), 40, least=365, rounds=8, chosen=chosen).orderBy("fold").collect()
    pdf = by_hand(closes, (2,), (30,))
    ends = frames.integer_steps(365, len(pdf) - 40, 4)
    assert len(got) == 4
    for r, end in zip(got, ends):
        part = pdf.iloc[: end + 40]
        test = np.arange(len(part)) >= end
        base, more, _, _ = grouped.fit_predict(part, ["lag_ret_2", "roll_mean_ret_30"], test, 8)
        truth, guess = part["close"].to_numpy()[test], np.exp(base + more)[test]
        assert r.acc == pytest.approx(((np.diff(truth) > 0) == (np.diff(guess) > 0)).mean())
        assert (r.train_end, r.test_start, r.test_end) == (part["date"][end - 1], part["date"][end], part["date"].iloc[-1])
    assert grouped.walk_forward(frame(spark, closes.tolist()), least=460).count() == 0


def test_bounds_hold_future_trends(spark):
    # trends as the model takes them: changes in the first four fifths of the history, and after it
    rng, rows, truth = np.random.default_rng(12), [], {}
    for s in range(40):
        changes = np.where(rng.random(1200) < 25 / 1100, rng.laplace(0, 0.002, 1200), 0)
        changes[880:1100] = 0
        y = 4 + np.cumsum(np.cumsum(changes) + 0.002) + rng.normal(0, 0.05, 1200)
        truth[f"s{s}"] = y
        rows += [(f"s{s}", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(np.exp(v)), 1.0) for i, v in enumerate(y[:1100])]
    df = spark.createDataFrame(rows, "series_id string, date date, close double, volume double")
    out = grouped.baseline(df, horizon=100, runs=300, change_scale=0.5).toPandas().sort_values(["series_id", "date"])
    assert len(out) == 40 * 1200 and (out["yhat_lower"] < out["yhat"]).all() and (out["yhat"] < out["yhat_upper"]).all()
    inside, width = [], []
    for s, part in out.groupby("series_id"):
        lo, hi = part["yhat_lower"].to_numpy(), part["yhat_upper"].to_numpy()
        inside.append((lo < truth[s]) & (truth[s] < hi))
        width.append(hi - lo)
    inside, width = np.array(inside), np.array(width)
    assert inside[:, :1100].mean() > 0.9 and inside[:, 1100:].mean() > 0.8
    assert width[:, -1].mean() > 1.5 * width[:, 1100].mean()
    tight = grouped.baseline(df, horizon=100, runs=300).toPandas().sort_values(["series_id", "date"])
    assert (tight["yhat_upper"] - tight["yhat_lower"]).to_numpy().reshape(40, 1200)[:, -1].mean() < width[:, -1].mean()


def test_laplace_prior_keeps_few_changes():
    day = np.arange(500.0)
    y = 3 + 0.002 * day + 0.01 * np.maximum(0, day - 200) + np.random.default_rng(1).normal(0, 0.02, 500)
    deltas = [np.sort(np.abs(models.SeasonalTrend(laplace=a).fit(day, y).beta[2:27]))[::-1] for a in (None, 0.05)]
    assert deltas[1][:4].sum() / deltas[1].sum() > deltas[0][:4].sum() / deltas[0].sum()


def test_sketched_percentiles_keep_their_rank_error(spark):
    path = spark.createDataFrame([("s", h, 4.0 + 0.01 * h, 0.05 * h) for h in range(1, 5)], "series_id string, h long, log_price double, sigma double")
    n, exact = 20_000, {}
    draws = montecarlo.runs(path, n).withColumn("price", F.exp(F.col("log_price") + montecarlo.normal(montecarlo.draw_key(42)) * F.col("sigma")))
    for r in draws.groupBy("h").agg(F.array_sort(F.collect_list("price")).alias("p")).collect():
        exact[r.h] = np.array(r.p)
    for size in (200, 4096):
        got = montecarlo.gaussian(path.repartition(3), n, sketch=size).collect()
        assert len(got) == 4
        for r in got:
            for value, p in ((r.mc_low, 0.025), (r.mc_high, 0.975)):
                assert abs(np.searchsorted(exact[r.h], value) / n - p) <= montecarlo.rank_error(size) + 1 / n
            assert r.mc_mean == pytest.approx(exact[r.h].mean())
    assert montecarlo.rank_error(4096) < 0.0008
