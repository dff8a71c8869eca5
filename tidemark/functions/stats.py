"""Statistics as expressions and small aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import order, position_from_end


def posterior(scores: DataFrame, temperature: float, score: str = "acc") -> DataFrame:
    """scores with a posterior: their softmax at a temperature, among the candidates of a series (of all rows without series_id)."""
    by = Window.partitionBy("series_id" if "series_id" in scores.columns else F.lit(0))
    raised = scores.withColumn("_e", F.exp((F.col(score) - F.max(score).over(by)) / temperature))
    return raised.withColumn("posterior", F.col("_e") / F.sum("_e").over(by)).drop("_e")


def logistic(price: Column, last: Column, spread: Column) -> Column:
    return 1 / (1 + F.exp(-(price - last) / (spread + 1e-9)))


def log_factorial(n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda a, i: a + F.ln(i.cast("double")))


def binomial_at_least(k: Column, n: Column) -> Column:
    """P(X >= k) of n fair trials."""
    k, n = k.cast("int"), n.cast("int")
    term = F.transform(F.sequence(k, n), lambda i: F.exp(log_factorial(n) - log_factorial(i) - log_factorial(n - i) + n * F.ln(F.lit(0.5))))
    return F.least(F.lit(1.0), F.aggregate(term, F.lit(0.0), lambda a, x: a + x))


def binomial_two_sided(k: Column, n: Column) -> Column:
    """Two-sided test of a fair coin, by the symmetry of its distribution."""
    more = F.greatest(k, n - k)
    return F.when(k * 2 == n, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * binomial_at_least(more, n)))


def autocovariances(df: DataFrame, x: str, lags: int) -> DataFrame:
    """series_id, n, and c0..c{lags}: mean-centred products at each lag over n - lag."""
    one = df.where(F.col(x).isNotNull()).select("series_id", "date", F.col(x).alias("x"))
    centred = one.withColumn("d", F.col("x") - F.avg("x").over(Window.partitionBy("series_id")))
    shifted = centred.withColumns({f"l{k}": F.lag("d", k).over(order()) for k in range(1, lags + 1)})
    n = F.count("*")
    return shifted.groupBy("series_id").agg(n.alias("n"), (F.sum(F.col("d") * F.col("d")) / n).alias("c0"), *[F.try_divide(F.sum(F.col("d") * F.col(f"l{k}")), n - k).alias(f"c{k}") for k in range(1, lags + 1)])


def autocorrelations(df: DataFrame, x: str, lags: int) -> DataFrame:
    """series_id, n, lag, acf."""
    cov = autocovariances(df, x, lags)
    pairs = F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), F.try_divide(F.col(f"c{k}"), F.col("c0")).alias("acf")) for k in range(lags + 1)])
    return cov.select("series_id", "n", F.explode(pairs).alias("p")).select("series_id", "n", "p.*")


def levinson(rho: Column) -> Column:
    """Partial autocorrelations from an array of autocorrelations, both from lag 0: the Levinson-Durbin recursion as a fold."""

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)

    def step(acc, k):
        # phi has the k - 1 coefficients of the order before, newest lag last
        phi, past = acc["phi"], F.slice(rho, 2, k - 1)
        last = F.try_divide(F.element_at(rho, k + 1) - dot(phi, F.reverse(past)), 1 - dot(phi, past))
        return F.struct(F.concat(F.zip_with(phi, F.reverse(phi), lambda a, b: a - last * b), F.array(last)).alias("phi"), F.concat(acc["out"], F.array(last)).alias("out"))

    start = F.struct(F.array().cast("array<double>").alias("phi"), F.array(F.lit(1.0)).alias("out"))
    lags = F.when(F.size(rho) > 1, F.sequence(F.lit(1), F.size(rho) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(lags, start, step, lambda acc: acc["out"])


def partial_autocorrelations(df: DataFrame, x: str, lags: int) -> DataFrame:
    """series_id, n, lag, pacf; null from the lag on at which the recursion meets a series without spread."""
    cov = autocovariances(df, x, lags)
    acf = F.array(*[F.try_divide(F.col(f"c{k}"), F.col("c0")) for k in range(lags + 1)])
    rows = cov.select("series_id", "n", acf.alias("acf")).select("series_id", "n", F.posexplode(levinson(F.col("acf"))).alias("lag", "pacf"))
    return rows.select("series_id", "n", F.col("lag").cast("long").alias("lag"), "pacf")


def significant_lags(pacf: DataFrame) -> DataFrame:
    """Lags beyond two standard errors; lag 1 for series without any."""
    hit = pacf.where((F.col("lag") > 0) & (F.abs("pacf") > 2 / F.sqrt(F.col("n").cast("double")))).select("series_id", "lag")
    none = pacf.select("series_id").distinct().join(hit, "series_id", "left_anti").select("series_id", F.lit(1).cast("long").alias("lag"))
    return hit.unionByName(none)


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation of the pairs without nulls; null without spread."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    spread = F.sqrt(F.var_pop(a) * F.var_pop(b))
    return F.when(spread > 0, F.try_divide(F.covar_pop(a, b), spread))


def regime(df: DataFrame, window: int = 30) -> DataFrame:
    """series_id, trend over window - 1 rows, volatility of the last window returns, and the label with its sign."""
    rows = df.withColumn("ret", F.try_divide(F.col("close"), F.lag("close", 1).over(order())) - 1)
    rows = rows.withColumns({"trend": F.try_divide(F.col("close"), F.lag("close", window - 1).over(order())) - 1, "vol": F.stddev_samp("ret").over(order().rowsBetween(1 - window, 0)), "_r": position_from_end()})
    t, v = F.col("trend"), F.col("vol")
    # Bounds and names of the regimes, first match first.
    label = F.when((t > 0.10) & (v < 0.05), "BULL_STABLE").when(t > 0.05, "BULL_VOLATILE").when(t < -0.10, "BEAR").when(F.abs(t) < 0.05, "CONSOLIDATION").otherwise("NEUTRAL")
    # The sign of each regime.
    sign = F.element_at(F.create_map(*[F.lit(x) for pair in (("BULL_STABLE", "🟢"), ("BULL_VOLATILE", "🟡"), ("BEAR", "🔴"), ("CONSOLIDATION", "⚪"), ("NEUTRAL", "⚫")) for x in pair]), F.col("regime"))
    return rows.where("_r = 1").select("series_id", "trend", "vol", label.alias("regime")).withColumn("regime_emoji", sign)


def direction_accuracy(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """series_id, hits, n and acc: how often both rise, or both don't, from one row to the next."""
    d = df.withColumns({"_t": F.col(truth) - F.lag(truth, 1).over(order()), "_g": F.col(guess) - F.lag(guess, 1).over(order())}).where("_t is not null and _g is not null")
    same = ((F.col("_t") > 0) == (F.col("_g") > 0)).cast("long")
    return d.groupBy("series_id").agg(F.sum(same).alias("hits"), F.count("*").alias("n"), F.avg(same.cast("double")).alias("acc"))


def errors(df: DataFrame, truth: str, guess: str) -> DataFrame:
    e = F.col(truth) - F.col(guess)
    return df.groupBy("series_id").agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"))


def garch_path(omega: float, alpha: float, beta: float, first: Column, step: Column) -> Column:
    """Variance `step` steps ahead, from that of the first."""
    long_run = omega / (1 - alpha - beta)
    return long_run + F.pow(F.lit(alpha + beta), step - 1) * (first - long_run)

