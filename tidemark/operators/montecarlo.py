"""Simulated price intervals; draws are hashes of (seed, run, step), so they don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(key: Column, part: int) -> Column:
    """A number in (0, 1) from eight hex digits of the key's md5."""
    return (F.conv(F.substring(F.md5(key), 1 + 8 * part, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def normal(key: Column, part: int = 0) -> Column:
    return F.sqrt(-2 * F.ln(uniform(key, part))) * F.cos(2 * F.pi() * uniform(key, part + 1))


def laplace(u: Column) -> Column:
    """A draw of a Laplace distribution of scale 1 from a number in (0, 1)."""
    return F.when(u < 0.5, F.ln(2 * u)).otherwise(-F.ln(2 - 2 * u))


def draw_key(seed: int) -> Column:
    return F.concat_ws(":", F.lit(str(seed)), F.col("run").cast("string"), F.col("h").cast("string"))


def runs(path: DataFrame, n: int) -> DataFrame:
    """Each step of a forecast (series_id, h, ...) for every run."""
    return path.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))


def gaussian(path: DataFrame, n: int, seed: int = 42, low: float = 0.025, high: float = 0.975, sketch: int | None = None) -> DataFrame:
    """series_id, h, mc_mean, mc_low, mc_high of exp(log_price + z * sigma); steps are drawn independently, series share draws."""
    price = F.exp(F.col("log_price") + normal(draw_key(seed)) * F.col("sigma"))
    return interval(runs(path, n).withColumn("price", price), low, high, sketch)


def trend_bounds(path: DataFrame, n: int, seed: int = 42, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """series_id, h, mc_mean, mc_low, mc_high of a trend whose slope goes on changing, plus noise.

    path: series_id, h from 1 on without gaps, yhat, rate (chance of a change a step), scale (mean size
    of a change) and sigma. A change at step j adds its size times h - j at step h, so
    two running sums of each run give the trend.
    """
    key, by = draw_key(seed), Window.partitionBy("series_id", "run").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    drawn = runs(path, n).withColumn("delta", F.when(uniform(key, 0) < F.col("rate"), F.col("scale") * laplace(uniform(key, 1))).otherwise(0.0))
    moved = F.col("h") * F.sum("delta").over(by) - F.sum(F.col("h") * F.col("delta")).over(by)
    return interval(drawn.withColumn("price", F.col("yhat") + moved + F.col("sigma") * normal(key, 2)), low, high)


def bootstrap(path: DataFrame, residuals: DataFrame, n: int, seed: int = 42, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """The same with residuals (r) of the series drawn with replacement; they are numbered in date order."""
    numbered = residuals.select("series_id", (F.row_number().over(Window.partitionBy("series_id").orderBy("date")).cast("long") - 1).alias("i"), "r")
    size = residuals.groupBy("series_id").agg(F.count("*").alias("n_res"))
    drawn = runs(path.join(size, "series_id"), n).withColumn("i", F.floor(uniform(draw_key(seed), 0) * F.col("n_res")).cast("long"))
    return interval(drawn.join(numbered, ["series_id", "i"]).withColumn("price", F.exp(F.col("log_price") + F.col("r"))), low, high)


def rank_error(sketch: int) -> float:
    """By how much the rank of a sketched percentile can be off, with 99 % confidence; the sketch's own formula."""
    return 2.296 / sketch**0.9723


def interval(draws: DataFrame, low: float, high: float, sketch: int | None = None) -> DataFrame:
    """series_id, h, mc_mean, mc_low, mc_high of the drawn prices.

    Percentiles are exact, for which a step's draws meet in one task; with sketch, a size
    from 8 to 65535, they are those of a mergeable quantile sketch: some kilobytes for each
    step and task whatever the runs, and ranks off by at most rank_error(sketch).
    """
    if sketch:
        one = draws.groupBy("series_id", "h").agg(F.avg("price").alias("mc_mean"), F.kll_sketch_agg_double("price", F.lit(sketch)).alias("q"))
        return one.select("series_id", "h", "mc_mean", *[F.kll_sketch_get_quantile_double("q", F.lit(p)).alias(c) for p, c in ((low, "mc_low"), (high, "mc_high"))])
    return draws.groupBy("series_id", "h").agg(F.avg("price").alias("mc_mean"), F.percentile("price", [low, high]).alias("q")).select("series_id", "h", "mc_mean", F.col("q")[0].alias("mc_low"), F.col("q")[1].alias("mc_high"))


def lognormal(price: str, sd: Column) -> tuple[Column, Column]:
    """Interval of a log-normal price at 1.96 deviations."""
    return F.col(price) * F.exp(-1.96 * sd), F.col(price) * F.exp(1.96 * sd)


def additive(price: str, base: str, sd: Column) -> tuple[Column, Column]:
    """Interval of the price with 1.96 deviations on the baseline's scale."""
    return F.col(price) + F.col(base) * (F.exp(-1.96 * sd) - 1), F.col(price) + F.col(base) * (F.exp(1.96 * sd) - 1)
