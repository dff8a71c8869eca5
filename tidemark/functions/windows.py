"""Ordered columns of a series: returns, lags, rolling statistics, averages, filling.

All frames count rows, not days, and a rolling value is null until its frame is full.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order():
    """The window of a series in date order."""
    return Window.partitionBy("series_id").orderBy("date")


def simple_return(x: str = "close") -> Column:
    return F.try_divide(F.col(x), F.lag(x, 1).over(order())) - 1


def difference(x: str) -> Column:
    return F.col(x) - F.lag(x, 1).over(order())


def rolling(fn, x: str, n: int) -> Column:
    frame = order().rowsBetween(1 - n, 0)
    return F.when(F.count(x).over(frame) == n, fn(x).over(frame))


def forward_fill(x: str) -> Column:
    return F.last(x, ignorenulls=True).over(order().rowsBetween(Window.unboundedPreceding, 0))


def position() -> Column:
    return F.row_number().over(order()).cast("long")


def position_from_end() -> Column:
    return F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("date"))).cast("long")


def adjusted_tail_average(x: str, span: int) -> Column:
    """Weighted average of the last `span` rows with weights (1 - 2 / (span + 1)) ** age."""
    keep = 1 - 2 / (span + 1)
    terms = [(F.lag(x, i).over(order()), keep**i) for i in range(span)]
    top = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in terms), F.lit(0.0))
    return top / sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in terms), F.lit(0.0))


@dataclass(frozen=True)
class Feature:
    """A feature column: kind and parameter."""

    kind: str
    n: int

    @property
    def name(self) -> str:
        return {"lag": "lag_ret_", "mean": "roll_mean_ret_", "std": "roll_std_ret_", "vol": "roll_vol_", "ema": "ema_", "sma": "sma_"}[self.kind] + str(self.n)

    def column(self) -> Column | None:
        match self.kind:
            case "lag":
                return F.lag("ret", self.n).over(order())
            case "mean":
                return rolling(F.avg, "ret", self.n)
            case "std":
                return rolling(F.stddev_samp, "ret", self.n)
            case "vol":
                return rolling(F.avg, "volume", self.n)
            case "sma":
                return rolling(F.avg, "close", self.n)
        return None


def _block_rows(spans: list[int]) -> int:
    """Rows of a block, so that the weight of what came before it stays within doubles for every span."""
    fastest = min((s for s in spans if s > 1), default=2)
    return max(2, min(4096, int(570 / -math.log(1 - 2 / (fastest + 1)))))


def exponential(df: DataFrame, spans: list[int], x: str = "close", block_rows: int | None = None) -> DataFrame:
    """df with ema_{span}: seeded by the first value, each next one weighing 2 / (span + 1); nulls leave an average as it is.

    A block of consecutive rows acts on what comes in as one affine map, keep ** n * y + b.
    Blocks are stretches of the calendar, cut again where they hold too many rows, so they
    are spread over tasks also for one long series. Their maps are composed in order, one
    number for each block and span, and each row then applies its block's part up to itself.
    """
    rows = block_rows or _block_rows(spans)
    stamp = F.col("date").cast("timestamp").cast("double") / (86400 if dict(df.dtypes)["date"] == "date" else 3600)
    kept = df.columns
    # one key of both, so that a null series or date joins too
    framed = df.withColumn("_b", F.floor(stamp / rows)).withColumn("_k", F.struct("series_id", "_b"))
    framed = framed.withColumn("_s", F.floor((F.row_number().over(Window.partitionBy("_k").orderBy("date")) - 1) / rows))
    so_far = Window.partitionBy("_k", "_s").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    framed = framed.withColumn("_n", F.count(x).over(so_far))
    value = F.col(x).cast("double")
    own = []
    for s in spans:
        rate = 2 / (s + 1)
        keep = 1 - rate
        # what the block's rows add, over the weight of what came in
        own.append(F.coalesce(F.sum(rate * value / F.pow(F.lit(keep), F.col("_n"))).over(so_far), F.lit(0.0)) if keep else F.last(value, ignorenulls=True).over(so_far))
    framed = framed.withColumns({f"_o{s}": o for s, o in zip(spans, own)})
    ends = framed.groupBy("_k", "_s").agg(F.max("_n").alias("n"), F.min_by(value, F.when(F.col(x).isNotNull(), F.col("date"))).alias("first"), F.max_by(F.array(*[f"_o{s}" for s in spans]), "date").alias("o"))

    def after(y, n, o, span):
        keep = 1 - 2 / (span + 1)
        return F.pow(F.lit(keep), n) * (y + o) if keep else F.coalesce(o, y)

    def step(acc, block):
        y = [F.coalesce(acc["y"][k], block["first"]) for k in range(len(spans))]
        out = F.array(*[after(v, block["n"], block["o"][k], s) for k, (v, s) in enumerate(zip(y, spans))])
        return F.struct(out.alias("y"), F.concat(acc["done"], F.array(F.struct(block["_b"].alias("b"), block["_s"].alias("s"), F.array(*y).alias("y"), acc["y"][0].isNull().alias("new")))).alias("done"))

    start = F.struct(F.array(*[F.lit(None).cast("double")] * len(spans)).alias("y"), F.array().cast("array<struct<b: bigint, s: bigint, y: array<double>, new: boolean>>").alias("done"))
    chained = ends.select("_k.*", "_s", "n", "first", "o").groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("_b", "_s", "n", "first", "o"))).alias("blocks"))
    incoming = chained.select("series_id", F.explode(F.aggregate("blocks", start, step, lambda acc: acc["done"])).alias("i"))
    incoming = incoming.groupBy(F.struct("series_id", F.col("i.b").alias("_b")).alias("_k")).agg(F.array_sort(F.collect_list(F.struct("i.s", "i.y", "i.new"))).alias("_in"))
    joined = framed.join(incoming, "_k")
    came = F.element_at("_in", F.col("_s").cast("int") + 1)
    # there is no average before a series' first value
    there = (F.col("_n") > 0) | ~came["new"]
    return joined.select(*kept, *[F.when(there, after(came["y"][k], F.col("_n"), F.col(f"_o{s}"), s)).alias(f"ema_{s}") for k, s in enumerate(spans)])


def with_returns(df: DataFrame) -> DataFrame:
    return df.withColumns({"ret": simple_return(), "log_close": F.when(F.col("close") > 0, F.ln("close"))})


def build(df: DataFrame, features: list[Feature], drop: bool = True) -> DataFrame:
    """Series with returns and the features; incomplete rows go if drop."""
    spans = [f.n for f in features if f.kind == "ema"]
    df = exponential(df, spans) if spans else df
    df = with_returns(df).withColumns({f.name: f.column() for f in features if f.kind != "ema"})
    return df.na.drop("any") if drop else df
