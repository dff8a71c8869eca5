"""Boosted trees over rows that no task could hold: Spark sums histograms, level by level.

The driver sees only histograms, at most 2 ** (depth - 1) nodes x columns x bins rows a
level, and sends back the tree, which is of fixed size. Rows keep their bins and what is
left to explain; both are written again every SETTLE trees, so that neither the plan nor
the work that a lost executor repeats grows with the number of trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.models import BoostedTrees, best_cuts
from tidemark.sources.series import settled

SETTLE = 8
ACCURACY = 10_000
_DRAWS = 1 << 24


def _complete(names: list[str]) -> Column:
    """Whether all of the columns are there and are numbers."""
    return F.forall(F.array(*[F.col(c).cast("double") for c in names]), lambda v: v.isNotNull() & ~F.isnan(v))


def column_edges(rows: DataFrame, names: list[str], bins: int, accuracy: int = ACCURACY) -> list[np.ndarray]:
    """Distinct inner quantiles of each column, by a mergeable sketch with a rank error of 1 / accuracy."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    found = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, accuracy).alias(f"q{j}") for j, c in enumerate(names)]).first()
    return [np.unique(np.array(q or [], float)) for q in found]


def _bin(name: str, edges: np.ndarray) -> Column:
    """How many edges are at or below the value."""
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>"), lambda e: e <= F.col(name).cast("double")))


def _walk(tree, bins: Column, level: int, leaf, node: int = 0, depth: int = 0) -> Column:
    """leaf(node, whether it is at the level) for the node where a row's way down to the level ends."""
    column, cut, _ = tree
    if depth == level or column[node] < 0:
        return leaf(node, depth == level)
    left, right = (_walk(tree, bins, level, leaf, child, depth + 1) for child in (2 * node + 1, 2 * node + 2))
    return F.when(bins[int(column[node])] <= int(cut[node]), left).otherwise(right)


def _grown(rows: DataFrame, model: BoostedTrees, cols: np.ndarray):
    """A tree like those of BoostedTrees, from the rows' histograms of `cols`."""
    inner, width = 2**model.depth - 1, max(2, *(len(model.edges[j]) + 1 for j in cols))
    column, cut, value = np.full(inner, -1), np.zeros(inner, int), np.zeros(2 * inner + 1)
    n = total = None
    for level in range(model.depth + 1):
        nodes = np.arange(2**level - 1, 2 ** (level + 1) - 1)
        s, c = np.zeros((len(nodes), len(cols), width)), np.zeros((len(nodes), len(cols), width))
        if level < model.depth:
            at = _walk((column, cut, value), F.col("_bins"), level, lambda i, there: F.lit(int(i)) if there else F.lit(None).cast("int"))
            each = rows.select(at.alias("node"), "_g", F.posexplode(F.array(*[F.col("_bins")[int(j)] for j in cols])).alias("j", "bin")).where("node is not null")
            for r in each.groupBy("node", "j", "bin").agg(F.sum("_g").alias("s"), F.count("*").alias("c")).collect():
                s[r.node - nodes[0], r.j, r.bin], c[r.node - nodes[0], r.j, r.bin] = r.s, r.c
        if n is None:
            n, total = c[:, 0].sum(1), s[:, 0].sum(1)
        value[nodes] = np.where(n > 0, total / (n + model.shrink), value[(nodes - 1) // 2])
        if level == model.depth:
            break
        s, c = s.cumsum(2)[:, :, :-1], c.cumsum(2)[:, :, :-1]
        good, j, k = best_cuts(s, c, n, total, model.shrink)
        column[nodes[good]], cut[nodes[good]] = cols[j[good]], k[good]
        here = np.arange(len(nodes))
        left_n, left_total = np.where(good, c[here, j, k], 0), np.where(good, s[here, j, k], 0)
        n = np.column_stack([left_n, np.where(good, n - left_n, 0)]).ravel()
        total = np.column_stack([left_total, np.where(good, total - left_total, 0)]).ravel()
    return column, cut, value


def fit(rows: DataFrame, names: list[str], target: str, settings: BoostedTrees | None = None, key: list[str] | None = None, edges: list[np.ndarray] | None = None) -> BoostedTrees:
    """A model of target by the columns `names`, of all complete rows; settings as in BoostedTrees.

    key tells rows apart for the sampling (by default all the columns that are read):
    rows of equal keys are drawn together, and a row is drawn alike on any partitioning.
    edges: bounds of the bins, by default column_edges. With no complete row, or no
    column, the model is the mean, or zero.
    """
    model = replace(settings or BoostedTrees())
    rows = rows.where(_complete([*names, target]))
    size, mean = rows.agg(F.count("*"), F.avg(F.col(target).cast("double"))).first()
    model.base, model.trees = float(mean or 0.0), []
    model.edges = edges if edges is not None else column_edges(rows, names, model.bins) if size and names else [np.zeros(0)] * len(names)
    if not size or not names:
        return model
    key = key or [*names, target]
    binned = settled(rows.select(F.array(*[_bin(c, e) for c, e in zip(names, model.edges)]).alias("_bins"), (F.col(target).cast("double") - model.base).alias("_g"), F.xxhash64(*key).alias("_k")))
    rng, left = np.random.default_rng(model.seed), binned
    for t in range(model.rounds):
        cols = np.sort(rng.choice(len(names), max(1, int(model.column_share * len(names))), replace=False))
        drawn = F.pmod(F.xxhash64("_k", F.lit(model.seed), F.lit(t)), F.lit(_DRAWS)) < int(model.row_share * _DRAWS)
        tree = _grown(left.where(drawn) if model.row_share < 1 else left, model, cols)
        model.trees.append(tree)
        step = _walk(tree, F.col("_bins"), model.depth, lambda i, _, v=tree[2]: F.lit(float(v[i])))
        left = left.withColumn("_g", F.col("_g") - model.rate * step)
        if (t + 1) % SETTLE == 0 and t + 1 < model.rounds:
            left = settled(left)
    return model


def score(df: DataFrame, names: list[str], model: BoostedTrees, name: str = "guess") -> DataFrame:
    """df with the model's value for each row, null where a column is missing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(model.predict(x.to_numpy(float)) if len(x) else np.zeros(0))

    if not names:
        return df.withColumn(name, F.lit(model.base))
    run.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.Series]}
    guess = F.pandas_udf(run, "double")(F.struct(*[F.col(c).cast("double").alias(f"c{j}") for j, c in enumerate(names)]))
    return df.withColumn(name, F.when(_complete(names), guess))
