"""Trees from summed histograms against the trees of one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting
from tidemark.operators.models import BoostedTrees

NAMES = ["a", "b", "c"]


def planted(spark, n=600, parts=3, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(2)
    y = np.where(x[:, 0] > 0.3, 2.0, -1.0) + 0.5 * (x[:, 1] > 0) * x[:, 2] + rng.normal(scale=0.1, size=n)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, a double, b double, c double, y double").repartition(parts)
    return df, x, y


@pytest.mark.parametrize("depth", [1, 3, 5])
def test_splits_equal_those_of_one_task(spark, depth):
    df, x, y = planted(spark)
    settings = dict(rounds=10, depth=depth, rate=0.3, row_share=1.0, column_share=1.0, bins=8)
    one = BoostedTrees(**settings).fit(x, y)
    many = boosting.fit(df, NAMES, "y", BoostedTrees(**settings), edges=one.edges)
    assert many.base == pytest.approx(one.base)
    for a, b in zip(one.trees, many.trees, strict=True):
        split = a[0] >= 0
        assert (a[0] == b[0]).all() and (a[1][split] == b[1][split]).all()
        assert a[2] == pytest.approx(b[2])
    got = {r.id: r.guess for r in boosting.score(df, NAMES, many).collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx(one.predict(x).tolist())


def test_sampled_rows_and_columns_still_learn_alike_on_any_partitioning(spark):
    settings = BoostedTrees(rounds=20, rate=0.3, column_share=0.7)
    df, x, y = planted(spark)
    model = boosting.fit(df, NAMES, "y", settings, key=["id"])
    again = boosting.fit(df.repartition(7), NAMES, "y", settings, key=["id"], edges=model.edges)
    assert all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(model.trees, again.trees))
    assert np.square(y - model.predict(x)).mean() < 0.1 * y.var()
    assert settings.seed == model.seed and not hasattr(settings, "trees")


def test_sketched_edges_are_the_quantiles(spark):
    df, x, _ = planted(spark, n=1000)
    for j, e in enumerate(boosting.column_edges(df, NAMES, 8)):
        rank = [(x[:, j] <= v).mean() for v in e]
        assert rank == pytest.approx([i / 8 for i in range(1, 8)], abs=0.02)


def test_incomplete_rows_empty_tables_and_clashing_names(spark):
    df, x, y = planted(spark, n=80)
    odd = df.unionByName(spark.createDataFrame([(900, None, 1.0, 1.0, 5.0), (901, float("nan"), 1.0, 1.0, 5.0), (902, 1.0, 1.0, 1.0, None)], df.schema)).withColumns({"_g": F.lit(1), "node": F.lit("x")})
    settings = BoostedTrees(rounds=3, row_share=1.0, column_share=1.0)
    edges = [np.array([-0.5, 0.0, 0.5])] * 3
    model, plain = boosting.fit(odd, NAMES, "y", settings, edges=edges), boosting.fit(df, NAMES, "y", settings, edges=edges)
    assert model.base == pytest.approx(plain.base) and all((a[0] == b[0]).all() for a, b in zip(model.trees, plain.trees))
    scored = boosting.score(odd, NAMES, model)
    assert {"_g", "node"} <= set(scored.columns)
    guess = {r.id: r.guess for r in scored.collect()}
    assert guess[900] is None and guess[901] is None and guess[902] is not None
    nothing = boosting.fit(df.where("false"), NAMES, "y", settings)
    assert nothing.base == 0.0 and nothing.trees == []
    assert {r.guess for r in boosting.score(df, NAMES, nothing).collect()} == {0.0}
    assert boosting.fit(df, [], "y", settings).base == pytest.approx(y.mean())


def test_equal_rows_make_a_single_leaf(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 50, "a double, y double")
    model = boosting.fit(df, ["a"], "y", BoostedTrees(rounds=2, row_share=1.0, column_share=1.0))
    assert (model.trees[0][0] == -1).all() and model.predict(np.array([[1.0]]))[0] == pytest.approx(2.0)
