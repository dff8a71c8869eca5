"""Every query against its DuckDB twin, and the entry module without the llm package."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

from tidemark.plans import catalog

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return None if v is None else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_twin(spark, sf, duck, name):
    out = catalog.queries()[name](spark, sf)
    twin = duck.sql(catalog.oracle_sql()[name])
    assert sorted(out.columns) == sorted(twin.columns)
    at = [twin.columns.index(c) for c in out.columns]
    got = sorted(str([plain(v) for v in r]) for r in out.collect())
    want = sorted(str([plain(r[i]) for i in at]) for r in twin.fetchall())
    assert got == want
    assert got or name in ("cutoff_grid", "theta_cutoffs")


@pytest.mark.parametrize("name", ["baseline_forecast", "garch_fit", "walk_forward", "learning_curve", "cutoff_scores", "hyperparam_test_search", "recursive_forecast", "forecast_intervals", "chosen_features", "pacf_lags", "boosted_frame", "fold_table"])
def test_models_give_rows_without_nan(spark, sf, name):
    # some need series of more rows than the smallest tables have
    folder = os.path.join(os.path.dirname(sf), "sf0.01") if name in ("walk_forward", "cutoff_scores", "fold_table") else sf
    rows = catalog.queries()[name](spark, folder).collect()
    assert rows
    assert not any(isinstance(v, float) and math.isnan(v) for r in rows for v in r)


def test_start_choice_scores_all_candidates(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(catalog.grouped, "score_cutoffs", lambda df, grid, *_, **__: seen.append(grid) or grid.selectExpr("*", "0.5d as acc", "1d as mae", "1L as days"))
    catalog.cutoff_scores(spark, sf)
    config, _ = catalog._flagship(spark, sf)
    assert len(seen) == 2 and config.monte_carlo_runs == 1000
    for grid in seen:
        counts = [r["count"] for r in grid.groupBy("series_id").count().collect()]
        assert counts and set(counts) == {48}


def test_entry_without_llm(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    import shutil

    shutil.copytree(repo, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); assert not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "r")})
