"""Exact quantiles by brackets of sketches, stored sketches and weighted quantiles, against NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stridelake.operators import stats as A

QS = [0.0, 0.013, 0.5, 0.99, 1.0]


def frame(n=20_000, seed=1):
    rng = np.random.default_rng(seed)
    key = np.where(rng.uniform(size=n) < 0.6, "hot", np.where(rng.uniform(size=n) < 0.02, "few", "rest"))
    x = np.where(rng.uniform(size=n) < 0.3, 1.5, np.round(rng.normal(0, 100, n), 3))
    return pd.DataFrame({"k": key, "x": np.where(rng.uniform(size=n) < 0.01, np.nan, x), "w": rng.integers(0, 5, n).astype(float)})


@pytest.mark.parametrize("ordered, error", [(4_000_000, 0.02), (10, 0.02), (4_000_000, 1e-9)])
def test_exact_quantiles(spark, monkeypatch, ordered, error):
    """Also where a bracket's values are cut into ranges, and where brackets are so narrow that they miss."""
    monkeypatch.setattr(A, "ORDERED", ordered), monkeypatch.setattr(A, "ERROR", error), monkeypatch.setattr(A, "SKETCH", 200 if error < 1e-6 else 1600)
    rows = frame()
    found = {r.k: r.q for r in A.exact_quantiles(spark.createDataFrame(rows), ["k"], "x", QS, "q").collect()}
    assert set(found) == {"hot", "few", "rest"}
    for k, part in rows.dropna().groupby("k"):
        assert found[k] == pytest.approx(list(np.quantile(part.x, QS)), abs=1e-9)


def test_quantiles_of_nothing_and_of_null_keys(spark):
    rows = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("a", float("inf"))], "k string, x double")
    assert [(r.k, r.q) for r in A.exact_quantiles(rows, ["k"], "x", [0.5], "q").collect()] == [(None, [2.0])]
    assert A.exact_quantiles(rows.where("false"), ["k"], "x", [0.5], "q").isEmpty()


def test_stored_sketches_merge(spark):
    rows = frame(60_000, 3).dropna()
    runs = [A.sketches(spark.createDataFrame(part), ["k"], "x") for part in (rows[::2], rows[1::2])]
    found = {r.k: r for r in A.sketched(A.merged_sketches(runs, ["k"]), ["k"], [0.1, 0.5, 0.9], "q").collect()}
    for k, part in rows.groupby("k"):
        assert found[k].n == len(part)
        for q, x in zip((0.1, 0.5, 0.9), found[k].q):
            assert (part.x < x).mean() - 0.01 <= q <= (part.x <= x).mean() + 0.01


@pytest.mark.parametrize("small", [True, False])
def test_weighted_quantile(spark, small):
    rows = frame(3000, 5).dropna()
    rows.loc[rows.k == "few", "w"] = 0.0
    found = {r.k: r.q for r in A.weighted_quantile(spark.createDataFrame(rows), ["k"], "x", "w", 0.9, "q", small=small).collect()}
    for k, part in rows.groupby("k"):
        part = part.sort_values("x")
        total = part.w.sum()
        want = np.quantile(part.x, 0.9) if total == 0 else part.x[part.w.cumsum() >= total * 0.9 - 1e-12].iloc[0]
        assert found[k] == pytest.approx(want)


def test_quantile_to_the_last_bit_of_duckdb(spark):
    """``F.percentile`` differs in the last bit for every tenth group, so that values at the quantile fell on its other side (low_contact, support_mask)."""
    import duckdb

    rng = np.random.default_rng(5)
    rows = pd.DataFrame({"k": rng.integers(0, 300, 18_000), "x": np.round(rng.exponential(50, 18_000), 2)})
    rows.loc[rng.integers(0, 18_000, 50), "x"] = None
    for q in (0.1, 0.2, 0.95, 0.99):
        found = {r.k: r.q for r in spark.createDataFrame(rows).withColumn("x", F.nanvl("x", F.lit(None))).groupBy("k").agg(A.percentile(F.col("x"), q).alias("q")).collect()}
        assert found == dict(duckdb.sql(f"SELECT k, quantile_cont(x, {q}) FROM rows WHERE NOT isnan(x) GROUP BY k").fetchall())
    few = spark.createDataFrame([(1, None), (2, 3.5), (3, float("inf")), (3, 1.0)], "k int, x double").groupBy("k").agg(A.percentile(F.col("x"), 0.5).alias("q")).collect()
    assert {r.k: r.q for r in few} == {1: None, 2: 3.5, 3: float("inf")}


def test_finite_stats_of_large_keys(spark):
    """No key's values are gathered for its quantiles; keys without finite values and null keys have a row."""
    rows = [("a", float(i)) for i in range(101)] + [("b", float("nan")), ("b", None), (None, 3.0), (None, 5.0)]
    df = A.finite_stats_of(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", "x")
    assert "percentile(" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r.k: tuple(round(v, 9) for v in (r.x_mean, r.x_min, r.x_p05, r.x_p50, r.x_p95)) for r in df.collect()}
    assert got == {"a": (50.0, 0.0, 5.0, 50.0, 95.0), "b": (0.0,) * 5, None: (4.0, 3.0, 3.1, 4.0, 4.9)}
