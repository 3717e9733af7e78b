"""Overlapping intervals and two-level scans against plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stridelake.operators import intervals as I
from stridelake.operators import scans as N


@pytest.mark.parametrize("split", [50_000, 5])
def test_overlaps_are_those_of_all_pairs(spark, split):
    """Lengths from nothing to the whole, a bin that many share, nulls and repeated rows."""
    rng = np.random.default_rng(split)
    a = pd.DataFrame({"k": rng.integers(0, 2, 80), "i": range(80), "a0": np.where(rng.uniform(size=80) < 0.5, 10.0, rng.uniform(-50, 200, 80))})
    a["a1"] = a.a0 + rng.choice([0.0, 0.5, 3.0, 40.0, 5000.0], 80)
    b = pd.DataFrame({"k": rng.integers(0, 2, 60), "j": [*range(59), 58], "b0": rng.uniform(-50, 200, 60)})
    b["b1"] = b.b0 + rng.choice([0.0, 1.0, 10.0, 300.0], 60)
    left = spark.createDataFrame(a).unionByName(spark.createDataFrame([(0, -1, None, 5.0), (None, -2, 1.0, 5.0)], "k long, i long, a0 double, a1 double"))
    met = I.overlap_join(left, spark.createDataFrame(b), ["k"], ("a0", "b0"), ("a1", "b1"), 4, split)
    want = sorted((x.i, y.j) for x in a.itertuples() for y in b.itertuples() if x.k == y.k and x.a0 < x.a1 and y.b0 < y.b1 and x.a0 < y.b1 and y.b0 < x.a1)
    assert sorted((r.i, r.j) for r in met.collect()) == want and len(want) > 100
    plan = met._jdf.queryExecution().optimizedPlan().toString() + met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert I.overlap_join(left.where("false"), spark.createDataFrame(b), ["k"], ("a0", "b0"), ("a1", "b1"), 4).isEmpty()


def series(n=300, seed=0):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame({"k": rng.integers(0, 3, n), "i": rng.permutation(4 * n)[:n] - n, "q": np.round(rng.uniform(-180, 180, n), 2)})
    return frame.sort_values(["k", "i"])


@pytest.mark.parametrize("size", [1, 7, 100, 10**6])
def test_running_steps_dont_depend_on_ranges(spark, size):
    rows = series()
    df = spark.createDataFrame(rows)
    angles = {(r.k, r.i): r.u for r in N.unwrapped(df, ["k"], "i", "q", "u", size).collect()}
    clusters = {(r.k, r.i): r.c for r in N.gap_clusters(df, ["k"], "i", 6, "c", size).collect()}
    for k, part in rows.groupby("k"):
        u, c, before = None, 0, None
        for r in part.itertuples():
            u = r.q if u is None else u + (r.q - before.q + 180) % 360 - 180
            c += 0 if before is None else r.i - before.i > 6
            before = r
            assert angles[k, r.i] == pytest.approx(u) and clusters[k, r.i] == c


@pytest.mark.parametrize("size", [1, 5, 64, 10**6])
def test_longest_runs_across_ranges(spark, size):
    rng = np.random.default_rng(size % 97)
    rows = pd.DataFrame({"k": np.repeat(["all", "none", "some", "long"], 120), "i": list(range(120)) * 4})
    rows["on"] = [True if k == "all" else None if k == "none" and i % 2 else False if k == "none" else bool(rng.uniform() < 0.8) if k == "some" else 20 <= i < 101 for k, i in zip(rows.k, rows.i)]
    found = {r.k: r.n for r in N.longest_runs(spark.createDataFrame([tuple(r) for r in rows.itertuples(index=False)], "k string, i long, on boolean"), ["k"], "i", F.col("on"), "n", size).collect()}
    best = max(map(len, "".join("1" if x else "0" for x in rows.on[rows.k == "some"]).split("0")))
    assert found == {"all": 120, "none": 0, "some": best, "long": 81}
