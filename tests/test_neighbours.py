"""Exact nearest neighbours with pivots: the same rows as brute force, and what clusters save."""

import numpy as np
import pandas as pd
import pytest

from stridelake.operators import neighbours as K


def plain(rows, weights, k):
    v = rows.drop(columns="id").to_numpy() * weights
    out = {}
    for i, row in zip(rows.id, v):
        d = np.abs(v - row).sum(axis=1)
        order = np.lexsort((rows.id, np.round(d, 12)))
        out[i] = [(int(rows.id.iloc[j]), round(float(d[j]), 9)) for j in order if rows.id.iloc[j] != i][:k]
    return out


def table(n, kind, seed=2):
    rng = np.random.default_rng(seed)
    v = rng.uniform(0, 1, (n, 6))
    if kind == "clusters":
        v = rng.uniform(0, 1, (12, 6))[rng.integers(0, 12, n)] + rng.normal(0, 0.004, (n, 6))
    if kind == "copies":
        v[: n // 3] = v[0]
    return pd.DataFrame({"id": rng.permutation(2 * n)[:n], **{f"f{i}": np.round(v[:, i], 6) for i in range(6)}})


@pytest.mark.parametrize("kind", ["clusters", "uniform", "copies"])
def test_nearest_is_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(K.B, "HELD", 60), monkeypatch.setattr(K.B, "STREAMED", 90)
    rows, weights = table(400, kind), [0.5, 1.0, 1.0, 2.0, 0.25, 1.0]
    found = K.nearest(spark.createDataFrame(rows), "id", [f"f{i}" for i in range(6)], weights, 4, cell_rows=40).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r.id, []).append((r.neighbor, round(r.distance, 9)))
    assert got == plain(rows, np.array(weights), 4)


def test_nearest_of_few(spark):
    rows = spark.createDataFrame([(1, 0.0), (2, 1.0)], "id long, f0 double")
    assert sorted((r.id, r["rank"], r.neighbor, r.distance) for r in K.nearest(rows, "id", ["f0"], [1.0], 5).collect()) == [(1, 1, 2, 1.0), (2, 1, 1, 1.0)]
    assert K.nearest(rows.where("false"), "id", ["f0"], [1.0], 5).isEmpty() and K.nearest(rows.limit(1), "id", ["f0"], [1.0], 5).isEmpty()


def test_a_cell_compares_few():
    rows = table(3000, "clusters").drop(columns="id").to_numpy()
    away = np.abs(rows - rows[0]).sum(axis=1)
    order = np.argsort(away)
    search = K.CellSearch(np.arange(3000), rows[order], away[order], 4)
    for i in range(200):
        search.nearest(i, rows[order[i]], away[order[i]], 0.02)
    assert search.compared < 0.3 * 200 * 3000


def test_waves_bound_the_distance():
    d = np.linspace(0, 1, 1_000_001)
    assert (sum(c * (1 - np.cos(w * d)) for w, c in zip(K.WAVES, K.FACTORS)) <= d).all()


@pytest.mark.parametrize("kind", ["uniform", "normal", "copies", "flat"])
def test_blocks_compare_few_where_cells_save_nothing(kind):
    rng = np.random.default_rng(5)
    rows = rng.uniform(-3, 9, (6000, 64)) if kind == "uniform" else 1e6 + rng.normal(0, 0.2, (6000, 64)).clip(-0.5, 0.5)
    rows[:, 7] = 0.5
    if kind == "copies":
        rows[::3] = rows[:2000]
    if kind == "flat":
        rows[:] = rows[0]
        rows[1:40, 3] += 1e-3
    ids = rng.permutation(20000)[:6000]
    search = K.BlockSearch(ids, rows, rows.min(axis=0), rows.max(axis=0), 5)
    search.feed(ids[:150], rows[:150])
    made = search.result().to_pandas().groupby("id").neighbor.apply(list)
    for i in range(150):
        away = np.abs(rows - rows[i]).sum(axis=1)
        away[i] = np.inf
        assert made[ids[i]] == ids[np.lexsort((ids, np.round(away, 12)))[:5]].tolist()
    assert kind == "flat" or search.compared < 0.1 * 150 * 6000


def test_both_ways_agree(spark, monkeypatch):
    monkeypatch.setattr(K.B, "HELD", 60), monkeypatch.setattr(K.B, "STREAMED", 90)
    rows, weights = table(500, "clusters"), [0.5, 1.0, 1.0, 2.0, 0.25, 1.0]
    found = []
    for worth in (2.0, -1.0):
        monkeypatch.setattr(K, "WORTH", worth)
        found.append({(r.id, r["rank"]): (r.neighbor, round(r.distance, 9)) for r in K.nearest(spark.createDataFrame(rows), "id", [f"f{i}" for i in range(6)], weights, 4, cell_rows=40).collect()})
    assert found[0] == found[1] and len(found[0]) == 2000
