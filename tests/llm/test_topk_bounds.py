"""The bounds of exact top-k: they save work on the fixture's vectors and lose nothing, whatever the block."""

import duckdb
import numpy as np
import pytest

from stridelake.llm import exact_topk as X


def embeddings():
    rows = duckdb.sql("select vec_id, embedding from '/root/testdata/sf0.1/embeddings.parquet' where embedding is not null").fetchall()
    rows = [(i, e) for i, e in rows if all(x is not None and np.isfinite(x) for x in e)]
    return np.array([i for i, _ in rows]), np.floor(256 * np.array([e for _, e in rows], float))


def plain(ids, vectors, asked, k=5):
    out = {}
    for q in np.flatnonzero(asked):
        scores = {int(i): sum(int(a) * int(b) for a, b in zip(vectors[q], v)) for i, v in zip(ids, vectors) if i != ids[q]}
        out[int(ids[q])] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def found(search):
    rows = search.result().to_pylist()
    out = {}
    for r in sorted(rows, key=lambda r: (-r["score"], r["vec_id"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_bounds_save_products():
    ids, vectors = embeddings()
    asked = ids % 50 == 0
    search = X._Search(ids[asked], vectors[asked], 5)
    search.feed(ids, vectors)
    search.flush()
    assert search.products < 0.7 * asked.sum() * vectors.size


@pytest.mark.parametrize("block", [64, 256, 4096])
def test_small_blocks_and_ties(monkeypatch, block):
    monkeypatch.setattr(X, "BLOCK", block)
    ids, vectors = embeddings()
    ids, vectors = ids[:400], vectors[:400].copy()
    vectors[100:130], vectors[200:204] = vectors[50], -vectors[50]
    asked = np.isin(ids, [ids[50], ids[100], ids[203], ids[7]])
    search = X._Search(ids[asked], vectors[asked], 5)
    for at in range(0, 400, 37):
        search.feed(ids[at : at + 37], vectors[at : at + 37])
    assert found(search) == plain(ids, vectors, asked)


def test_bounds_hold_beyond_doubles(monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 32), monkeypatch.setattr(X, "STEP", 2)
    rng = np.random.default_rng(4)
    vectors = rng.integers(-(2**29), 2**29, (120, 6)).astype(float) * np.exp(-np.arange(120) / 20)[:, None] // 1
    ids, asked = rng.permutation(120), np.arange(120) < 6
    search = X._Search(ids[asked], vectors[asked], 5, exact=False)
    search.feed(ids, vectors)
    assert found(search) == plain(ids, vectors, asked) and search.products < 6 * vectors.size
