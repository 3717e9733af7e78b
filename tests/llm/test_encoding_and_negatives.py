"""Target encoding and hard negatives against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import zlib

import numpy as np
import pandas as pd
import pytest

from stridelake.llm import hard_negatives as H
from stridelake.llm import target_encoding as T


def lines_of(n: int, seed: int) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    key = lambda most, hot: [None if x == 0 else hot if x < most // 3 else int(x) for x in rng.integers(0, most, n)]
    frame = pd.DataFrame({"row": range(n), "a": pd.array(key(12, 1), "Int64"), "b": pd.array(key(30, 2), "Int64"), "time": rng.integers(0, n // 3, n) * 1_000_000, "fold": rng.integers(0, 3, n).astype("int32"), "n": rng.integers(1, 3, n)})
    return frame.assign(s=[int(rng.integers(0, x + 1)) for x in frame.n])


def plain_encoding(lines: pd.DataFrame, column: str, parent: dict | None, folds: int, gap: int) -> dict:
    rows = lines.astype(object).where(lines.notna(), None).to_dict("records")
    up = (lambda key: parent.get(key)) if parent is not None else (lambda key: None)
    out = {}
    for r in rows:
        past = [h for h in rows if h["fold"] != r["fold"] and h["time"] + gap * 1_000_000 < r["time"]]
        p = 500_000
        for same in (past, [h for h in past if up(h[column]) == up(r[column])], [h for h in past if h[column] == r[column]]):
            n, s = sum(h["n"] for h in same), sum(h["s"] for h in same)
            p = (1_000_000 * s + 50 * p) // (n + 50) if n >= 1 else p
        out[r["row"]] = (n, p)
    return out


@pytest.mark.parametrize("gap", [0, 5])
def test_encoding_is_the_plain_one(spark, gap):
    lines = lines_of(240, gap + 1)
    parents = {1: "x", 2: "x", 5: "y", 7: None}
    table = spark.createDataFrame([*parents.items(), (1, "z")], "key long, parent string")  # of a repeated key the least parent holds
    found = T.encode(spark.createDataFrame(lines), {"a": table, "b": None}, folds=3, gap=gap).collect()
    assert len(found) == len(lines)
    for column, parent in (("a", parents), ("b", None)):
        want = plain_encoding(lines, column, parent, 3, gap)
        assert {r["row"]: (r[f"{column}_n"], r[f"{column}_rate"]) for r in found} == want


def test_encoding_without_rows(spark):
    empty = spark.createDataFrame(lines_of(3, 0)).where("false")
    assert T.encode(empty, {"a": None}).collect() == [] and "a_rate" in T.encode(empty, {"a": None}).columns


def test_times_dont_depend_on_the_zone(spark):
    stamps = ["2024-03-31 02:30:00.123456", "2024-10-27 02:30:00", "1969-12-31 23:59:59.999999"]
    df = spark.createDataFrame([(x,) for x in stamps], "x string").selectExpr("cast(x as timestamp_ntz) as x")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        got = [r[0] for r in df.select(T.micros(df.x)).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == [int(np.datetime64(x.replace(" ", "T"), "us").astype(int)) for x in stamps]


def test_op12_drops_and_repeats(spark, tmp_path):
    t = [pd.Timestamp(f"2024-01-0{d}").to_pydatetime() for d in (1, 2, 3)]
    lines = [(1, 1, 5, 1, "returned"), (1, 1, 5, 1, "returned"), (2, None, None, 1, "kept"), (3, 1, 5, 2, None), (4, 1, 5, 1, "kept"), (None, 1, 5, 1, "kept"), (9, 1, 5, 1, "kept")]
    frames = {
        "sale_lines": spark.createDataFrame(lines, "sale_id long, line_no int, item_id long, vendor_id long, flag string").selectExpr("*", "1 as n", "2 as time", "3 as chunk"),
        "sales": spark.createDataFrame([(1, None, t[0]), (1, 7, t[1]), (2, 3, t[1]), (3, 3, t[2]), (4, 3, None)], "sale_id long, client_id long, sold_at timestamp_ntz").selectExpr("*", "1 as fold"),
        "items": spark.createDataFrame([(5, "toys")], "item_id long, kind string"), "vendors": spark.createDataFrame([(1, 4)], "vendor_id long, nation_id int"), "clients": spark.createDataFrame([(3, None)], "client_id long, segment string"),
    }
    for name, df in frames.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = {(r.sale_id, r.item_id, r.vendor_id): r for r in T.op12_target_encoding(spark, str(tmp_path)).collect()}
    assert set(rows) == {(1, 5, 1), (2, -1, 1), (3, 5, 2)}
    folds = {i: zlib.crc32(str(i).encode()) % 5 for i in (1, 2, 3)}
    assert rows[1, 5, 1].n_lines == 2 and rows[1, 5, 1].n_returned == 2 and rows[1, 5, 1].item_n == 0 and rows[1, 5, 1].item_rate == 500_000
    assert rows[3, 5, 2].item_n == (2 if folds[1] != folds[3] else 0) and rows[3, 5, 2].client_n == (1 if folds[2] != folds[3] else 0)


def plain_negatives(rows, anchors, k=5):
    """``rows``: id -> (label, vector of whole numbers)."""
    out = []
    for a in sorted(i for i in rows if anchors(i)):
        score = {i: sum(int(x) * int(y) for x, y in zip(rows[a][1], v)) for i, (_, v) in rows.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if rows[i][0] == rows[a][0]][:k]:
            fits = [i for i in order if rows[i][0] != rows[a][0] and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, rank, i, score[p], score[i]) for rank, i in enumerate(fits[:k], 1)]
    return sorted(out)


def data(n: int, width: int, seed: int, scale: float = 1.0):
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 1, (n, width)) * np.exp(rng.normal(0, 0.7, n))[:, None] * scale
    v[n // 3 : n // 2] = v[0]  # a very common vector
    return {int(i): (int(label), np.floor(256 * np.float32(x).astype(float))) for i, label, x in zip(rng.permutation(n * 2)[:n], rng.integers(0, 3, n), v)}, v


def as_table(spark, rows):
    return spark.createDataFrame([(i, [float(x) / 256 for x in v], label, "x", 1.5, 0) for i, (label, v) in rows.items()], "vec_id long, embedding array<double>, label int, v string, norm double, a int")


@pytest.mark.parametrize("chunk, bucket, anchors", [(1024, 262_144, 2048), (16, 40, 7)])
def test_negatives_are_the_plain_ones(spark, monkeypatch, chunk, bucket, anchors):
    monkeypatch.setattr(H, "CHUNK", chunk), monkeypatch.setattr(H, "BUCKET", bucket), monkeypatch.setattr(H, "ANCHORS", anchors)
    rows, _ = data(300, 6, chunk)
    broken = spark.createDataFrame([(1001, None, 1, "", 0.0, 0), (1002, [float("nan")] * 6, 1, "", 0.0, 0), (1003, [None] * 6, 1, "", 0.0, 0), (1004, [1.0] * 6, None, "", 0.0, 0), (None, [1.0] * 6, 1, "", 0.0, 0)], "vec_id long, embedding array<double>, label int, v string, norm double, a int")
    table = as_table(spark, rows)
    whole = table.unionByName(table).unionByName(broken)  # repeated rows are one
    import pyspark.sql.functions as F

    found = H.hard_negatives(H.vectors(whole, "vec_id", "embedding", F.col("label"), 256), F.col("id") % 4 == 0)
    assert sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == plain_negatives(rows, lambda i: i % 4 == 0)


def test_negatives_beyond_doubles(spark):
    import pyspark.sql.functions as F

    rng = np.random.default_rng(5)
    rows = {i: (int(i % 2), np.array([float(x) for x in rng.integers(2**27, 2**29, 3)])) for i in range(40)}
    found = H.hard_negatives(H.vectors(as_table(spark, rows), "vec_id", "embedding", F.col("label"), 256), F.col("id") % 4 == 0)
    assert sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == plain_negatives(rows, lambda i: i % 4 == 0)


def test_negatives_of_nothing(spark):
    import pyspark.sql.functions as F

    empty = as_table(spark, data(4, 2, 0)[0]).where("false")
    assert H.hard_negatives(H.vectors(empty, "vec_id", "embedding", F.col("label"), 256), F.col("id") % 4 == 0).isEmpty()


def test_norms_save_products():
    """Candidates in descending norms: those too short for every window are never multiplied."""
    rows, v = data(3000, 8, 1)
    matrix = np.floor(256 * v)
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    order = np.argsort(-norms)
    low = np.full((20, 1), -np.inf)
    windows = H.Windows(np.arange(20) + 10_000, np.zeros(20, int), matrix[order[:20]], low, -low, 5, True, True)
    chunk, H.CHUNK = H.CHUNK, 128
    try:
        windows.feed(np.arange(3000), np.zeros(3000, int), matrix[order], norms[order])
    finally:
        H.CHUNK = chunk
    assert windows.products < 0.7 * 20 * 3000
