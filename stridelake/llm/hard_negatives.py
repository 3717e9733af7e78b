"""Hard-negative mining: windows of inner products around each positive, searched in buckets of candidates of like norm."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridelake.llm.common import shuffle_parts, table, written
from stridelake.operators.blocks import matrix_of

#: Anchors of a block, candidates of a bucket (at most about; at small sizes a bucket for every partition), candidates that are multiplied at once.
ANCHORS, BUCKET, CHUNK = 2048, 262_144, 1024
#: Integers of smaller size are exact as doubles.
EXACT = float(1 << 53)
#: Room for the rounding of norms.
ROOM = 1 + 1e-9


def vectors(df: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """``(id, label, v, norm)`` with ``floor(scale * x)``; rows with a null id, label or vector, or with a null or non-finite component, go. Of rows that repeat an id the least vector, then label stays."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"), F.coalesce(finite, F.lit(False)).alias("ok"))
    rows = rows.where("id is not null and label is not null and ok")
    whole = rows.select("id", "label", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v"))
    one = whole.groupBy("id").agg(F.min(F.struct("v", "label")).alias("x")).select("id", "x.label", "x.v")
    return one.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))


def _cuts(df: DataFrame, column: str, parts: int) -> list[float]:
    """``parts - 1`` ascending values that cut the rows into about equal parts; a very common value is there as often as it ends one."""
    if parts < 2:
        return []
    return sorted(df.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or [])


def _dealt(value: Column, cuts: list[float]) -> Column:
    """The part of a value, from 0: (-inf, c0], (c0, c1], ...; rows of a value that is several cuts are spread over its parts by a hash of the id."""
    if not cuts:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
    bounds = F.array(*map(F.lit, cuts))

    def below(met) -> Column:
        return F.aggregate(steps, F.lit(0), lambda lo, step: F.when(met(F.get(bounds, lo + step - 1)), lo + step).otherwise(lo))

    first = below(lambda cut: cut < value)
    own = below(lambda cut: cut <= value) - first
    return (first + F.pmod(F.xxhash64("id"), F.greatest(own, F.lit(1)))).cast("int")


class Windows:
    """Up to k candidates in each window of each anchor, the highest first, ties by id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, alike: bool, exact: bool):
        self.ids, self.labels, self.k, self.alike, self.exact = ids, labels, k, alike, exact
        self.matrix = matrix if exact else _integers(matrix)
        self.norms = np.sqrt((matrix * matrix).sum(axis=1))
        kind = np.float64 if exact else object
        self.low, self.high = low.astype(kind), high.astype(kind)  # anchors by windows; a window that isn't there is empty
        self.scores = np.full((*low.shape, k), -np.inf, kind)
        self.found = np.full((*low.shape, k), np.iinfo(np.int64).max)
        self.products = 0

    def open(self, norm: float) -> np.ndarray:
        """Anchors that a candidate of this norm can still serve: the lower limit or the k-th score of one of their windows is within the product of norms."""
        floor = np.maximum(self.low, self.scores[:, :, -1]).astype(np.float64)
        return np.flatnonzero((self.norms * norm * ROOM + 0.5 >= floor.min(axis=1, initial=np.inf)) & (self.low <= self.high).any(axis=1))

    def feed(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray, norms: np.ndarray) -> bool:
        """Offers candidates in descending order of norm; False once none of the following can matter."""
        for at in range(0, len(ids), CHUNK):
            rows = self.open(float(norms[at]))
            if not len(rows):
                return False
            some = slice(at, at + CHUNK)
            order = np.argsort(ids[some], kind="stable")
            part = matrix[some][order]
            self._offer(rows, ids[some][order], labels[some][order], part if self.exact else _integers(part))
        return True

    def _offer(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, part: np.ndarray) -> None:
        self.products += len(rows) * len(ids)
        scores = self.matrix[rows] @ part.T
        allowed = (self.labels[rows, None] == labels) == self.alike
        allowed &= self.ids[rows, None] != ids
        for w in range(self.low.shape[1]):
            floor = np.maximum(self.low[rows, w], self.scores[rows, w, -1])[:, None]
            fits = allowed & (scores >= floor).astype(bool) & (scores <= self.high[rows, w, None]).astype(bool)
            full = np.flatnonzero(fits.sum(axis=1) > self.k)
            if len(full):  # the k best of these candidates: of those equal to the k-th the smallest ids, as columns are in order of id
                held = np.where(fits[full], scores[full], -np.inf)
                kth = np.sort(held, axis=1)[:, -self.k, None] if not self.exact else np.partition(held, held.shape[1] - self.k, axis=1)[:, -self.k, None]
                above, tied = held > kth, held == kth
                fits[full] = above | tied & (np.cumsum(tied, axis=1) <= self.k - above.sum(axis=1)[:, None])
            r, c = np.nonzero(fits)
            if len(r):
                self._merge(rows, w, r, ids[c], scores[r, c])

    def _merge(self, rows: np.ndarray, w: int, r: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        touched = np.unique(r)
        old = self.scores[rows[touched], w] > -np.inf
        i, j = np.nonzero(old)
        row = np.r_[touched[i], r]
        score = np.r_[self.scores[rows[touched[i]], w, j], scores]
        name = np.r_[self.found[rows[touched[i]], w, j], ids]
        order = sorted(range(len(row)), key=lambda x: (row[x], -score[x], name[x])) if not self.exact else np.lexsort((name, -score, row))
        row, score, name = row[order], score[order], name[order]
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        place = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
        kept = place < self.k
        self.scores[rows[row[kept]], w, place[kept]], self.found[rows[row[kept]], w, place[kept]] = score[kept], name[kept]

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchor (place), window, candidate and score."""
        a, w, j = np.nonzero(self.scores > -np.inf)
        return a, w, self.found[a, w, j], np.array([int(x) for x in self.scores[a, w, j]], np.int64)


def _integers(matrix: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in matrix.tolist()], object).reshape(matrix.shape)


def _limits(scores: list[list[int] | None], percent: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper limits of windows around scores, as whole numbers; None is a window without limits of its own."""
    wide = max(map(len, scores), default=0)
    low, high = np.full((len(scores), wide), np.inf, object), np.full((len(scores), wide), -np.inf, object)
    for i, row in enumerate(scores):
        for w, s in enumerate(row):
            low[i, w], high[i, w] = (-np.inf, np.inf) if s is None else (-(-percent[0] * s // 100), percent[1] * s // 100)
    return low, high


def search(asked: DataFrame, rows: DataFrame, cuts: list[float], blocks: list[float], skip: range, k: int, alike: bool, percent: tuple[int, int], exact: bool, width: int) -> DataFrame:
    """``(id, place, other, score)``: the k best candidates of a bucket in each window of an anchor of ``asked`` ``(id, label, v, need, around, floor)``.

    ``cuts`` are norms between buckets, ``blocks`` needed norms between blocks of anchors. Candidates of a bucket go to those blocks alone whose least needed norm the bucket reaches.
    Each pair of block and bucket is a run of rows, anchors first, then candidates from the greatest norm down.
    """
    tops = [*cuts, float("inf")]  # of bucket i, ascending norms
    least = [float("-inf"), *blocks]
    first = [next(b for b, top in enumerate(tops) if top * ROOM >= need or b == len(tops) - 1) for need in least]  # non-decreasing: later blocks need more
    last = [max((a for a, b in enumerate(first) if b <= bucket), default=-1) for bucket in range(len(tops))]
    buckets = F.sequence(F.greatest(F.get(F.array(*map(F.lit, first)), F.col("a")), F.lit(skip.start)), F.lit(skip.stop - 1))
    held = asked.withColumn("a", _dealt(F.col("need"), blocks)).where(F.get(F.array(*map(F.lit, first)), F.col("a")) < skip.stop)
    held = held.select("a", F.explode(buckets).alias("b"), F.lit(False).alias("candidate"), F.lit(0.0).alias("fall"), "id", "label", "v", "around", "floor")
    streamed = rows.withColumn("b", _dealt(F.col("norm"), cuts)).where((F.col("b") >= skip.start) & (F.col("b") < skip.stop)).withColumn("to", F.get(F.array(*map(F.lit, last)), F.col("b")))
    streamed = streamed.where("to >= 0").select(F.explode(F.sequence(F.lit(0), F.col("to"))).alias("a"), "b", F.lit(True).alias("candidate"), (-F.col("norm")).alias("fall"), "id", "label", "v", F.lit(None).cast("array<long>").alias("around"), F.lit(None).cast("double").alias("floor"))
    pairs = held.unionByName(streamed).repartition(max(shuffle_parts(rows), len(least) * (skip.stop - skip.start)), "a", "b").sortWithinPartitions("a", "b", "candidate", "fall")

    def made(batches: list[pa.RecordBatch]) -> Windows:
        held_rows = pa.Table.from_batches(batches).combine_chunks()
        floor = held_rows.column(8).to_pylist()
        low, high = _limits([x if f is None else [None] for x, f in zip(held_rows.column(7).to_pylist(), floor)], percent)
        for i, f in enumerate(floor):
            if f is not None:
                low[i, 0] = f
        matrix = matrix_of(held_rows.column(6).combine_chunks(), width)
        return Windows(held_rows.column(4).to_numpy(), held_rows.column(5).to_numpy(), matrix, low, high, k, alike, exact)

    def told(windows: Windows | None) -> Iterator[pa.RecordBatch]:
        if windows is not None:
            a, w, other, score = windows.result()
            yield pa.RecordBatch.from_arrays([pa.array(windows.ids[a], pa.int64()), pa.array(w, pa.int32()), pa.array(other, pa.int64()), pa.array(score, pa.int64())], names=["id", "place", "other", "score"])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, anchors, windows, going = None, [], None, False
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 2)], axis=1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if pair != (at := (key[lo, 0], key[lo, 1])):
                    yield from told(windows)
                    pair, anchors, windows, going = at, [], None, True
                part = batch.slice(lo, hi - lo)
                if not key[lo, 2]:
                    anchors.append(part)
                elif anchors and going:
                    windows = windows or made(anchors)
                    going = windows.feed(part.column(4).to_numpy(), part.column(5).to_numpy(), matrix_of(part.column(6), width), -part.column(3).to_numpy())
        yield from told(windows)

    return pairs.mapInArrow(of_batches, "id long, place int, other long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("id", "place").orderBy(F.desc("score"), "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, percent: tuple[int, int] = (80, 100)) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` from :func:`vectors`.

    An anchor's positives are the rows of its label with the highest inner products, ties to the smaller id; negatives are rows of other labels whose score lies
    within ``percent`` of a positive's, rounded inwards. All, if there are fewer; a negative positive has an empty window. Shorter vectors end in zeros. ``anchors`` is a condition on ``id``.

    Candidates are cut by norm into buckets (a very common norm into several, by a hash of the id). Positives are first searched in the bucket of the greatest norms; the
    k-th score found there limits the others. Buckets whose norms can't reach any lower limit of a block of anchors aren't sent to it, and a task stops at the first candidate
    whose norm is too small. Sums are exact in doubles while the two greatest norms multiply to less than 2**53, beyond in Python's integers, with the same bounds.
    """
    rows = written(rows)
    told = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("w"), F.coalesce(F.max("norm"), F.lit(0.0)).alias("norm")).first()
    asked = rows.where(anchors).withColumn("around", F.array(F.lit(None).cast("long")))
    exact = told["norm"] ** 2 * ROOM < EXACT
    buckets = max(1, min(shuffle_parts(rows), told["n"] // CHUNK), -(-told["n"] // BUCKET))
    cuts = _cuts(rows, "norm", buckets)
    n_blocks = max(1, -(-asked.count() // ANCHORS))
    top = len(cuts)
    given = asked.withColumns({"need": F.lit(float("-inf")), "floor": F.lit(float("-inf"))})
    near = written(_best(search(given, rows, cuts, [float("-inf")] * (n_blocks - 1), range(top, top + 1), positives, True, percent, exact, told["w"]), positives))
    if top:  # the k-th score so far is the lower limit in buckets of smaller norms
        kth = near.groupBy("id").agg(F.when(F.count("*") >= positives, F.min("score").cast("double")).alias("floor"))
        limited = asked.join(kth, "id", "left").withColumn("need", F.coalesce(F.col("floor") / F.greatest("norm", F.lit(1e-300)), F.lit(float("-inf"))))
        limited = written(limited)
        more = search(limited, rows, cuts, _cuts(limited, "need", n_blocks), range(top), positives, True, percent, exact, told["w"])
        near = written(_best(near.select("id", "place", "other", "score").unionByName(more), positives))
    around = near.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.col("rank"), F.col("other"), F.col("score")))).alias("p"))  # `positives` of an anchor at most
    given = asked.drop("around").join(around, "id").withColumns({"around": F.col("p.score"), "floor": F.lit(None).cast("double")})
    open_ = F.array_min(F.filter("around", lambda s: s >= 0))
    given = written(given.withColumn("need", open_ * (percent[0] / 100) / F.greatest("norm", F.lit(1e-300))).where("need is not null"))
    found = _best(search(given, rows, cuts, _cuts(given, "need", n_blocks), range(top + 1), negatives, False, percent, exact, told["w"]), negatives)
    named = found.join(given.select("id", "p"), "id").withColumn("p", F.get("p", F.col("place")))
    return named.select(F.col("id").alias("anchor_id"), F.col("p.other").alias("positive_id"), "rank", F.col("other").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 100th vector; every 7th label is moved on by one. See :func:`hard_negatives` for nulls, ties, repeats and windows."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label, 256), F.col("id") % 100 == 0)


OP13_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, c.vec_id AS c, a.label = c.label AS alike, list_dot_product(a.v, c.v)::BIGINT AS s FROM rows a JOIN rows c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT a, c, s FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, c) <= 5)
SELECT p.a AS anchor_id, p.c AS positive_id, row_number() OVER (PARTITION BY p.a, p.c ORDER BY s.s DESC, s.c)::INTEGER AS rank, s.c AS negative_id, p.s AS positive_score, s.s AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.alike AND 80 * p.s <= 100 * s.s AND 100 * s.s <= 100 * p.s QUALIFY rank <= 5"""
