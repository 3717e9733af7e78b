"""Exact top-k by inner product: vertical blocks, partial scores, remaining-mass bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridelake.llm.common import table
from stridelake.operators import blocks as B

#: Candidates of a vertical block, and dimensions that are added up before survivors are compacted.
BLOCK, STEP = 4096, 16
#: Integers of smaller size are exact as doubles.
EXACT = float(1 << 53)


def _usable(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(id, v)`` with ``floor(scale * x)`` as longs; rows with a null id, or a null vector or a null or non-finite component, go."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"), finite.alias("ok")).where(F.col("id").isNotNull() & F.col("ok"))
    return rows.select("id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


class _Best:
    """The k best distinct ids per query so far: scores descending, ties by id. Scores are doubles, or Python's integers where these don't hold them."""

    def __init__(self, queries: int, k: int, exact: bool = True):
        self.k, self.exact = k, exact
        self.scores = np.full((queries, k), -np.inf, np.float64 if exact else object)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def offer(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(ids):
            return
        known = self.scores[q] > -np.inf
        ids, scores = np.r_[self.ids[q][known], ids], np.r_[self.scores[q][known], scores]
        order = np.lexsort((ids, -scores)) if self.exact else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])))
        ids, scores = ids[order], scores[order]
        first = np.sort(np.unique(ids, return_index=True)[1])[: self.k]
        self.ids[q, : len(first)], self.scores[q, : len(first)] = ids[first], scores[first]


def _leaders(ids: np.ndarray, partial: np.ndarray, k: int) -> np.ndarray:
    """Places of the k candidates with the highest partial sums, of different ids; fewer if there are not as many among the first few."""
    most = min(len(partial), 4 * k)
    best = np.argpartition(-partial.astype(np.float64), most - 1)[:most]
    best = best[np.argsort(-partial[best].astype(np.float64), kind="stable")]
    return best[np.sort(np.unique(ids[best], return_index=True)[1])][:k]


def search_block(best: _Best, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vertical: np.ndarray) -> int:
    """Offers one block of candidates (a row per dimension) to every query; returns how many products were made.

    A query takes its dimensions in order of its own mass, STEP at a time. After the first step the k leaders are finished, so that there is a lower limit from the first block
    on. After each step a candidate's score is at most the partial sum plus the product of the norms of what remains of both vectors; those whose bound is below
    the k-th score are compacted away. Sums are exact; bounds are doubles with room for the rounding of sums and roots, in proportion to their size.
    """
    dims, products = vertical.shape[0], 0
    squares = vertical.astype(np.float64) ** 2
    total = squares.sum(axis=0)
    for q in range(len(query_ids)):
        query = queries[q]
        weight = query.astype(np.float64)
        order = np.argsort(-np.abs(weight), kind="stable")
        floor = best.scores[q, -1]
        alive = np.flatnonzero(ids != query_ids[q])
        partial, rest = np.zeros(len(alive), vertical.dtype), total[alive]
        query_rest = float(weight @ weight)
        for at in range(0, dims, STEP):
            some = order[at : at + STEP]
            whole = len(alive) == len(ids)
            part = vertical[some] if whole else vertical[np.ix_(some, alive)]
            partial = partial + query[some] @ part
            products += part.size
            if at + STEP >= dims or not len(alive):
                break
            if at == 0 and len(alive) > best.k:
                first = _leaders(ids[alive], partial, best.k)
                if len(first) == best.k:
                    floor = max(floor, (partial[first] + query[order[STEP:]] @ vertical[np.ix_(order[STEP:], alive[first])]).min())
                    products += best.k * (dims - STEP)
            if floor == -np.inf:
                continue
            rest = rest - (squares[some] if whole else squares[np.ix_(some, alive)]).sum(axis=0)
            query_rest -= float(weight[some] @ weight[some])
            reach, so_far = np.sqrt(np.maximum(rest, 0.0) * max(query_rest, 0.0)), partial.astype(np.float64)
            keep = so_far + reach + 1e-9 * (np.abs(so_far) + reach + abs(float(floor))) + 0.5 >= float(floor)
            if not keep.all():
                alive, partial, rest = alive[keep], partial[keep], rest[keep]
        if len(alive) > best.k:  # ties at the k-th place stay
            chosen = (partial >= floor).astype(bool)
            if len(np.unique(ids[alive])) == len(alive):
                kth = np.sort(partial)[-best.k]
                chosen &= (partial >= kth).astype(bool)
            alive, partial = alive[chosen], partial[chosen]
        best.offer(q, ids[alive], partial)
    return products


class _Search:
    """A block of queries that candidates stream past; the bounds left by earlier vertical blocks prune later ones."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, exact: bool = True):
        self.exact, self.ids, self.queries, self.best = exact, ids, queries if exact else queries.astype(np.int64).astype(object), _Best(len(ids), k, exact)
        self.held_ids: list[np.ndarray] = []
        self.held: list[np.ndarray] = []
        self.products = 0

    def feed(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.held_ids.append(ids), self.held.append(rows)
        if sum(map(len, self.held_ids)) >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.held:
            ids, rows = np.concatenate(self.held_ids), np.concatenate(self.held)
            self.held_ids.clear(), self.held.clear()
            rows = rows if self.exact else rows.astype(np.int64).astype(object)
            for at in range(0, len(ids), BLOCK):
                self.products += search_block(self.best, self.ids, self.queries, ids[at : at + BLOCK], np.ascontiguousarray(rows[at : at + BLOCK].T))

    def result(self) -> pa.RecordBatch:
        self.flush()
        q, r = np.nonzero(self.best.scores > -np.inf)
        scores = np.array([int(x) for x in self.best.scores[q, r]], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.best.ids[q, r]), pa.array(scores)], names=["query_id", "vec_id", "score"])


def exact_top_k(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query the k candidates of ``df`` with the highest integer inner product, ties to the smaller id.

    Vectors are ``floor(scale * x)``. A query's own id is no candidate. Rows that repeat an id are one candidate with the best of their scores; a
    query that repeats an id is the least of its vectors. Null or non-finite vectors take no part; a shorter vector counts as ending in
    zeros. With fewer than k candidates all are returned; without queries or candidates nothing is.

    Bounded blocks of queries and of candidates meet by a shuffle (:mod:`stridelake.operators.blocks`), so nothing but three numbers of each table passes the driver, and
    each pair returns k rows per query. Sums are exact in doubles while the greatest norms of both tables multiply to less than 2**53 (the
    bound of any partial sum); beyond, sums are Python's integers, with the same bounds. Scores must fit a long.
    """
    rows = _usable(df, id_col, vector_col, scale)
    asked = _usable(queries, id_col, vector_col, scale).groupBy("id").agg(F.min("v").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    told = [t.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("w"), F.coalesce(F.max(norm), F.lit(0.0)).alias("norm")).first() for t in (rows, asked)]
    width = max(t["w"] for t in told)
    exact = told[0]["norm"] * told[1]["norm"] * (1 + 1e-9) < EXACT
    if exact:
        rows, asked = (t.withColumn("v", F.col("v").cast("array<double>")) for t in (rows, asked))
    pairs = B.paired(asked, rows, told[1]["n"], told[0]["n"])
    found = pairs.mapInArrow(B.meetings(width, lambda ids, matrix: _Search(ids, matrix, k, exact)), "query_id long, vec_id long, score long")
    ranked = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates of every 50th vector; see :func:`exact_top_k` for nulls, ties and repeats."""
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP8_SQL = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM rows),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM parts q JOIN parts c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""
