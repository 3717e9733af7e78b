"""Feature scaling and exact weighted-L1 nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelake.operators import blocks as B
from stridelake.operators import stats as A
from stridelake.storage import written

def robust_scaled(df: DataFrame, features: list[str], lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Every feature clipped to [0, 1] between its own quantiles; 0.5 where the span is nothing or the value no number.

    The table becomes feature-value rows whose quantiles are found feature by feature without ordering a whole feature in one task; the bounds come back as one row.
    """
    named = F.array(*map(F.lit, features))
    values = F.array(*[F.col(c).cast("double") for c in features])
    long = df.select(F.posexplode(values).alias("feature", "x"))
    found = A.exact_quantiles(long, ["feature"], "x", [lo, hi], "b")
    absent = F.transform(named, lambda _, i: F.struct(i.alias("feature"), F.lit(None).cast("array<double>").alias("b")))
    held = F.map_from_entries(F.collect_list(F.struct("feature", "b")))
    bounds = found.agg(held.alias("m")).select(F.transform(absent, lambda f: F.col("m")[f["feature"]]).alias("__b"), F.lit(1).alias("__one"))

    def scaled(x: Column, b: Column) -> Column:
        inside = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - b[0]) / (b[1] - b[0])))
        return F.when(x.isNotNull() & ~F.isnan(x) & (b[1] - b[0] > 1e-12), inside).otherwise(F.lit(0.5))

    joined = df.withColumn("__one", F.lit(1)).join(F.broadcast(bounds), "__one")  # a single row
    joined = joined.withColumn("__v", F.zip_with(values, F.col("__b"), scaled))
    others = [c for c in df.columns if c not in set(features)]
    return joined.select(*others, *[F.col("__v")[i].alias(c) for i, c in enumerate(features)]).select(*df.columns)


#: Weights of the groups of diversity features; they sum to 1.
GROUP_WEIGHTS = {
    "root_locomotion": 0.20, "height_posture": 0.15, "foot_gait_proxy": 0.20, "upper_body_workspace_proxy": 0.20, "joint_range_group": 0.10, "dynamics_complexity": 0.10, "periodicity_symmetry": 0.05,
}


def group_weights(features: list[str], weights: dict[str, float] = GROUP_WEIGHTS) -> list[float]:
    """A feature's weight: its group's (the name before the double underscore) divided by the features of the group."""
    groups = [f.split("__", 1)[0] for f in features]
    return [weights.get(g, 0.0) / groups.count(g) for g in groups]


class CellSearch:
    """The rows of a cell in order of their distance to its pivot; each asking row looks at those alone whose distance differs from its own by no more than its limit."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, away: np.ndarray, k: int):
        self.ids, self.vertical, self.away, self.k = ids, np.ascontiguousarray(rows.T), away, k
        self.compared = 0

    def nearest(self, own: int, row: np.ndarray, away: float, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest rows within the limit, ties to the smaller id. The triangle inequality gets room for rounding."""
        reach = limit * (1 + 1e-9) + 1e-9
        lo, hi = np.searchsorted(self.away, [away - reach, away + reach], side="left")
        hi = np.searchsorted(self.away, away + reach, side="right")
        self.compared += hi - lo
        distance = np.abs(self.vertical[:, lo:hi] - row[:, None]).sum(axis=0)
        ids = self.ids[lo:hi]
        near = np.flatnonzero((distance <= reach) & (ids != own))
        if len(near) > self.k:
            near = near[distance[near] <= np.partition(distance[near], self.k - 1)[self.k - 1] + 1e-11]
        near = near[np.lexsort((ids[near], np.round(distance[near], 12)))][: self.k]
        return ids[near], distance[near]


#: Waves and factors, found by search: the sum of c (1 - cos(w x)) is |x| at most on [-1, 1], and 0.022 less on average for differences of normal values.
WAVES, FACTORS = (1.4517 * np.pi, 4.1553 * np.pi), (0.292, 0.038)


class BlockSearch:
    """A block of rows that all rows of another block look at: products of matrices tell which pairs can be near, their distances alone are taken.

    A cosine of a difference is a product of cosines and sines of both sides, so the sum of all features' waves is one product of rows. It bounds the
    distance from below whatever the data; the room left for single precision is above its worst error. A row's limit is of the rows that seem nearest.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        order = np.argsort(ids)
        self.ids, self.rows, self.low, self.k = ids[order], rows[order], low, k
        self.span = high - low
        self.held = np.ascontiguousarray(self._waves(self.rows).T)
        self.room = 2e-5 * self.span.sum()
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.tile = max(16, (1 << 22) // len(ids))
        self.compared = 0

    def _waves(self, rows: np.ndarray) -> np.ndarray:
        moved = self.span > 0
        angle = (rows[:, moved] - self.low[moved]) / self.span[moved]
        parts = [f(angle * w) * np.sqrt(self.span[moved] * c) for w, c in zip(WAVES, FACTORS) for f in (np.cos, np.sin)]
        return np.concatenate(parts, axis=1).astype(np.float32)

    def _distance(self, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        apart = self.rows[at]
        apart -= row
        return np.abs(apart, out=apart).sum(axis=-1)

    def _limits(self, product: np.ndarray, own: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """A distance that k other rows of the block don't exceed: that of the best of the best groups of places, infinite if there are too few."""
        groups, some = len(self.ids) // 64, self.k + 1
        if groups <= some:
            return np.full(len(rows), np.inf)
        best = product[:, : groups * 64].reshape(len(rows), 64, groups).max(axis=1)
        places = np.argpartition(-best, some - 1, axis=1)[:, :some, None] + groups * np.arange(64)
        chosen = np.take_along_axis(places, np.take_along_axis(product[:, None, :], places, axis=2).argmax(axis=2)[:, :, None], axis=2)[:, :, 0]
        distance = self._distance(chosen, rows[:, None, :])
        distance[self.ids[chosen] == own[:, None]] = np.inf
        return np.partition(distance, self.k - 1, axis=1)[:, self.k - 1]

    def feed(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        for at in range(0, len(ids), self.tile):
            own, rows = ids[at : at + self.tile], matrix[at : at + self.tile]
            product = self._waves(rows) @ self.held
            least = self.span.sum() * sum(FACTORS) - self.room - self._limits(product, own, rows) - 1e-11
            asks, places = np.divmod(np.flatnonzero(product >= least.astype(np.float32)[:, None]), len(self.ids))
            other = self.ids[places] != own[asks]
            asks, places = asks[other], places[other]
            self.compared += len(asks)
            cuts = np.searchsorted(asks, np.arange(len(own) + 1))
            distance = np.concatenate([self._distance(places[lo:hi], row) for lo, hi, row in zip(cuts, cuts[1:], rows)])
            order = np.lexsort((places, np.round(distance, 12), asks))
            asks, places, distance = asks[order], places[order], distance[order]
            first = np.arange(len(asks)) - np.searchsorted(asks, asks) < self.k
            self.found.append((own[asks[first]], self.ids[places[first]], distance[first]))

    def result(self) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*self.found)] if self.found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "neighbor", "distance"])


#: Rows of a cell (about), and cells at most: a pivot each, all of which a task knows; pivots whose distances bound whole cells.
CELL, CELLS, PIVOTS = 2048, 1024, 8


def _to_pivots(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``(id, v, cell, away, p)``: the nearest pivot of each row, how far it is, and the distances to all."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                matrix = B.matrix_of(part.column(1), pivots.shape[1])
                distance = np.stack([np.abs(pivots - row).sum(axis=1) for row in matrix]) if len(matrix) else np.zeros((0, len(pivots)))
                cell = distance.argmin(axis=1)
                kept = [pa.array(cell, pa.int32()), pa.array(distance[np.arange(len(cell)), cell]), pa.array(list(distance), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *kept], names=["id", "v", "cell", "away", "p"])

    return rows.mapInArrow(of_batches, "id long, v array<double>, cell int, away double, p array<double>")


def _asked_of_cells(placed: DataFrame, asked: DataFrame, sizes: dict[int, int], k: int, width: int) -> DataFrame:
    """``(id, neighbor, distance)``: what each ``asked(id, v, limit, cell, away)`` finds in its cell.

    A cell of more than ``HELD`` rows is several blocks, which its asking rows all visit; many asking rows of one cell are several runs, for each of which its
    rows are sent once more. A run is a block's rows, which the task holds, and asking rows that stream past.
    """
    callers = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}  # a row a cell
    table = F.create_map(*[x for c in sizes for x in (F.lit(c), F.array(F.lit(max(1, -(-sizes[c] // B.HELD))), F.lit(max(1, -(-callers.get(c, 0) // B.STREAMED)))))])
    blocks, runs = F.element_at(table, F.col("cell"))[0], F.element_at(table, F.col("cell"))[1]
    hashed = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    held = placed.select("cell", hashed(blocks).alias("block"), every(runs).alias("run"), F.lit(0).alias("kind"), "id", "v", "away", F.lit(0.0).alias("limit"))
    calls = asked.where(F.col("cell").isin(list(sizes))).select("cell", every(blocks).alias("block"), hashed(runs).alias("run"), F.lit(1).alias("kind"), "id", "v", "away", "limit")
    parts = max(1, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = held.unionByName(calls).repartition(max(parts, sum(-(-n // B.HELD) for n in sizes.values())), "cell", "block", "run").sortWithinPartitions("cell", "block", "run", "kind", "away")

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, search = None, [], None
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if at != (here := tuple(key[lo, :3])):
                    at, rows, search = here, [], None
                part = batch.slice(lo, hi - lo)
                ids, matrix, away = part.column(4).to_numpy(), B.matrix_of(part.column(5), width), part.column(6).to_numpy()
                if key[lo, 3] == 0:
                    rows.append((ids, matrix, away))
                    continue
                if search is None and rows:
                    search = CellSearch(*(np.concatenate(x) for x in zip(*rows)), k)
                    rows = []
                if search is not None:
                    limit = part.column(7).to_numpy()
                    found = [search.nearest(int(i), row, float(d), float(most)) for i, row, d, most in zip(ids, matrix, away, limit)]
                    counts = [len(f[0]) for f in found]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, counts)), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], names=["id", "neighbor", "distance"])

    return dealt.mapInArrow(of_batches, "id long, neighbor long, distance double")


#: Rows (about) that tell what the bounds of cells leave, and the share of all pairs up to which cells are searched. Beyond, products of blocks cost less than the search of what is left.
PROBED, WORTH = 4096, 1 / 16
#: Blocks of ``blocks.HELD`` rows that a task of :class:`BlockSearch` holds.
BLOCKS = 4


def _in_blocks(rows: DataFrame, n: int, k: int, width: int) -> DataFrame:
    """``(id, neighbor, distance)``: the k nearest of every row in every block."""
    ends = rows.agg(*[f(F.col("v")[i]).alias(f"{name}{i}") for i in range(width) for name, f in (("lo", F.min), ("hi", F.max))]).first()
    low, high = (np.array([ends[f"{name}{i}"] for i in range(width)]) for name in ("lo", "hi"))
    pairs = B.paired(rows, rows, n, n, BLOCKS * B.HELD)
    return pairs.mapInArrow(B.meetings(width, lambda ids, held: BlockSearch(ids, held, low, high, k)), "id long, neighbor long, distance double")


def nearest(df: DataFrame, id_col: str, features: list[str], weights: list[float], k: int, cell_rows: int = CELL) -> DataFrame:
    """``(id, rank, neighbor, distance)``: the k nearest other rows by weighted L1 to 12 digits, ties to the smaller id. Ids must be unique, values numbers.

    Rows are dealt to the cells of pivots, a bounded sample of rows. Each row first searches its own cell; the k-th distance there is its limit. It is then sent to those other cells
    alone that may hold a nearer row by the triangle inequality: its distance to their pivot less their radius, and to ``PIVOTS`` further pivots outside their range, are lower bounds. In a
    cell it looks at the rows whose distance to the pivot is near its own. What is pruned depends on the data (little where all rows are about as far from each other); some rows
    are asked first, and if cells leave too many pairs, all rows meet in blocks instead (:class:`BlockSearch`). The result is the same. The driver gets the pivots and a few numbers a cell.
    """
    values = F.array(*[F.col(c).cast("double") * w for c, w in zip(features, weights)])
    rows = written(df.select(F.col(id_col).cast("long").alias("id"), values.alias("v")))
    width, n = len(features), rows.count()
    cells = max(1, min(CELLS, n // cell_rows))
    if cells == 1 and n:
        return _ranked(_in_blocks(rows, n, k, width), k)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(cells).collect()
    pivots = np.array([r["v"] for r in sample]).reshape(-1, width)
    if not len(pivots):
        return rows.select("id", F.lit(1).alias("rank"), F.col("id").alias("neighbor"), F.lit(0.0).alias("distance"))
    placed = written(_to_pivots(rows, pivots))
    some = list(range(min(PIVOTS, cells)))
    about = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"), *[f(F.col("p")[i]).alias(f"{n}{i}") for i in some for n, f in (("lo", F.min), ("hi", F.max))]).collect()
    sizes = {r["cell"]: r["n"] for r in about}
    bounds = F.array(*[F.struct(F.lit(r["cell"]).alias("cell"), F.lit(r["n"]).alias("n"), F.lit(float(r["radius"])).alias("radius"), F.array(*[F.lit(float(r[f"lo{i}"])) for i in some]).alias("lo"), F.array(*[F.lit(float(r[f"hi{i}"])) for i in some]).alias("hi")) for r in about])
    room = F.col("limit") * (1 + 1e-9) + 1e-9

    def reaches(c: Column) -> Column:
        near = F.get(F.col("p"), c["cell"]) - c["radius"] <= room
        for i in some:
            near = near & (F.col("p")[i] - c["hi"][i] <= room) & (c["lo"][i] - F.col("p")[i] <= room)
        return near & (c["cell"] != F.col("cell"))

    def asking(callers: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What rows find in their own cells, and the rows with their limits and the other cells ``cs`` they reach."""
        own = written(_ranked(_asked_of_cells(placed, callers.select("id", "v", F.lit(float("inf")).alias("limit"), "cell", "away"), sizes, k, width), k))
        limits = own.groupBy("id").agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("limit"))
        limited = callers.join(limits, "id", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
        return own, limited.select("id", "v", "limit", "p", "cell", F.filter(bounds, reaches).alias("cs"))

    probed = asking(placed.where(F.pmod(F.xxhash64("id", F.lit(1)), max(1, n // PROBED)) == 0))[1]
    left = F.aggregate("cs", F.lit(0).cast("long"), lambda s, c: s + c["n"])
    share = probed.agg(F.avg(left + F.element_at(F.create_map(*[F.lit(x) for c in sizes.items() for x in c]), F.col("cell")))).first()[0]
    if share is None or share > WORTH * n:
        return _ranked(_in_blocks(rows, n, k, width), k)
    own, reached = asking(placed)
    others = reached.select("id", "v", "limit", "p", F.explode("cs").alias("c")).select("id", "v", "limit", F.col("c.cell").alias("cell"), F.get("p", F.col("c.cell")).alias("away"))
    found = own.select("id", "neighbor", "distance").unionByName(_asked_of_cells(placed, written(others), sizes, k, width))
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.round("distance", 12), "neighbor"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "rank", "neighbor", "distance")


def group_breakdown(edges: DataFrame, df: DataFrame, id_col: str, features: list[str], weights: list[float]) -> DataFrame:
    """Adds to each edge ``group_distance``: the weighted L1 distance by feature group, as a map."""
    groups = list(dict.fromkeys(f.split("__", 1)[0] for f in features))
    a = df.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"__a_{c}") for c in features])
    b = df.select(F.col(id_col).alias("neighbor"), *[F.col(c).alias(f"__b_{c}") for c in features])
    joined = edges.join(a, "id").join(b, "neighbor")

    def part(group: str):
        total = F.lit(0.0)
        for c, w in zip(features, weights):
            if c.split("__", 1)[0] == group:
                total = total + F.abs(F.col(f"__a_{c}") - F.col(f"__b_{c}")) * w
        return total

    return joined.select(*edges.columns, *[part(g).alias(f"group_weighted_{g}") for g in groups])
