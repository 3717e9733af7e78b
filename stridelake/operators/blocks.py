"""All rows of one table against all of another, in bounded blocks that meet by a shuffle: nothing passes the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block that a task holds, and rows of the other side of a block (about), which stream past it.
HELD, STREAMED = 16_384, 262_144


class Meeting(Protocol):
    """What a task does with one pair of blocks: made from the held side, fed with the other, asked for its result."""

    def feed(self, ids: np.ndarray, matrix: np.ndarray) -> None: ...

    def result(self) -> pa.RecordBatch: ...


def paired(held: DataFrame, streamed: DataFrame, n_held: int, n_streamed: int, block_rows: int | None = None) -> DataFrame:
    """``(a, b, held, id, v)`` of both tables ``(id, v)``: every pair of blocks (a, b) is one run of a partition, its held rows (about ``block_rows``, or ``HELD``) first.

    Rows are dealt to blocks by a hash of the id. Each row is sent once for every block of the other side, so what is shuffled grows with the product
    of the tables over the size of a block, as the comparisons do over its square.
    """
    parts = max(1, int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks_a = max(1, -(-n_held // (block_rows or HELD)))
    blocks_b = max(1, min(n_streamed, max(-(-parts // blocks_a), -(-n_streamed // STREAMED))))

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    one = held.select(block(blocks_a).alias("a"), every(blocks_b).alias("b"), F.lit(True).alias("held"), "id", "v")
    other = streamed.select(every(blocks_a).alias("a"), block(blocks_b).alias("b"), F.lit(False).alias("held"), "id", "v")
    return one.unionByName(other).repartition(max(parts, blocks_a * blocks_b), "a", "b").sortWithinPartitions("a", "b", F.desc("held"))


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """Rows of equal width; missing last components are zero."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), flat.dtype)
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def meetings(width: int, make: Callable[[np.ndarray, np.ndarray], Meeting]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function for ``mapInArrow`` over :func:`paired`: a pair without held rows gives nothing."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids: list[np.ndarray] = []
        held: list[np.ndarray] = []
        meeting, current = None, None
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 2)], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            edges = [0, *cuts.tolist(), len(key)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                pair, is_held = (int(key[lo, 0]), int(key[lo, 1])), bool(key[lo, 2])
                if pair != current:
                    if meeting is not None:
                        yield meeting.result()
                    meeting, current = None, pair
                    held_ids.clear(), held.clear()
                ids, rows = batch.column(3).slice(lo, hi - lo).to_numpy(), matrix_of(batch.column(4).slice(lo, hi - lo), width)
                if is_held:
                    held_ids.append(ids), held.append(rows)
                elif held:
                    if meeting is None:
                        meeting = make(np.concatenate(held_ids), np.concatenate(held))
                    meeting.feed(ids, rows)
        if meeting is not None:
            yield meeting.result()

    return of_batches
