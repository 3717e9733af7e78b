"""Shared helpers of the training-data operators: shared storage, ids and partition planning."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.storage import shared_dir, written

__all__ = ["Recent", "id_bounds", "id_of", "is_null", "order_id", "ranges_of", "shared_dir", "shuffle_parts", "small_batches", "table", "whole_text", "written"]

#: ASCII white space of every contract in this subpackage: space and \x09-\x0D.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: The order key that stands for a null document id: a null id is one more document, after all others.
NULL_ID = (1 << 63) - 1


def order_id(name: str) -> Column:
    """The id as a long that is never null, for grouping and ordering."""
    return F.coalesce(F.col(f"`{name}`").cast("long"), F.lit(NULL_ID))


def is_null(name: str) -> Column:
    """Marks a null id, so that a real id of ``NULL_ID`` is told apart from it."""
    return F.col(f"`{name}`").cast("long").isNull()


def id_of(key: str, none: str) -> Column:
    """The id that :func:`order_id` and :func:`is_null` came from."""
    return F.when(~F.col(none), F.col(key))


def whole_text(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


class Recent(dict):
    """Values of short strings, made where missing. Two generations: of a full table those looked up again move to the next one."""

    def __init__(self, make, most: int = 300_000, longest: int = 48):
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bounds(df: DataFrame, column: str, parts: int) -> list[int]:
    """``parts - 1`` ascending ids that cut the table into ranges of about as many rows (one scan of the id column); an id of many rows is there as often as it ends a range."""
    if parts < 2:
        return []
    wanted = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(F.col(column), wanted, 20 * parts)).first()[0]
    return sorted(found or [])


def ranges_of(ids: np.ndarray, none: np.ndarray, ties: np.ndarray, bounds: list[int]) -> np.ndarray:
    """The range of each row in the order of id, null flag and ``ties`` (hashes as signed longs): (-inf, b0], (b0, b1], ...

    Rows of an id that ends several ranges are spread over them by their tie, so no id makes a range larger than others. However many ranges there are, this is a binary search.
    """
    cuts = np.array(bounds, np.int64)
    first = np.searchsorted(cuts, ids, side="left")
    own = np.searchsorted(cuts, ids, side="right") - first
    place = (ties.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(1) | none.astype(np.uint64) << np.uint64(63)
    part = (place >> np.uint64(32)) * np.maximum(own, 1).astype(np.uint64) >> np.uint64(32)
    return (first + part.astype(np.int64)).astype(np.int32)


def small_batches(df: DataFrame, rows: int = 1000, size: int = 16 << 20) -> DataFrame:
    """``df``, with at most ``rows`` rows and about ``size`` bytes in an Arrow batch from now on in this session (lower settings stay).

    Texts have no bound, so rows alone don't bound a batch's memory; one text larger than ``size`` is a batch of its own.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", str(conf.get(key)).lower()).groups()
        now = int(number) << 10 * "bkmgt".index((unit or "b")[0])
        if now > most or now <= 0:
            conf.set(key, str(most))
    return df


def shuffle_parts(df: DataFrame) -> int:
    """How many ranges a table is cut into: the partitions a shuffle has by the session's setting."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
