"""Keyed relations: best rows, resume and selection splits, checked joins, trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridelake.functions import rotations as R


def best_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The least row of each key in an order: a pre-aggregated minimum of structs, not a sort of the groups."""
    rest = [c for c in df.columns if c not in keys]
    named = [c.alias(f"__o{i}") for i, c in enumerate(order)]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*named, *rest)).alias("__b"))
    return picked.select(*keys, "__b.*")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Last write wins: the greatest row of each key in an order."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*[c.alias(f"__o{i}") for i, c in enumerate(order)], *rest)).alias("__b"))
    return picked.select(*keys, "__b.*")


def pair_best(left: DataFrame, right: DataFrame, key: str, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """Best row of each side per key, for keys that both have."""
    return best_row(left, [key], left_order).join(best_row(right, [key], right_order), key)


def split_by(df: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is listed, and the others."""
    return df.join(keys, on, "left_semi"), df.join(keys, on, "left_anti")


def without_subsets(df: DataFrame, skipped: DataFrame, on: list[str]) -> DataFrame:
    """Rows of no skipped subset."""
    return df.join(skipped.select(*on), on, "left_anti")


def every_nth(df: DataFrame, n: int, frame: str = "frame") -> DataFrame:
    """Frames 0, n, 2 n, ..."""
    return df.where(F.pmod(F.col(frame), F.lit(n)) == 0)


def first_frames(df: DataFrame, n: int | None, frame: str = "frame") -> DataFrame:
    """The first n frames of every motion, all without n: a filter, not a limit of the table."""
    return df if n is None else df.where(F.col(frame) < n)


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """A report's first n rows in a total order: every task keeps n rows, nothing is sorted as a whole."""
    return df.orderBy(*order).limit(n)


def require_same_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The inner join; running it fails if one side lacks a key of the other."""
    joined = left.withColumn("__l", F.lit(True)).join(right.withColumn("__r", F.lit(True)), key, "full")
    problem = F.concat(F.lit("key on one side only: "), F.col(key).cast("string"))
    checked = F.when(F.col("__l").isNull() | F.col("__r").isNull(), F.raise_error(problem).cast("boolean")).otherwise(F.lit(True))
    return joined.withColumn("__ok", checked).where("__ok").drop("__l", "__r", "__ok")


def key_union(frames: list[DataFrame]) -> DataFrame:
    """Rows of tables with different columns; the columns stand in the order they are first seen."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def shared_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Feature columns (a group, a double underscore, a name) that both tables have, in the first one's order."""
    return [c for c in a.columns if "__" in c and c in set(b.columns)]


def undirected(edges: DataFrame, a: str, b: str, order: list[Column]) -> DataFrame:
    """One row per pair of ends, the first in an order; ends ascending, no self edges."""
    ends = edges.where(F.col(a) != F.col(b)).withColumns({"lo": F.least(a, b), "hi": F.greatest(a, b)}).drop(a, b)
    return best_row(ends, ["lo", "hi"], order)


def global_poses(poses: DataFrame, parents: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """Poses in space from poses relative to the parent: joints of a level join those of the level above, ``depth`` levels at most.

    ``poses(keys, joint, t)`` with t a transform, ``parents(joint, parent)`` with -1 for roots: a skeleton's joints, so it is broadcast and no row is dealt by its joint alone.
    """
    rows = poses.join(F.broadcast(parents), "joint")
    level = rows.where(F.col("parent") < 0).select(*keys, "joint", "t")
    done = level
    for _ in range(depth):
        above = level.select(*keys, F.col("joint").alias("parent"), F.col("t").alias("__above"))
        level = rows.join(above, [*keys, "parent"]).select(*keys, "joint", R.compose(F.col("__above"), F.col("t")).alias("t"))
        done = done.unionByName(level)
    return done


def local_poses(poses: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """The inverse: one self join on the parent; ``parents`` is broadcast."""
    rows = poses.join(F.broadcast(parents), "joint")
    above = poses.select(*keys, F.col("joint").alias("parent"), F.col("t").alias("__above"))
    joined = rows.join(above, [*keys, "parent"], "left")
    local = F.when(F.col("__above").isNull(), F.col("t")).otherwise(R.compose(R.inverse(F.col("__above")), F.col("t")))
    return joined.select(*keys, "joint", local.alias("t"))


def conformed(frames: DataFrame, skeleton: DataFrame, keys: list[str]) -> DataFrame:
    """Frames on another skeleton's joints by name; joints the motion lacks have the reference value. The skeleton is broadcast."""
    grid = frames.select(*keys).distinct().crossJoin(F.broadcast(skeleton))
    return grid.join(frames, [*keys, "joint"], "left").withColumn("q", F.coalesce("q", "ref")).drop("ref")
