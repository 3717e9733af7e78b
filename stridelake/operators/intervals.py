"""Joins of overlapping intervals by bins, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one side of a bin that meet the other side in one task (about); beyond, the bin is split.
SPLIT = 50_000


def _level(length: Column, width: float) -> Column:
    """The least level whose bins, ``width * 2 ** level`` long, are not shorter than the interval: it touches two of them at most."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length / F.lit(float(width)), F.lit(1.0)))).cast("int"))


def _bins(df: DataFrame, side: str, start: str, end: str, width: float, levels: list[int]) -> DataFrame:
    """Rows with a bin of their own level, and of all coarser ones where they meet longer intervals: ``__level``, ``__bin``, the first bin there, and whether the level is their own."""
    own = F.col(f"__{side}_level")
    a, b = F.col(start).cast("double"), F.col(end).cast("double")
    span = lambda level: F.lit(float(width)) * F.pow(F.lit(2.0), level)
    leveled = df.withColumn(f"__{side}_level", _level(b - a, width)).withColumn("__level", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda x: x >= own)))
    first, last = F.floor(a / span(F.col("__level"))), F.ceil(b / span(F.col("__level"))) - 1
    return leveled.withColumn(f"__{side}_first", first).withColumn("__bin", F.explode(F.sequence(first, F.greatest(first, last))))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], start: tuple[str, str], end: tuple[str, str], width: float, split: int = SPLIT) -> DataFrame:
    """Pairs of rows of equal keys whose intervals ``[start, end)`` overlap; columns but the keys must have different names on the two sides.

    Time is cut into bins of ``width`` (a common length), and of twice that, four times and so on. An interval stands in the one or two bins it touches at the level of its own length and at
    coarser ones; a pair meets at the level of the longer one and is reported by the first bin they share alone, so it is found once however wide they are. Bins of
    many rows are split: rows of the left are dealt to parts, those of the right are in each. Null or empty intervals have no pairs. The join is on equal bins.
    """
    sides = [df.where(F.col(s).isNotNull() & (F.col(s) < F.col(e))) for df, s, e in zip((left, right), start, end)]
    found = sides[0].select(_level(F.col(end[0]).cast("double") - F.col(start[0]).cast("double"), width).alias("l")).unionByName(sides[1].select(_level(F.col(end[1]).cast("double") - F.col(start[1]).cast("double"), width).alias("l")))
    levels = sorted(r["l"] for r in found.distinct().collect())  # tens at most: a level doubles the length
    if not levels:
        levels = [0]
    a, b = (_bins(df, side, s, e, width, levels) for df, side, s, e in zip(sides, ("a", "b"), start, end))
    place = [*keys, "__level", "__bin"]
    hot = a.groupBy(*place).count().where(F.col("count") > split).select(*place, F.ceil(F.col("count") / split).cast("int").alias("__parts"))
    parts = F.coalesce("__parts", F.lit(1))
    a = a.join(hot, place, "left").withColumn("__part", F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop("__parts")
    b = b.join(hot, place, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    own = (F.col("__level") == F.col("__a_level")) | (F.col("__level") == F.col("__b_level"))
    once = F.col("__bin") == F.greatest("__a_first", "__b_first")
    overlap = (F.col(start[0]) < F.col(end[1])) & (F.col(start[1]) < F.col(end[0]))
    met = a.join(b, [*place, "__part"]).where(own & once & overlap)
    return met.select(*keys, *[c for c in left.columns if c not in keys], *[c for c in right.columns if c not in keys])
