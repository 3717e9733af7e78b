"""Series longer than a task: running steps and runs by ranges, summaries of ranges, and a scan over these."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelake.functions.angles import wrap_degrees

#: Length of a range in the unit of the order column.
RANGE = 100_000


def running_steps(df: DataFrame, keys: list[str], order: str, step: Callable[[Column, Column], Column], value: str, name: str, size: int = RANGE) -> DataFrame:
    """``df`` with ``name``: the running sum of ``step(previous value, value)`` along each series, 0 at its first row. Orders must be unique in a series.

    A series is cut into ranges of ``size`` in the order column. Steps within a range are added up by a window over the range; its first and last value and its sum are a summary, and a
    window over the summaries gives each range the sum of all before it, with the steps from one range's end to the next one's start. So the rows of one series
    are spread over many tasks, and one task sees a row a range of it.
    """
    cut = df.withColumn("__range", F.floor(F.col(order) / size))
    inside = Window.partitionBy(*keys, "__range").orderBy(order)
    moved = F.coalesce(step(F.lag(value).over(inside), F.col(value)), F.lit(0))
    local = cut.withColumn("__step", moved).withColumn("__sum", F.sum("__step").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = local.groupBy(*keys, "__range").agg(F.min_by(value, order).alias("__first"), F.max_by(value, order).alias("__last"), F.sum("__step").alias("__total"))
    along = Window.partitionBy(*keys).orderBy("__range")
    joint = F.coalesce(step(F.lag("__last").over(along), F.col("__first")), F.lit(0))
    whole = ends.withColumn("__joint", joint).withColumn("__before", F.sum("__joint").over(along.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("__total").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    met = local.join(whole.select(*keys, "__range", "__before"), [*keys, "__range"])
    return met.withColumn(name, F.col("__sum") + F.col("__before")).drop("__range", "__step", "__sum", "__before")


def unwrapped(df: DataFrame, keys: list[str], order: str, value: str, name: str, size: int = RANGE) -> DataFrame:
    """Angles in degrees without jumps of a turn: the first one plus the wrapped steps so far."""
    summed = running_steps(df, keys, order, lambda a, b: wrap_degrees(b - a), value, "__turned", size)
    first = df.groupBy(*keys).agg(F.min_by(value, order).alias("__start"))
    return summed.join(first, keys).withColumn(name, F.col("__start") + F.col("__turned")).drop("__start", "__turned")


def gap_clusters(df: DataFrame, keys: list[str], order: str, gap: float, name: str, size: int = RANGE) -> DataFrame:
    """The number of each row's cluster, from 0: a new one begins where the order column is more than ``gap`` beyond the row before."""
    return running_steps(df, keys, order, lambda a, b: (b - a > gap).cast("long"), order, name, size)


def sign_flips(df: DataFrame, keys: list[str], order: str, quaternion: str, name: str, size: int = RANGE) -> DataFrame:
    """1 or -1 for each quaternion, so that neighbours multiplied by it are within a right angle of each other."""
    turned = lambda a, b: (sum((a[n] * b[n] for n in "yzw"), a["x"] * b["x"]) < 0).cast("long")
    flips = running_steps(df, keys, order, turned, quaternion, "__flips", size)
    return flips.withColumn(name, F.when(F.col("__flips") % 2 == 0, 1).otherwise(-1)).drop("__flips")


def longest_runs(df: DataFrame, keys: list[str], order: str, flag: Column, name: str, size: int = RANGE) -> DataFrame:
    """``(*keys, name)``: the greatest number of rows in succession for which the flag holds (null doesn't), 0 if it never does.

    Within a range runs are counted by a window. Of a range there remain the longest run inside and the pieces at its ends (one piece where all rows hold); pieces that touch
    across ranges are added up along the series.
    """
    cut = df.select(*keys, order, F.floor(F.col(order) / size).alias("__range"), F.coalesce(flag, F.lit(False)).alias("__on"))
    inside = Window.partitionBy(*keys, "__range").orderBy(order)
    off = F.sum(F.when(F.col("__on"), 0).otherwise(1)).over(inside)
    islands = cut.withColumn("__off", off).groupBy(*keys, "__range", "__off").agg(F.count_if("__on").alias("__n"))
    each = Window.partitionBy(*keys, "__range")
    marked = islands.withColumns({"__tail": F.col("__off") == F.max("__off").over(each), "__head": F.col("__off") == 0})  # rows before the first off row, and after the last
    whole = marked.groupBy(*keys, "__range").agg(
        F.max("__n").alias("__best"), F.coalesce(F.max(F.when(F.col("__head"), F.col("__n"))), F.lit(0)).alias("__start"), F.max(F.when(F.col("__tail"), F.col("__n"))).alias("__end"), (F.max("__off") == 0).alias("__all"),
    )
    piece = lambda place, n, back, on: F.struct(F.lit(place).alias("place"), n.alias("n"), F.lit(back).alias("back"), F.lit(on).alias("on"))
    one = F.array(piece(0, F.col("__start"), True, True))
    two = F.array(piece(0, F.col("__start"), True, False), piece(1, F.col("__end"), False, True))
    pieces = whole.select(*keys, "__range", "__best", F.inline(F.when(F.col("__all"), one).otherwise(two)))
    along = Window.partitionBy(*keys).orderBy("__range", "place")
    fresh = ~(F.col("back") & F.coalesce(F.lag("on").over(along), F.lit(False)))
    chains = pieces.withColumn("__chain", F.sum(fresh.cast("int")).over(along)).groupBy(*keys, "__chain").agg(F.sum("n").alias("__sum"), F.max("__best").alias("__best"))
    return chains.groupBy(*keys).agg(F.greatest(F.max("__sum"), F.max("__best")).cast("long").alias(name))
