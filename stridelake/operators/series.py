"""Window operators on time series: one partition per series, ordered by frame.

Boundary conventions differ and are named: *shortened* has no row for the missing neighbour, *zero* pads the first element with 0,
*copy* repeats the first difference, *central* takes one-sided differences of second order at both ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from stridelake.functions.angles import wrap_degrees
from stridelake.storage import written


def over(keys: list[str], frame: str = "frame") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(frame)


def wrapped_steps(df: DataFrame, keys: list[str], value: str = "q", frame: str = "frame") -> DataFrame:
    """Adds ``frame0`` and ``dq``, the wrapped step from the row before (frame0) to this one; shortened: the first row of a series goes."""
    w = over(keys, frame)
    out = df.withColumns({"frame0": F.lag(frame).over(w), "dq": wrap_degrees(F.col(value) - F.lag(value).over(w))})
    return out.where(F.col("dq").isNotNull())


def zero_padded_steps(df: DataFrame, keys: list[str], value: str = "q", frame: str = "frame") -> DataFrame:
    """Adds ``dq``, 0 on the first row of a series."""
    return df.withColumn("dq", F.coalesce(wrap_degrees(F.col(value) - F.lag(value).over(over(keys, frame))), F.lit(0.0)))


def motion_derivatives(df: DataFrame, keys: list[str], fps: float, value: str = "dq", frame: str = "frame") -> DataFrame:
    """Adds velocity, acceleration and jerk of a step column: ``vel = dq * fps``, then zero padded differences times fps; one sort for all."""
    w = over(keys, frame)
    out = df.withColumn("vel", F.col(value) * fps)
    out = out.withColumn("acc", F.coalesce((F.col("vel") - F.lag("vel").over(w)) * fps, F.lit(0.0)))
    return out.withColumn("jerk", F.coalesce((F.col("acc") - F.lag("acc").over(w)) * fps, F.lit(0.0)))


def plain_derivatives(df: DataFrame, keys: list[str], fps: float, value: str = "q", frame: str = "frame") -> DataFrame:
    """Without wrapping: ``vel`` and ``acc`` padded with zeros at the first row, and ``short_vel``, ``short_acc`` that are null where a row before lacks."""
    w = over(keys, frame)
    out = df.withColumn("short_vel", (F.col(value) - F.lag(value).over(w)) * fps)
    out = out.withColumns({"short_acc": (F.col("short_vel") - F.lag("short_vel").over(w)) * fps, "vel": F.coalesce("short_vel", F.lit(0.0))})
    return out.withColumn("acc", F.coalesce((F.col("vel") - F.lag("vel").over(w)) * fps, F.lit(0.0)))


def central_gradient(df: DataFrame, keys: list[str], dt: float, value: str = "q", frame: str = "frame") -> DataFrame:
    """Adds ``grad``: central differences, second order one-sided ones at the ends, first order for two rows, 0 for one."""
    w = over(keys, frame)

    def at(k: int) -> Column:
        return F.lead(value, k).over(w) if k >= 0 else F.lag(value, -k).over(w)

    x, before, after = F.col(value), at(-1), at(1)
    first = F.when(at(2).isNotNull(), (-3 * x + 4 * after - at(2)) / (2 * dt)).otherwise((after - x) / dt)
    last = F.when(at(-2).isNotNull(), (3 * x - 4 * before + at(-2)) / (2 * dt)).otherwise((x - before) / dt)
    inner = (after - before) / (2 * dt)
    return df.withColumn("grad", F.coalesce(F.when(before.isNull(), first).when(after.isNull(), last).otherwise(inner), F.lit(0.0)))


def copied_speed(df: DataFrame, keys: list[str], fps: float, value: str = "q", frame: str = "frame") -> DataFrame:
    """Adds ``speed``, the absolute step per second; the first row has the second one's."""
    w = over(keys, frame)
    step = F.coalesce(F.col(value) - F.lag(value).over(w), F.lead(value).over(w) - F.col(value), F.lit(0.0))
    return df.withColumn("speed", F.abs(step) * fps)


def k_frame_delta(df: DataFrame, keys: list[str], k: int, value: str = "q", frame: str = "frame") -> DataFrame:
    """Adds ``delta``, the wrapped change from a frame to the k-th after it, on rows that have one."""
    out = df.withColumn("delta", wrap_degrees(F.lead(value, k).over(over(keys, frame)) - F.col(value)))
    return out.where(F.col("delta").isNotNull())


def neighbour_stats(df: DataFrame, keys: list[str], radius: int, value: str = "dq", frame: str = "frame") -> DataFrame:
    """Adds ``near_max`` and ``near_median`` of the absolute values up to ``radius`` rows before and after, without the row; 0 if there are none."""
    w = over(keys, frame)
    near = F.concat(*(F.collect_list(F.abs(F.col(value))).over(w.rowsBetween(lo, hi)) for lo, hi in ((-radius, -1), (1, radius))))
    ordered, n = F.array_sort(near), F.size(near)
    middle = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    return df.withColumns({"near_max": F.coalesce(F.array_max(near), F.lit(0.0)), "near_median": F.coalesce(middle, F.lit(0.0))})


def dynamic_support(df: DataFrame, keys: list[str], radius: int, least: float = 2.0, share: float = 0.45, value: str = "dq", frame: str = "frame") -> DataFrame:
    """Adds ``support``: neighbours with the row's sign and at least ``max(least, share * |row|)``; 0 where the row is 0."""
    w, x = over(keys, frame), F.col(value)
    near = F.concat(*(F.collect_list(x).over(w.rowsBetween(lo, hi)) for lo, hi in ((-radius, -1), (1, radius))))
    enough = F.greatest(F.lit(least), share * F.abs(x))
    return df.withColumn("support", F.size(F.filter(near, lambda y: (F.abs(y) >= enough) & (F.signum(y) == F.signum(x)) & (x != 0))).cast("long"))


def local_max(df: DataFrame, keys: list[str], radius: int, value: str, frame: str = "frame", name: str = "local_max") -> DataFrame:
    return df.withColumn(name, F.max(value).over(over(keys, frame).rowsBetween(-radius, radius)))


def longest_runs(df: DataFrame, keys: list[str], thresholds: list[float], value: str, fps: float, frame: str = "frame") -> DataFrame:
    """Per series and threshold: the longest run of consecutive rows at or above it, how many rows are, and the run's seconds (one shuffle)."""
    w = over(keys, frame)
    rows = df.withColumn("__n", F.row_number().over(w)).select(*keys, "__n", value, F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    hit = rows.withColumn("__hit", F.col(value) >= F.col("threshold"))
    by = Window.partitionBy(*keys, "threshold").orderBy("__n")
    grouped = hit.withColumn("__run", F.col("__n") - F.sum(F.col("__hit").cast("long")).over(by))
    sized = grouped.where("__hit").groupBy(*keys, "threshold", "__run").agg(F.count("*").alias("__len"))
    sums = sized.groupBy(*keys, "threshold").agg(F.max("__len").alias("longest"), F.sum("__len").alias("hits"))
    return sums.withColumn("seconds", F.col("longest") / fps)


def unwrapped(df: DataFrame, keys: list[str], value: str = "q", frame: str = "frame") -> DataFrame:
    """Adds ``unwrapped``: the first value plus the running sum of wrapped steps."""
    w = over(keys, frame)
    step = F.coalesce(wrap_degrees(F.col(value) - F.lag(value).over(w)), F.lit(0.0))
    out = df.withColumn("__step", step)
    return out.withColumn("unwrapped", F.first(value).over(w) + F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def same_convolution_all(df: DataFrame, keys: list[str], window: int, flag: str, frame: str = "frame") -> DataFrame:
    """Per series the share of rows whose centred window of ``window`` rows (numpy's alignment for even ones) is flagged throughout; the plain share if the series is shorter."""
    w = over(keys, frame)
    held = F.sum(F.col(flag).cast("double")).over(w.rowsBetween(-(window // 2), window - window // 2 - 1))
    n = F.count("*").over(Window.partitionBy(*keys))
    full = F.when(n >= window, (held >= window - 0.1).cast("double")).otherwise(F.col(flag).cast("double"))
    return df.withColumn("__full", full).groupBy(*keys).agg(F.avg("__full").alias("ratio"))


def rank01(df: DataFrame, order: list[Column], name: str = "rank01") -> DataFrame:
    """Adds (row number - 1) / (n - 1) in a total order; 0 for a single row.

    Row numbers of a whole table are made without moving it to one task: ranges of the sort key are numbered apart and shifted by the
    sizes of those before, of which there are as many as partitions.
    """
    ranged = written(df.withColumn("__key", F.struct(*order)).repartitionByRange("__key").withColumn("__part", F.spark_partition_id()))
    numbered = ranged.withColumn("__i", F.row_number().over(Window.partitionBy("__part").orderBy("__key")))
    sizes = numbered.groupBy("__part").agg(F.count("*").alias("__size"))
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifted = sizes.select("__part", F.coalesce(F.sum("__size").over(w), F.lit(0)).alias("__before"), F.sum("__size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__n"))
    at = (F.col("__before") + F.col("__i") - 1) / F.greatest(F.col("__n") - 1, F.lit(1))
    return numbered.join(shifted, "__part").withColumn(name, at).drop("__key", "__part", "__i", "__before", "__n")


def resampled(df: DataFrame, keys: list[str], values: list[str], source_fps: float, target_fps: float, frame: str = "frame") -> DataFrame:
    """Linear resampling: ``round(n * target / source)`` frames, times clamped to the last one. Frames must count up from 0.

    Every source row makes the target frames that fall between it and the next, so no join is needed.
    """
    w = over(keys, frame)
    n = F.count("*").over(Window.partitionBy(*keys))
    out = df.withColumn("__m", F.floor(n * target_fps / source_fps + 0.5).cast("long")).withColumn("__last", n - 1)
    for v in values:
        out = out.withColumn(f"__next_{v}", F.coalesce(F.lead(v).over(w), F.col(v)))
    ratio = source_fps / target_fps
    lo = F.ceil(F.col(frame) / ratio - 1e-9)
    hi = F.when(F.col(frame) == F.col("__last"), F.col("__m") - 1).otherwise(F.least(F.col("__m") - 1, F.ceil((F.col(frame) + 1) / ratio - 1e-9) - 1))
    out = out.where(lo <= hi).withColumn("target_frame", F.explode(F.sequence(lo, hi)))
    u = F.least(F.greatest(F.col("target_frame") * ratio - F.col(frame), F.lit(0.0)), F.lit(1.0))
    return out.select(*keys, "target_frame", *[(F.col(v) + (F.col(f"__next_{v}") - F.col(v)) * u).alias(v) for v in values])


def as_of(df: DataFrame, times: DataFrame, keys: list[str], frame: str = "frame", at: str = "at") -> DataFrame:
    """Each row of ``times`` with the last row of ``df`` at or before it, by one shuffle of both and a running last value; nulls where there is none."""
    own = [c for c in df.columns if c not in keys and c != frame]
    left = df.select(*keys, F.col(frame).cast("double").alias("__t"), F.lit(0).alias("__asked"), F.struct(F.col(frame).alias("found_frame"), *own).alias("__row"), *[F.lit(None).cast(dict(times.dtypes)[c]).alias(c) for c in times.columns if c not in keys])
    right = times.select(*keys, F.col(at).cast("double").alias("__t"), F.lit(1).alias("__asked"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), *[c for c in times.columns if c not in keys])
    w = Window.partitionBy(*keys).orderBy("__t", "__asked").rowsBetween(Window.unboundedPreceding, 0)
    found = left.unionByName(right).withColumn("__row", F.last("__row", ignorenulls=True).over(w)).where("__asked = 1")
    return found.select(*keys, *[c for c in times.columns if c not in keys], "__row.*")
