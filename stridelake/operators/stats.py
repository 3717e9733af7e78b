"""Aggregates: skipping statistics, mergeable moments, histogram and weighted quantiles, retention."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelake.functions.angles import finite
from stridelake.functions.rotations import let
from stridelake.operators import series as S
from stridelake.storage import written


def kept(x: Column) -> Column:
    """The value where it is finite, else null, which aggregates skip (they do not skip NaN)."""
    return F.when(finite(x), x)


def or_zero(aggregate: Column) -> Column:
    return F.coalesce(aggregate, F.lit(0.0))


def finite_stats(x: Column, prefix: str, quantiles: tuple[float, ...] = (0.05, 0.5, 0.95)) -> list[Column]:
    """Mean, population spread, extremes, range and exact quantiles over finite values; 0 if there are none."""
    v = kept(x)
    out = [("mean", F.avg(v)), ("std", F.stddev_pop(v)), ("max", F.max(v)), ("min", F.min(v)), ("range", F.max(v) - F.min(v))]
    out += [(f"p{round(q * 100):02d}", F.percentile(v, F.lit(q))) for q in quantiles]
    return [or_zero(a).alias(f"{prefix}_{name}") for name, a in out]


def finite_stats_of(df: DataFrame, keys: list[str], value: str, prefix: str, quantiles: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """:func:`finite_stats` of each key at any number of rows of a key: its values are neither gathered nor ordered in one task."""
    sums = df.groupBy(*keys).agg(*finite_stats(F.col(value), prefix, ()))
    found = exact_quantiles(df, keys, value, list(quantiles), "__q").select(*[F.col(k).alias(f"__{k}") for k in keys], "__q")
    joined = sums.join(found, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left")
    return joined.select(*sums.columns, *[or_zero(F.col("__q")[j]).alias(f"{prefix}_p{round(q * 100):02d}") for j, q in enumerate(quantiles)])


def _fused(a: Column, b: Column, c: Column) -> Column:
    """a b + c rounded once: the product's rounding error is found by splitting both factors, the sum's by taking it apart again."""

    def halves(x: Column) -> tuple[Column, Column]:
        high = 134217729.0 * x - (134217729.0 * x - x)
        return high, x - high

    (ah, al), (bh, bl) = halves(a), halves(b)
    p, t = a * b, a * b + c
    lost = ((ah * bh - p) + ah * bl + al * bh) + al * bl
    return t + (lost + ((p - (t - (t - p))) + (c - (t - p))))


def percentile(x: Column, q: float) -> Column:
    """The interpolated quantile of a group to the last bit of DuckDB's ``quantile_cont``, for comparisons with values that may equal it. ``F.percentile`` rounds otherwise.

    A group's values are held sorted, as ``F.percentile`` holds its distinct ones; null if there are none.
    """
    return interpolated(F.array_sort(F.collect_list(x.cast("double"))), F.count(x), q)


def interpolated(values: Column, n: Column, q: float) -> Column:
    """:func:`percentile` of an ascending array of ``n`` values."""
    at = let(lambda v, i: F.struct(F.get(v, F.floor(i).cast("int")).alias("lo"), F.get(v, F.ceil(i).cast("int")).alias("hi"), (i - F.floor(i)).alias("d")), v=values, i=(n - 1) * F.lit(q))
    mixed = lambda lo, hi, d: F.when(d == 0, lo).when(F.abs(lo) + F.abs(hi) < 1e290, _fused(lo, 1 - d, hi * d)).otherwise(lo * (1 - d) + hi * d)
    return let(lambda a: mixed(a["lo"], a["hi"], a["d"]), a=at)


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r from sums; 0 for fewer than 3 pairs or a constant side, where the built-in raises."""
    both = finite(x) & finite(y)
    a, b = F.when(both, x), F.when(both, y)
    n = F.count(a)
    cov = F.sum(a * b) - F.try_divide(F.sum(a) * F.sum(b), n)
    va, vb = (F.greatest(F.sum(v * v) - F.try_divide(F.sum(v) * F.sum(v), n), F.lit(0.0)) for v in (a, b))
    scale = F.sqrt(va) * F.sqrt(vb)
    return F.when((n < 3) | (scale < 1e-12), F.lit(0.0)).otherwise(or_zero(F.try_divide(cov, scale)))


def welford(x: Column) -> list[Column]:
    """Count, mean, spread, extremes and the confidence bounds of the mean; partial and final aggregates merge as moments."""
    mean, n = F.avg(x), F.count(x)
    error = F.coalesce(F.stddev_samp(x), F.lit(0.0)) / F.sqrt(n)
    named = {"count": n, "mean": mean, "var": F.coalesce(F.var_samp(x), F.lit(0.0)), "min": F.min(x), "max": F.max(x)}
    for level, z in (("c95", 1.96), ("c99", 2.576)):
        named |= {f"{level}_low": mean - z * error, f"{level}_high": mean + z * error}
    return [c.alias(k) for k, c in named.items()]


def histogram_quantiles(df: DataFrame, keys: list[str], value: str, width: float, bins: int, quantiles: dict[str, float]) -> DataFrame:
    """Quantiles from a mergeable histogram: bins of ``width`` from 0, the last one open; the middle of the first bin whose cumulative count exceeds q (n - 1)."""
    bin_ = F.least(F.lit(bins - 1), F.floor(F.greatest(F.col(value), F.lit(0.0)) / width)).cast("long")
    counts = df.where(finite(F.col(value))).groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys)
    summed = counts.withColumns({"cum": F.sum("c").over(w.orderBy("bin")), "n": F.sum("c").over(w)})
    found = [F.min(F.when(F.col("cum") > q * (F.col("n") - 1), (F.col("bin") + 0.5) * width)).alias(k) for k, q in quantiles.items()]
    return summed.groupBy(*keys).agg(F.max("n").alias("n"), *found)


#: Ranges of values that a key's rows are cut into to find the one that holds a quantile.
CUTS = 256
#: Size of a sketch, what it may err in rank with room to spare (ten times its standard error), rows of a key that need no bracket, and rows of a bracket that one task orders.
SKETCH, ERROR, FEW, ORDERED = 1600, 0.02, 2000, 4_000_000


def _below(cuts: Column, value: Column, n: int) -> Column:
    """How many of the ascending cuts are less than the value, by halving."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda lo, step: F.when(F.get(cuts, lo + step - 1) < value, lo + step).otherwise(lo))


def _reached(per: DataFrame, goals: Column, known: DataFrame | None = None) -> DataFrame:
    """``(__k, i, value)`` from distinct values ``per(__k, value, amount)``: for each of ``goals``, an array of ``struct(i, goal, beyond)`` over ``total`` and the columns ``known`` has for a key,
    the least value whose cumulative amount reaches the goal (is beyond it, where that is asked for).

    A key's values are cut into ranges at approximate quantiles; sums of the ranges tell which one holds a goal, and only the rows of that
    range are ordered. So neither a key of all rows nor a value of a third of them is sorted in one task.
    """
    cuts = written(per.groupBy("__k").agg(F.percentile_approx("value", [i / CUTS for i in range(1, CUTS)], 20 * CUTS).alias("cuts"), F.sum("amount").alias("total")))
    keyed = per.join(cuts.select("__k", "cuts"), "__k")
    ranged = keyed.select("__k", "value", "amount", _below(F.col("cuts"), F.col("value"), CUTS).alias("bucket"))
    sums = ranged.groupBy("__k", "bucket").agg(F.sum("amount").alias("s"))
    upto = Window.partitionBy("__k").orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("s").over(upto)).withColumn("before", F.coalesce(F.lag("upto").over(upto), F.lit(0.0)))
    asked = (cuts if known is None else cuts.join(known, "__k")).select("__k", F.inline(goals))
    hit = lambda amount: F.when(F.col("beyond"), amount > F.col("goal")).otherwise(amount >= F.col("goal"))
    found = asked.join(sums, "__k").where(hit(F.col("upto"))).groupBy("__k", "i", "goal", "beyond").agg(F.min(F.struct("bucket", "before")).alias("b"))
    near = ranged.join(found.select("__k", "i", "goal", "beyond", "b.*"), ["__k", "bucket"])
    cumulative = F.col("before") + F.sum("amount").over(Window.partitionBy("__k", "i").orderBy("value"))
    return near.withColumn("cum", cumulative).where(hit(F.col("cum"))).groupBy("__k", "i").agg(F.min("value").alias("value"))


def _key(keys: list[str]) -> Column:
    """Keys as one struct, in which nulls are equal."""
    return F.struct(*[F.col(k) for k in keys], F.lit(0).alias("__one"))


def _distinct(df: DataFrame, keys: list[str], value: str, amount: Column) -> DataFrame:
    """Equal values are added up before anything is ordered."""
    return df.select(_key(keys).alias("__k"), F.col(value).cast("double").alias("value"), amount.cast("double").alias("amount")).groupBy("__k", "value").agg(F.sum("amount").alias("amount"))


def sketches(df: DataFrame, keys: list[str], value: str, size: int = SKETCH) -> DataFrame:
    """``(keys, sketch, n, least, most)``: a mergeable quantile sketch of the finite values of each key, to be stored and merged with others."""
    v = F.col(value).cast("double")
    return df.where(finite(v)).groupBy(*keys).agg(F.kll_sketch_agg_double(v, F.lit(size)).alias("sketch"), F.count("*").alias("n"), F.min(v).alias("least"), F.max(v).alias("most"))


def merged_sketches(stored: list[DataFrame], keys: list[str]) -> DataFrame:
    """The sketches of several runs as those of all their rows."""
    rows = reduce(DataFrame.unionByName, stored)
    return rows.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def sketched(found: DataFrame, keys: list[str], quantiles: list[float], name: str = "quantiles") -> DataFrame:
    """``(keys, n, <name>)``: approximate quantiles from sketches."""
    return found.select(*keys, "n", F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, quantiles))).alias(name))


def _bracketed(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    """``(__k, j, value, amount)``: distinct values inside the key's brackets ``b``, an array of ``struct(j, lo, hi)``, and, with a null value, how many are below each."""
    x = F.col("value")
    inside = F.transform(F.filter("b", lambda b: x <= b["hi"]), lambda b: F.struct(b["j"].alias("j"), F.when(x >= b["lo"], x).alias("value")))
    placed = rows.join(brackets, "__k").select("__k", inside.alias("b")).select("__k", F.inline("b"))
    return written(placed.groupBy("__k", "j", "value").agg(F.count("*").cast("double").alias("amount")))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: list[float], name: str = "quantiles") -> DataFrame:
    """``(keys, <name>)``: the linear quantiles of the finite values of each key as an array, at any number of rows of a key; keys without values are absent.

    Two passes over the rows. The first makes a sketch of each key, whose quantiles a little below and above those asked for are brackets. The second counts what is below each bracket and
    shuffles the distinct values inside it alone, some hundredths of all. If a count shows that a bracket missed its rank, that one is made anew from the whole range. A
    bracket's values are ordered in one task while they are few, else cut into ranges first.
    """
    rows = df.where(finite(F.col(value))).select(_key(keys).alias("__k"), F.col(value).cast("double").alias("value"))
    last = F.col("n") - 1
    places = {j: (F.floor(last * q), F.least(F.floor(last * q) + 1, last)) for j, q in enumerate(quantiles)}
    ends = [max(0.0, q - ERROR) for q in quantiles] + [min(1.0, q + ERROR) for q in quantiles]
    about = written(sketches(rows, ["__k"], "value").withColumn("e", F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, ends)))).drop("sketch"))
    few, m = F.col("n") <= FEW, len(quantiles)
    lo = lambda j, q: F.when(few | F.lit(q - ERROR <= 0), F.col("least")).otherwise(F.col("e")[j])
    hi = lambda j, q: F.when(few | F.lit(q + ERROR >= 1), F.col("most")).otherwise(F.col("e")[m + j])
    bracket = [F.struct(F.lit(j).alias("j"), lo(j, q).alias("lo"), hi(j, q).alias("hi")) for j, q in enumerate(quantiles)]
    inside = _bracketed(rows, about.select("__k", F.array(*bracket).alias("b")))

    def told(part: DataFrame) -> DataFrame:
        counts = part.groupBy("__k", "j").agg(F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("amount"))), F.lit(0.0)).alias("before"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("amount"))), F.lit(0.0)).alias("within"), F.count("value").alias("rows"))
        at = lambda i: F.get(F.array(*[places[j][i].cast("double") for j in range(m)]), F.col("j"))
        return counts.join(about.select("__k", "n", "least", "most"), "__k").withColumns({"low": at(0), "high": at(1)})

    counts = written(told(inside))
    missed = counts.where((F.col("before") > F.col("low")) | (F.col("before") + F.col("within") <= F.col("high")))
    if not missed.isEmpty():
        again = missed.groupBy("__k").agg(F.collect_list(F.struct("j", F.col("least").alias("lo"), F.col("most").alias("hi"))).alias("b"))
        inside = inside.join(missed.select("__k", "j"), ["__k", "j"], "left_anti").unionByName(_bracketed(rows, again))
        counts = written(told(inside))
    values = inside.where("value is not null")
    if (counts.agg(F.max("rows")).first()[0] or 0) > ORDERED:
        per = values.select(F.struct("__k", "j").alias("__k"), "value", "amount")
        goals = F.array(*[F.struct(F.lit(i).alias("i"), (F.col(c) - F.col("before")).alias("goal"), F.lit(True).alias("beyond")) for i, c in enumerate(("low", "high"))])
        found = _reached(written(per), goals, counts.select(F.struct("__k", "j").alias("__k"), "before", "low", "high"))
        pair = found.groupBy("__k").pivot("i", [0, 1]).agg(F.min("value")).select("__k.__k", "__k.j", F.col("0").alias("a"), F.col("1").alias("b"))
    else:
        running = values.join(counts.select("__k", "j", "before", "low", "high"), ["__k", "j"]).withColumn("cum", F.col("before") + F.sum("amount").over(Window.partitionBy("__k", "j").orderBy("value")))
        pair = running.groupBy("__k", "j").agg(*[F.min(F.when(F.col("cum") > F.col(c), F.col("value"))).alias(n) for n, c in (("a", "low"), ("b", "high"))])
    held = pair.groupBy("__k").agg(F.map_from_entries(F.collect_list(F.struct("j", F.struct("a", "b")))).alias("v")).join(about.select("__k", "n"), "__k")

    def at(j: int, q: float) -> Column:
        place = last * q
        part = place - F.floor(place)
        return F.when(part == 0, F.col("v")[j]["a"]).otherwise(F.col("v")[j]["a"] * (1 - part) + F.col("v")[j]["b"] * part)

    return held.select(*[F.col("__k")[k].alias(k) for k in keys], F.array(*[at(j, q) for j, q in enumerate(quantiles)]).alias(name))


def weighted_quantile(df: DataFrame, keys: list[str], value: str, weight: str, q: float, name: str, small: bool = False) -> DataFrame:
    """The least value whose cumulative weight reaches q of the total; the plain quantile where all weights are 0.

    ``small`` says that a key's rows fit into a task, as those of a series do: then one window over each key does it.
    """
    if small:
        w = Window.partitionBy(*keys)
        rows = df.select(*keys, F.col(value).cast("double").alias("__value"), F.col(weight).cast("double").alias("__w"))
        rows = rows.withColumns({"__cum": F.sum("__w").over(w.orderBy("__value")), "__total": F.sum("__w").over(w)})
        found = F.min(F.when((F.col("__total") > 0) & (F.col("__cum") >= F.col("__total") * q - 1e-12), F.col("__value")))
        plain = F.percentile(F.when(finite(F.col("__value")), F.col("__value")), F.lit(q))
        return rows.groupBy(*keys).agg(F.when(F.max("__total") > 0, found).otherwise(plain).alias(name))
    per = written(_distinct(df, keys, value, F.col(weight)))
    totals = written(per.groupBy("__k").agg(F.sum("amount").alias("all")))
    goal = F.struct(F.lit(0).alias("i"), (F.col("total") * q - 1e-12).alias("goal"), F.lit(False).alias("beyond"))
    light = totals.where("not coalesce(all > 0, false)").select("__k")
    if light.isEmpty():
        return _reached(per, F.array(goal)).select(*[F.col("__k")[k].alias(k) for k in keys], F.col("value").alias(name))
    found = _reached(per.join(light, "__k", "left_anti"), F.array(goal)).select(*[F.col("__k")[k].alias(k) for k in keys], F.col("value").alias(name))
    rest = df.withColumn("__k", _key(keys)).join(light, "__k", "left_semi")
    return found.unionByName(exact_quantiles(rest, keys, value, [q], name).select(*keys, F.col(name)[0].alias(name)))


def weighted_mean(x: Column, w: Column) -> Column:
    return F.try_divide(F.sum(x * w), F.sum(w))


def score(deductions: list[Column]) -> Column:
    """100 less the deductions, not below 0."""
    total = F.lit(0.0)
    for d in deductions:
        total = total + d
    return F.greatest(F.lit(0.0), 100.0 - total)


def geometric_mean(x: Column, least: float = 1e-12) -> Column:
    return F.pow(F.lit(10.0), F.avg(F.log10(F.greatest(x, F.lit(least)))))


def motion_extrema(df: DataFrame, keys: list[str], fps: float, value: str = "q", frame: str = "frame") -> DataFrame:
    """Largest absolute wrapped step, speed and acceleration of each series; 0 for fewer than two frames."""
    rows = S.motion_derivatives(S.zero_padded_steps(df, keys, value, frame), keys, fps, "dq", frame)
    w = S.over(keys, frame)
    rows = rows.withColumn("first", F.row_number().over(w) <= 2)
    largest = lambda c: F.coalesce(F.max(F.abs(c)), F.lit(0.0))
    return rows.groupBy(*keys).agg(largest(F.col("dq")).alias("max_dq"), largest(F.col("vel")).alias("max_vel"), largest(F.when(~F.col("first"), F.col("acc"))).alias("max_acc"))


def range_retention(before: DataFrame, after: DataFrame, features: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Per feature: seven quantiles and the mean before and after, the share of the whole, robust and middle range that stays, and what either tail loses of the robust range.

    Both tables become feature-value rows, so all features need one aggregation each; a range of nothing keeps all of itself.
    """
    points = {"min": 0.0, "low": low, "p05": 0.05, "p50": 0.5, "p95": 0.95, "high": high, "max": 1.0}

    def long(df: DataFrame, when: str) -> DataFrame:
        rows = df.select(*features).unpivot([], features, "feature", "x")
        found = exact_quantiles(rows, ["feature"], "x", list(points.values()), "q").join(rows.groupBy("feature").agg(F.avg(kept(F.col("x"))).alias(f"mean_{when}")), "feature")
        return found.select("feature", f"mean_{when}", *[F.col("q")[i].alias(f"{p}_{when}") for i, p in enumerate(points)])

    both = long(before, "before").join(long(after, "after"), "feature", "left")
    c = F.col
    span = lambda lo, hi, when: F.coalesce(c(f"{hi}_{when}") - c(f"{lo}_{when}"), F.lit(0.0))
    ratio = lambda lo, hi: F.when(span(lo, hi, "before") > 1e-9, span(lo, hi, "after") / span(lo, hi, "before")).otherwise(F.lit(1.0))
    tail = lambda x: F.when(span("low", "high", "before") > 1e-9, F.greatest(F.lit(0.0), x) / span("low", "high", "before")).otherwise(F.lit(0.0))
    return both.select(
        "*", ratio("min", "max").alias("retention"), ratio("low", "high").alias("robust_retention"), ratio("p05", "p95").alias("middle_retention"), (c("mean_after") - c("mean_before")).alias("mean_delta"),
        tail(c("low_after") - c("low_before")).alias("low_loss"), tail(c("high_before") - c("high_after")).alias("high_loss"),
    )


def retention_summary(ratio: Column) -> list[Column]:
    """Over features, ratios clamped to 1e-12 at least: geometric mean, mean, median, 5th percentile, least."""
    r = F.greatest(ratio, F.lit(1e-12))
    named = {"geomean": F.exp(F.avg(F.ln(r))), "mean": F.avg(r), "median": F.percentile(r, F.lit(0.5)), "p05": F.percentile(r, F.lit(0.05)), "least": F.min(r)}
    return [c.alias(k) for k, c in named.items()]


@dataclass(frozen=True)
class PhysicsRules:
    """Limits of the physics metrics in metres, seconds and degrees, the metrics' weights, and the score that passes."""

    least_frames: int = 5
    least_seconds: float = 0.5
    contact_height: float = 0.05
    slide_speed: float = 0.1
    clearance: float = 0.05
    margin: float = 0.01
    speed_limit: float = 600.0
    most_contacts: float = 10.0
    passing: float = 90.0
    weights: tuple[tuple[str, float], ...] = (
        ("foot_sliding", 1.0), ("velocity_violation", 500.0), ("self_collision", 1000.0), ("jerk", 0.1), ("penetration", 10.0), ("floating_frames_ratio", 200.0),
    )


def physics_metrics(joints: DataFrame, feet: DataFrame, contacts: DataFrame, key: str, fps: float, rules: PhysicsRules = PhysicsRules()) -> DataFrame:
    """Raw metrics of each motion from ``joints(key, frame, joint, q)`` in radians, ``feet(key, frame, bottom, speed)`` and ``contacts(key, frame, floor, dist)``.

    ``bottom`` is the lower foot's, ``speed`` the faster foot's, ``floor`` whether a contact is with the floor. Derivatives are padded with zeros. A frame floats if its floor contacts, or without
    any its bottom, are too high, and counts if a whole second around it does.
    """
    own = [key, "joint"]
    w = S.over(own)
    rows = S.plain_derivatives(joints, own, fps)
    rows = rows.withColumn("jerk", F.coalesce((F.col("acc") - F.lag("acc").over(w)) * fps, F.lit(0.0)))
    speed, limit = F.abs("vel"), F.radians(F.lit(rules.speed_limit))
    per_frame = rows.groupBy(key, "frame").agg(
        F.sum(F.greatest(F.lit(0.0), speed - limit)).alias("over"), F.count("*").alias("n"), F.sqrt(F.sum(F.col("jerk") ** 2)).alias("norm"), F.max(speed).alias("v"), F.max(F.abs("acc")).alias("a"), F.max(F.abs("jerk")).alias("j")
    )
    moving = per_frame.groupBy(key).agg(
        (F.sum("over") / F.sum("n")).alias("velocity_violation"), (0.01 * F.avg("norm")).alias("jerk"), *[F.degrees(F.max(c)).alias(n) for c, n in (("v", "max_joint_velocity"), ("a", "max_joint_acceleration"), ("j", "max_joint_jerk"))]
    )
    met = contacts.groupBy(key, "frame").agg(F.min(F.when(F.col("floor"), F.col("dist"))).alias("floor_dist"), F.count_if(~F.col("floor") & (F.col("dist") < 0)).alias("touching"))
    frames = feet.join(met, [key, "frame"], "left").fillna(0, ["touching"])
    low = F.col("floor_dist")
    frames = frames.withColumns({
        "slide": F.when(F.col("bottom") < rules.contact_height, F.greatest(F.lit(0.0), F.col("speed") - rules.slide_speed) * 5.0).otherwise(F.lit(0.0)),
        "deep": F.coalesce(F.greatest(F.lit(0.0), -low - rules.margin), F.lit(0.0)), "floats": F.coalesce(low, F.col("bottom")) > rules.clearance,
    })
    standing = frames.groupBy(key).agg(
        F.count("*").alias("num_frames"), F.avg("slide").alias("foot_sliding"), F.avg(F.least(F.col("touching").cast("double"), F.lit(rules.most_contacts))).alias("self_collision"), F.avg("deep").alias("penetration"), F.min("bottom").alias("min_foot_bottom")
    )
    floating = S.same_convolution_all(frames, [key], max(1, round(fps)), "floats").withColumnRenamed("ratio", "floating_frames_ratio")
    return standing.join(moving, key).join(floating, key)


def quality_score(metrics: DataFrame, fps: float, rules: PhysicsRules = PhysicsRules()) -> DataFrame:
    """Adds a deduction for each weighted metric, ``score`` and ``passed``; too short motions have the worst metrics and do not pass."""
    weights = dict(rules.weights)
    short = (F.col("num_frames") < rules.least_frames) | (F.col("num_frames") / fps < rules.least_seconds)
    worst = {m: 1.0 if m == "floating_frames_ratio" else 100.0 for m in weights}
    told = metrics.withColumn("is_too_short", short).withColumns({m: F.when(short, F.lit(worst[m])).otherwise(F.col(m)) for m in weights})
    told = told.withColumns({f"deduction_{m}": F.col(m) * x for m, x in weights.items()})
    return told.withColumn("score", score([F.col(f"deduction_{m}") for m in weights])).withColumn("passed", ~short & (F.col("score") >= rules.passing))
