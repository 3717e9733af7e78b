"""Composite operators on frame tables: quaternion series, height offsets, keyframe offsets, clip evaluation, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridelake.functions import rotations as R
from stridelake.operators import series as S
from stridelake.operators import stats as A


def canonical_signs(df: DataFrame, keys: list[str], q: str = "q", frame: str = "frame") -> DataFrame:
    """Flips quaternions so that neighbours have no negative dot product; recursion on the output is the parity of a running count."""
    w = S.over(keys, frame)
    flips = (R.dot(F.lag(q).over(w), F.col(q)) < 0).cast("int")
    out = df.withColumn("__flip", F.coalesce(flips, F.lit(0)))
    sign = F.when(F.sum("__flip").over(w.rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1, -1.0).otherwise(1.0)
    return out.withColumn("__s", sign).withColumn(q, R.each(lambda c: c * F.col("__s"), F.col(q))).drop("__flip", "__s")


def angular_velocity(df: DataFrame, keys: list[str], fps: float, q: str = "q", frame: str = "frame") -> DataFrame:
    """Adds ``omega`` in radians per second: the turn over two frames inside, over one at the ends."""
    w = S.over(keys, frame)
    before, after = F.coalesce(F.lag(q).over(w), F.col(q)), F.coalesce(F.lead(q).over(w), F.col(q))
    spans = F.when(F.lag(q).over(w).isNull() | F.lead(q).over(w).isNull(), 1.0).otherwise(2.0)
    out = df.withColumns({"__b": before, "__a": after, "__n": spans})
    turn = R.rotation_vector(R.product(F.col("__a"), R.conjugate(F.col("__b"))))
    return out.withColumn("omega", R.each(lambda c: c * fps / F.col("__n"), turn, names="xyz")).drop("__b", "__a", "__n")


def slerp_resampled(df: DataFrame, keys: list[str], source_fps: float, target_fps: float, q: str = "q", frame: str = "frame") -> DataFrame:
    """Rotations at another rate: ``round(n * target / source)`` frames, the shorter arc between neighbours."""
    w, n = S.over(keys, frame), F.count("*").over(Window.partitionBy(*keys))
    out = df.withColumns({"__next": F.coalesce(F.lead(q).over(w), F.col(q)), "__last": n - 1, "__m": F.floor(n * target_fps / source_fps + 0.5).cast("long")})
    ratio = source_fps / target_fps
    lo = F.ceil(F.col(frame) / ratio - 1e-9)
    hi = F.when(F.col(frame) == F.col("__last"), F.col("__m") - 1).otherwise(F.least(F.col("__m") - 1, F.ceil((F.col(frame) + 1) / ratio - 1e-9) - 1))
    out = out.where(lo <= hi).withColumn("target_frame", F.explode(F.sequence(lo, hi)))
    return out.select(*keys, "target_frame", R.slerp(F.col(q), F.col("__next"), F.col("target_frame") * ratio - F.col(frame)).alias(q))


def sampled_poses(frames: DataFrame, times: DataFrame, key: str, fps: float, joints: list[str]) -> DataFrame:
    """The pose at each of ``times(key, at, ...)`` in seconds: root places and joints mixed linearly, root turns along the shorter arc.

    ``frames(key, frame, p, q, <joints>)``. Times are clamped to the motion; each looks up the frame before it, which holds the next one's values, by an equal key.
    """
    w = S.over([key])
    whole = Window.partitionBy(key)
    after = {c: F.coalesce(F.lead(c).over(w), F.col(c)) for c in ("p", "q", *joints)}
    held = frames.withColumns({f"__{c}": x for c, x in after.items()}).withColumn("__n", F.count("*").over(whole))
    counts = frames.groupBy(key).agg(F.count("*").alias("__n"))
    asked = times.join(counts, key).withColumn("__f", R.time_to_frame(F.col("at"), fps, F.col("__n"))).drop("__n")
    rows = asked.withColumns({"frame": F.col("__f.frame"), "__u": F.col("__f.blend")}).drop("__f").join(held.drop("__n"), [key, "frame"])
    exact = F.col("__u") < 1e-5
    mixed = lambda c: F.when(exact, F.col(c)).otherwise(F.col(c) * (1 - F.col("__u")) + F.col(f"__{c}") * F.col("__u"))
    place = F.when(exact, F.col("p")).otherwise(R.lerp(F.col("p"), F.col("__p"), F.col("__u")))
    turn = F.when(exact, F.col("q")).otherwise(R.slerp(F.col("q"), F.col("__q"), F.col("__u")))
    return rows.select(*times.columns, place.alias("p"), turn.alias("q"), *[mixed(c).alias(c) for c in joints])


def height_offsets(feet: DataFrame, key: str, fps: float, low: float = 0.04, gap: float = 0.02, clearance: float = 0.001, slow: float = 0.2, review: float = 0.02) -> DataFrame:
    """Vertical offset per motion from ``feet(key, frame, left, right)``, the bottoms of both feet: from double stance, else from any support, else from the lowest point.

    Support is low and slow, or the lowest fifth where that gives too few frames. ``review`` marks offsets that leave a foot deeper than ``review`` below the floor.
    """
    w, whole = S.over([key]), Window.partitionBy(key)
    out = feet
    for side in ("left", "right"):
        speed = F.abs(F.coalesce(F.col(side) - F.lag(side).over(w), F.lead(side).over(w) - F.col(side), F.lit(0.0))) * fps
        out = out.withColumn(f"__{side}", (F.col(side) <= low) & (speed <= slow))
        hits = F.sum(F.col(f"__{side}").cast("long")).over(whole)
        fallback = F.col(side) <= F.percentile(side, F.lit(0.2)).over(whole)
        out = out.withColumn(f"__{side}", F.when(hits >= F.greatest(F.lit(5.0), 0.005 * F.count("*").over(whole)), F.col(f"__{side}")).otherwise(fallback))
    bottom = F.least("left", "right")
    double = F.col("__left") & F.col("__right") & (F.greatest("left", "right") <= low) & (F.abs(F.col("left") - F.col("right")) <= gap)
    found = out.groupBy(key).agg(
        F.percentile(F.when(double, bottom), F.lit(0.5)).alias("stance"), F.percentile(F.when(F.col("__left") | F.col("__right"), bottom), F.lit(0.5)).alias("support"), F.min(bottom).alias("lowest")
    )
    offset = F.coalesce(clearance - F.col("stance"), clearance - F.col("support"), -F.col("lowest"))
    method = F.when(F.col("stance").isNotNull(), "double_stance").when(F.col("support").isNotNull(), "support").otherwise("strict_min")
    return found.select(key, offset.alias("offset"), method.alias("method"), (-(F.col("lowest") + offset) > review).alias("review"))


def stance_offsets(
    feet: DataFrame, key: str, fps: float, nominal: float, clearance: float = 0.001, flat: float = 0.05, gap: float = 0.02, slow: float = 0.2,
    least: float = 0.5, least_share: float = 0.01, penetration: float = 0.02, spread: float = 0.02,
) -> DataFrame:
    """Vertical offset per motion from the frames where both feet probably stand: the weighted 95th percentile of ``clearance`` less the mean of both bottoms.

    ``feet(key, frame, left, right, left_thickness, right_thickness, lx, ly, lz, rx, ry, rz)``: bottoms, heights and centres of both feet. Confidence falls with thickness beyond
    ``nominal``, with the gap of the bottoms and with the faster foot's speed; candidates have ``least`` or more (the best few frames if none has), weigh its
    square, and are a report's reason if too few, as are feet left too deep, candidates left too far from the floor, and no confident frame. One window
    sort and a few aggregations per motion.
    """
    w, whole = S.over([key]), Window.partitionBy(key)
    moved = lambda p, f: F.sqrt(sum(((F.col(f"{p}{a}") - f(F.col(f"{p}{a}"))) ** 2 for a in "yz"), (F.col(f"{p}x") - f(F.col(f"{p}x"))) ** 2))
    speed = lambda p: F.coalesce(moved(p, lambda c: F.lag(c).over(w)), moved(p, lambda c: F.lead(c).over(w)), F.lit(0.0)) * fps
    excess = F.greatest(F.lit(0.0), F.col("left_thickness") - nominal) + F.greatest(F.lit(0.0), F.col("right_thickness") - nominal)
    rows = feet.withColumns({"__speed": F.greatest(speed("l"), speed("r")), "__gap": F.abs(F.col("left") - F.col("right")), "__mean": (F.col("left") + F.col("right")) / 2, "__low": F.least("left", "right")})
    rows = rows.withColumn("__conf", R.stance_confidence(excess, F.col("__gap"), F.col("__speed"), (flat, gap, slow)))
    n, best = F.count("*").over(whole), F.max("__conf").over(whole)
    few = F.greatest(F.lit(1), F.least(F.lit(10), F.floor(n / 50)))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__conf"), F.desc("frame")))
    rows = rows.withColumns({"__n": n, "__best": best, "__rank": rank, "__few": few})
    rows = rows.withColumn("__cand", F.when(F.col("__best") >= least, F.col("__conf") >= least).otherwise(F.col("__rank") <= F.col("__few")))
    held = rows.where("__cand").withColumns({"__offset": clearance - F.col("__mean"), "__weight": F.greatest("__conf", F.lit(1e-6)) ** 2})
    p95 = A.weighted_quantile(held, [key], "__offset", "__weight", 0.95, "offset", small=True)
    after = held.join(p95, key).withColumn("__after", F.col("__mean") + F.col("offset")).withColumn("__far", F.abs("__after"))
    far = A.weighted_quantile(after, [key], "__far", "__weight", 0.95, "stance_p95", small=True)
    told = after.groupBy(key).agg(F.count("*").alias("candidates"), A.weighted_mean(F.col("__offset"), F.col("__weight")).alias("mean_offset"), F.percentile("__after", F.lit(0.5)).alias("stance_p50"))
    first = lambda order: F.min_by("frame", F.struct(order, "frame"))
    frames = rows.groupBy(key).agg(F.count("*").alias("num_frames"), F.max("__conf").alias("confidence"), first(-F.col("__conf")).alias("best_frame"), F.min("__low").alias("lowest"), first(F.col("__low")).alias("low_frame"))
    out = frames.join(p95, key).join(told, key).join(far, key)
    checks = {
        "few_high_confidence_double_support_candidates": F.col("candidates") / F.col("num_frames") < least_share, "nonstance_global_penetration": F.col("lowest") + F.col("offset") < -penetration,
        "stance_pair_mean_abs_p95": F.col("stance_p95") > spread, "no_candidate_above_confidence_threshold": F.col("confidence") < least,
    }
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]))
    review = F.when(checks["nonstance_global_penetration"], F.col("low_frame")).otherwise(F.col("best_frame"))
    return out.select(
        key, "num_frames", "best_frame", "confidence", review.alias("review_frame"), (-F.col("lowest")).alias("strict_offset"), "mean_offset", "offset", "candidates", "stance_p50", "stance_p95",
        (F.col("lowest") + F.col("offset")).alias("lowest_after"), F.when(F.size(reasons) == 0, "ok").otherwise("review").alias("status"), F.array_join(reasons, ";").alias("reasons"),
    )


def keyframe_offsets(target: DataFrame, body: DataFrame, keys: list[str]) -> DataFrame:
    """Distance of bodies from their targets, per motion: count, mean, largest, and the frame and body of the largest."""
    joined = target.join(body, [*keys, "frame", "body"])
    gap = F.sqrt(sum(((F.col(f"t{a}") - F.col(f"b{a}")) ** 2 for a in "yz"), (F.col("tx") - F.col("bx")) ** 2))
    found = joined.withColumn("__d", gap)
    worst = F.min_by(F.struct("frame", "body"), F.struct(-F.col("__d"), "frame", "body"))
    return found.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("__d").alias("mean"), F.max("__d").alias("largest"), worst.alias("w")).select(*keys, "n", "mean", "largest", "w.frame", "w.body")


def clip_status(samples: DataFrame, key: str, position: tuple[float, float] = (0.25, 0.5), rotation: tuple[float, float] = (45.0, 90.0), stop: bool = True) -> DataFrame:
    """Status of each clip from ``samples(key, frame, joint, position_error, rotation_error)``: the first frame past a failure limit, else past a warning limit.

    With ``stop`` the statistics end at the first failing frame.
    """
    bad = lambda i: (F.col("position_error") > position[i]) | (F.col("rotation_error") > rotation[i])
    whole = Window.partitionBy(key)
    rows = samples.withColumn("__fail", F.min(F.when(bad(1), F.col("frame"))).over(whole))
    seen = rows.where(F.col("__fail").isNull() | (F.col("frame") <= F.col("__fail"))) if stop else rows
    found = seen.groupBy(key).agg(
        F.max("__fail").alias("failed"), F.min(F.when(bad(0), F.col("frame"))).alias("warned"), F.count("*").alias("samples"), F.max("position_error").alias("max_position"), F.max("rotation_error").alias("max_rotation")
    )
    status = F.when(F.col("failed").isNotNull(), "failed").when(F.col("warned").isNotNull(), "warning").otherwise("succeeded")
    return found.select(key, status.alias("status"), F.coalesce("failed", "warned").alias("first_frame"), "samples", "max_position", "max_rotation")


def judged(samples: DataFrame, weights: DataFrame, joints: tuple[str, ...], turned_only: tuple[str, ...] = ()) -> DataFrame:
    """The samples that an evaluation judges: of the named joints whose ``weights(joint, weight)`` is above 0; of ``turned_only`` joints the rotation alone counts."""
    heavy = weights.where(F.col("weight") > 0).select("joint")
    rows = samples.where(F.col("joint").isin(*joints, *turned_only)).join(F.broadcast(heavy), "joint", "left_semi")
    return rows.withColumn("position_error", F.when(F.col("joint").isin(*turned_only), F.lit(0.0)).otherwise(F.col("position_error"))) if turned_only else rows


def tables_agree(left: DataFrame, right: DataFrame, keys: list[str], values: dict[str, float]) -> DataFrame:
    """Largest absolute difference of each value column over all keys, whether it is within its tolerance, and the keys that one side lacks."""
    marked = left.withColumn("__l", F.lit(1)).join(right.select(*keys, *[F.col(v).alias(f"__r_{v}") for v in values], F.lit(1).alias("__r")), keys, "full")
    gaps = [F.coalesce(F.max(F.abs(F.col(v) - F.col(f"__r_{v}"))), F.lit(0.0)).alias(v) for v in values]
    one = marked.agg(F.count_if(F.col("__l").isNull() | F.col("__r").isNull()).alias("unmatched"), *gaps)
    pairs = F.array(*[F.struct(F.lit(v).alias("column"), F.col(v).alias("largest"), (F.col(v) <= t).alias("within")) for v, t in values.items()])
    return one.select("unmatched", F.inline(pairs))
