"""The diversity features of motions: 153 numbers per motion from its root, its joints and the places of some bodies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelake.functions import names as N
from stridelake.functions.angles import wrap_degrees
from stridelake.operators import grouped as G
from stridelake.operators import series as S
from stridelake.operators import stats as A

BODIES = ("pelvis", "torso", "head", "left_foot", "right_foot", "left_wrist", "right_wrist")
SIDES = ("left", "right")


def _steps(df: DataFrame, keys: list[str], values: list[str], wrapped: bool) -> DataFrame:
    """Adds ``d_<value>``, the step from the row before, null at the first."""
    w = S.over(keys)
    step = lambda c: F.col(c) - F.lag(c).over(w)
    return df.withColumns({f"d_{c}": wrap_degrees(step(c)) if wrapped else step(c) for c in values})


def _span(x: Column) -> Column:
    return F.max(x) - F.min(x)


def _p95(x: Column) -> Column:
    return F.percentile(x, F.lit(0.95))


def root_features(root: DataFrame, key: str, fps: float) -> DataFrame:
    """``root(key, frame, x, y, z, roll, pitch, yaw)`` in metres and degrees: locomotion, heights and turns."""
    rows = _steps(_steps(root, [key], ["x", "y", "z"], False), [key], ["roll", "pitch", "yaw"], True)
    w = S.over([key])
    rows = rows.withColumn("step", F.sqrt(F.col("d_x") ** 2 + F.col("d_y") ** 2)).withColumn("speed", F.col("step") * fps)
    rows = rows.withColumn("acc", (F.col("speed") - F.lag("speed").over(w)) * fps)
    rows = rows.withColumns({f"u_{c}": F.sum(F.coalesce(f"d_{c}", F.lit(0.0))).over(w) for c in ("roll", "pitch", "yaw")})
    ends = lambda c: F.max_by(c, "frame") - F.min_by(c, "frame")
    path, net, rate = F.sum("step"), F.sqrt(ends("x") ** 2 + ends("y") ** 2), F.abs("d_yaw") * fps
    loco = {
        "duration_sec": (F.count("*") - 1) / fps, "path_xy_m": path, "net_xy_m": net, "net_over_path_xy": net / F.greatest(path, F.lit(1e-6)), "mean_xy_speed_m_s": F.avg("speed"), "max_xy_speed_m_s": F.max("speed"),
        "std_xy_speed_m_s": F.stddev_pop("speed"), "yaw_abs_change_deg": F.sum(F.abs("d_yaw")), "yaw_range_deg": _span(F.col("u_yaw")), "mean_abs_yaw_rate_deg_s": F.avg(rate), "max_abs_yaw_rate_deg_s": F.max(rate),
        "vertical_path_m": F.sum(F.abs("d_z")),
    }
    height = {
        "root_z_mean_m": F.avg("z"), "root_z_min_m": F.min("z"), "root_z_max_m": F.max("z"), "root_z_range_m": _span(F.col("z")), "root_z_std_m": F.stddev_pop("z"), "root_pitch_range_deg": _span(F.col("u_pitch")),
        "root_roll_range_deg": _span(F.col("u_roll")), "root_pitch_rms_deg": F.sqrt(F.avg(F.col("pitch") ** 2)), "root_roll_rms_deg": F.sqrt(F.avg(F.col("roll") ** 2)),
    }
    dynamics = {"root_xy_acc_mean_abs_m_s2": F.avg(F.abs("acc")), "root_xy_acc_max_abs_m_s2": F.max(F.abs("acc"))}
    named = [c.alias(f"{g}__{n}") for g, part in (("root_locomotion", loco), ("height_posture", height), ("dynamics_complexity", dynamics)) for n, c in part.items()]
    return rows.groupBy(key).agg(F.count("*").alias("num_frames"), *named)


def joint_features(joints: DataFrame, key: str, fps: float) -> DataFrame:
    """``joints(key, frame, joint, q)`` in degrees: ranges, speeds, accelerations and jerks by limb and name."""
    own = [key, "joint"]
    w = S.over(own)
    rows = _steps(joints, own, ["q"], True).withColumn("vel", F.col("d_q") * fps)
    rows = rows.withColumn("acc", (F.col("vel") - F.lag("vel").over(w)) * fps)
    rows = rows.withColumn("jerk", (F.col("acc") - F.lag("acc").over(w)) * fps).withColumn("limb", N.limb(F.col("joint")))
    speed, acc, jerk = (F.abs(c) for c in ("vel", "acc", "jerk"))
    lower, upper = F.col("limb").endswith("_leg"), F.col("limb").endswith("_arm")
    # a motion's rows lie together in the order of its joints: the window needs no sort of its own, as an aggregation of percentiles would
    of_motion = Window.partitionBy(key)
    rows = rows.withColumns({f"p95_{n}": _p95(c).over(of_motion) for n, c in {"vel": speed, "acc": acc, "jerk": jerk, "lower": F.when(lower, speed)}.items()})
    each = rows.groupBy(*own, "limb").agg(
        _span(F.col("q")).alias("range"), F.stddev_pop("q").alias("std"), F.sum(F.abs("q")).alias("abs"), F.count("q").alias("n"), F.sum(speed).alias("speed"), F.count("vel").alias("steps"), F.sum(speed * speed).alias("speed2"),
        *[f(c).alias(f"{f.__name__}_{n}") for n, c in (("acc", acc), ("jerk", jerk)) for f in (F.sum, F.count, F.max)], F.max(speed).alias("max_vel"), F.sum(acc * acc).alias("acc2"),
        *[F.max(f"p95_{n}").alias(f"p95_{n}") for n in ("vel", "acc", "jerk", "lower")],
    )
    mean = lambda total, n: F.sum(total) / F.nullif(F.sum(n), F.lit(0))
    whole = {
        "dynamics_complexity__joint_vel_mean_abs_deg_s": mean("speed", "steps"), "dynamics_complexity__joint_vel_p95_abs_deg_s": F.max("p95_vel"), "dynamics_complexity__joint_vel_max_abs_deg_s": F.max("max_vel"),
        "dynamics_complexity__joint_acc_mean_abs_deg_s2": mean("sum_acc", "count_acc"), "dynamics_complexity__joint_acc_p95_abs_deg_s2": F.max("p95_acc"), "dynamics_complexity__joint_acc_max_abs_deg_s2": F.max("max_acc"),
        "dynamics_complexity__joint_jerk_mean_abs_deg_s3": mean("sum_jerk", "count_jerk"), "dynamics_complexity__joint_jerk_p95_abs_deg_s3": F.max("p95_jerk"), "dynamics_complexity__joint_jerk_max_abs_deg_s3": F.max("max_jerk"),
        "dynamics_complexity__complexity_energy": mean("speed2", "steps") + 0.0001 * F.coalesce(mean("acc2", "count_acc"), F.lit(0.0)), "foot_gait_proxy__lower_joint_vel_p95_abs_deg_s": F.max("p95_lower"),
    }
    name = F.col("joint")
    is_ = lambda *joints: name.isin(*joints)
    ranges = lambda c, f=F.avg: F.coalesce(f(F.when(c, F.col("range"))), F.lit(0.0))
    mean_abs = lambda c: F.sum(F.when(c, F.col("abs"))) / F.sum(F.when(c, F.col("n")))
    speeds = lambda c: F.coalesce(F.sum(F.when(c, F.col("speed"))) / F.sum(F.when(c, F.col("steps"))), F.lit(0.0))
    limb = lambda x: F.col("limb") == x
    active = lambda x: ranges(limb(x)) + speeds(limb(x)) / 120.0
    pair = lambda joint: [f"{s}_{joint}" for s in SIDES]
    hips = pair("hip_pitch_joint")
    has = lambda word: F.contains(name, F.lit(word))
    gap = lambda x: F.abs(ranges(limb(f"left_{x}")) - ranges(limb(f"right_{x}")))
    found = {
        "height_posture__knee_mean_abs_deg": mean_abs(is_(*pair("knee_joint"))), "height_posture__knee_range_mean_deg": ranges(is_(*pair("knee_joint"))),
        # an absent hip counts as a joint at rest
        "height_posture__hip_pitch_mean_abs_deg": F.sum(F.when(is_(*hips), F.col("abs") / F.col("n"))) / 2, "height_posture__hip_pitch_range_mean_deg": F.sum(F.when(is_(*hips), F.col("range"))) / 2,
        "height_posture__ankle_pitch_mean_abs_deg": mean_abs(is_(*pair("ankle_pitch_joint"))), "height_posture__waist_head_range_mean_deg": ranges(limb("torso_head")),
        **{f"foot_gait_proxy__{s}_leg_range_mean_deg": ranges(limb(f"{s}_leg")) for s in SIDES}, **{f"foot_gait_proxy__{s}_leg_range_max_deg": ranges(limb(f"{s}_leg"), F.max) for s in SIDES},
        "foot_gait_proxy__lower_joint_vel_mean_abs_deg_s": speeds(lower), "foot_gait_proxy__leg_activity_asymmetry": F.abs(active("left_leg") - active("right_leg")), "__leg_activity": active("left_leg") + active("right_leg"),
        **{f"upper_body_workspace_proxy__{s}_arm_range_mean_deg": ranges(limb(f"{s}_arm")) for s in SIDES}, **{f"upper_body_workspace_proxy__{s}_arm_range_max_deg": ranges(limb(f"{s}_arm"), F.max) for s in SIDES},
        **{f"upper_body_workspace_proxy__{word}_range_mean_deg": ranges(has(word)) for word in ("shoulder", "elbow", "wrist")}, "upper_body_workspace_proxy__wrist_range_max_deg": ranges(has("wrist"), F.max),
        "upper_body_workspace_proxy__arm_joint_vel_mean_abs_deg_s": speeds(upper), "upper_body_workspace_proxy__arm_activity_asymmetry": F.abs(active("left_arm") - active("right_arm")),
        "joint_range_group__all_joint_range_mean_deg": F.avg("range"), "joint_range_group__all_joint_range_max_deg": F.max("range"), "joint_range_group__all_joint_range_std_deg": F.stddev_pop("range"),
        "joint_range_group__all_joint_std_mean_deg": F.avg("std"), **{f"joint_range_group__active_joint_fraction_{d}deg": F.avg((F.col("range") >= float(d)).cast("double")) for d in (5, 15)},
        "joint_range_group__lower_upper_range_ratio": ranges(lower) / F.greatest(ranges(upper), F.lit(1e-6)), "joint_range_group__left_right_lower_range_asymmetry": gap("leg"),
        "joint_range_group__left_right_upper_range_asymmetry": gap("arm"), "periodicity_symmetry__leg_lr_range_symmetry": 1 / (1 + gap("leg")), "periodicity_symmetry__arm_lr_range_symmetry": 1 / (1 + gap("arm")),
    }
    return each.groupBy(key).agg(*[c.alias(n) for n, c in {**found, **whole}.items()])


def paired_joints(joints: DataFrame, key: str) -> DataFrame:
    """``(key, frame, <side>_hip, <side>_knee, <side>_elbow)``; an absent joint is at 0."""
    named = {"hip": "hip_pitch_joint", "knee": "knee_joint", "elbow": "elbow_roll_joint"}
    value = lambda s, j: F.coalesce(F.max(F.when(F.col("joint") == f"{s}_{j}", F.col("q"))), F.lit(0.0))
    return joints.groupBy(key, "frame").agg(*[value(s, j).alias(f"{s}_{n}") for n, j in named.items() for s in SIDES])


def body_features(bodies: DataFrame, key: str, fps: float) -> tuple[DataFrame, DataFrame]:
    """One row of features per motion, and heights of the feet by frame, from ``bodies(key, frame, body, x, y, z, rx, ry, rz)``: places in space and as the root sees them."""
    own = [key, "body"]
    w = S.over(own)
    rows = _steps(bodies, own, ["x", "y", "z"], False)
    flat = F.col("d_x") ** 2 + F.col("d_y") ** 2
    rows = rows.withColumns({"step": F.sqrt(flat + F.col("d_z") ** 2), "flat": F.sqrt(flat)}).withColumn("speed", F.col("step") * fps)
    rows = rows.withColumn("acc", F.abs(F.col("speed") - F.lag("speed").over(w)) * fps)
    of_body = Window.partitionBy(*own)  # the windows before have sorted by it
    rows = rows.withColumns({"tenth": F.percentile("z", F.lit(0.1)).over(of_body), "speed_p95": _p95(F.col("speed")).over(of_body), "acc_p95": _p95(F.col("acc")).over(of_body)})
    rows = rows.withColumn("low", F.col("z") <= F.col("tenth") + 0.025)
    each = rows.groupBy(*own).agg(
        F.avg("z").alias("z_mean"), F.min("z").alias("z_min"), _span(F.col("z")).alias("z_range"), *[F.avg(f"r{a}").alias(f"rel_{a}_mean") for a in "xyz"], *[_span(F.col(f"r{a}")).alias(f"rel_{a}_range") for a in "xyz"],
        F.sum("step").alias("path"), F.sum("flat").alias("xy_path"), F.avg("speed").alias("speed_mean"), F.max("speed_p95").alias("speed_p95"), F.max("acc_p95").alias("acc_p95"), F.avg(F.col("low").cast("double")).alias("low"),
        F.avg(F.when(F.col("low"), F.col("flat") * fps)).alias("low_speed"),
    )
    of = lambda body, c: F.max(F.when(F.col("body") == body, F.col(c)))
    found = {f"height_posture__fk_{b}_z_{k}_m": of(b, f"z_{k}") for b in ("pelvis", "torso", "head") for k in ("mean", "range")}
    found |= {f"height_posture__fk_head_rel_z_{k}_m": of("head", f"rel_z_{k}") for k in ("mean", "range")} | {f"height_posture__fk_torso_rel_{a}_range_m": of("torso", f"rel_{a}_range") for a in "xyz"}
    for s in SIDES:
        foot, wrist = f"{s}_foot", f"{s}_wrist"
        gait = {
            f"fk_{foot}_z_min_m": "z_min", f"fk_{foot}_z_range_m": "z_range", f"fk_{foot}_rel_z_range_m": "rel_z_range", f"fk_{foot}_xy_path_m": "xy_path", f"fk_{foot}_speed_p95_m_s": "speed_p95",
            f"fk_{s}_contact_proxy_ratio": "low", f"fk_{s}_low_xy_speed_mean_m_s": "low_speed",
        }
        found |= {f"foot_gait_proxy__{n}": of(foot, c) for n, c in gait.items()}
        found |= {f"upper_body_workspace_proxy__fk_{wrist}_rel_{a}_{k}_m": of(wrist, f"rel_{a}_{k}") for k in ("mean", "range") for a in "xyz"}
        found |= {f"upper_body_workspace_proxy__fk_{wrist}_path_m": of(wrist, "path"), f"upper_body_workspace_proxy__fk_{wrist}_speed_p95_m_s": of(wrist, "speed_p95")}
    moving = {"speed_mean_m_s": "speed_mean", "speed_p95_m_s": "speed_p95", "acc_p95_m_s2": "acc_p95"}
    found |= {f"dynamics_complexity__fk_{b}_{n}": of(b, c) for b in BODIES[2:] for n, c in moving.items()}
    single = each.groupBy(key).agg(*[c.alias(n) for n, c in found.items()])
    value = lambda b, c: F.max(F.when(F.col("body") == b, F.col(c)))
    frames = rows.groupBy(key, "frame").agg(*[value(f"{s}_{b}", c).alias(f"{s}_{b}_{c}") for s in SIDES for b in ("foot", "wrist") for c in ("z", "rx", "ry", "rz", "low")])
    apart = lambda b: F.sqrt(sum(((F.col(f"left_{b}_r{a}") - F.col(f"right_{b}_r{a}")) ** 2 for a in "yz"), (F.col(f"left_{b}_rx") - F.col(f"right_{b}_rx")) ** 2))
    aside = lambda a: F.abs(F.col(f"left_foot_r{a}") - F.col(f"right_foot_r{a}"))
    both = F.col("left_foot_low") & F.col("right_foot_low")
    none = ~F.col("left_foot_low") & ~F.col("right_foot_low")
    heights = lambda b: A.correlation(F.col(f"left_{b}_z"), F.col(f"right_{b}_z"))
    distances = {"foot_gait_proxy__fk_foot_separation": apart("foot"), "foot_gait_proxy__fk_step_width": aside("y"), "foot_gait_proxy__fk_step_length": aside("x"), "upper_body_workspace_proxy__fk_wrist_separation": apart("wrist")}
    pairs = {f"{n}_{k}_m": f(c) for n, c in distances.items() for k, f in (("mean", F.avg), ("range", _span))} | {
        "foot_gait_proxy__fk_double_support_proxy_ratio": F.avg(both.cast("double")), "foot_gait_proxy__fk_flight_proxy_ratio": F.avg(none.cast("double")), "foot_gait_proxy__fk_foot_height_lr_corr": heights("foot"),
        "upper_body_workspace_proxy__fk_wrist_lr_height_corr": heights("wrist"), "periodicity_symmetry__fk_foot_height_lr_corr": heights("foot"), "periodicity_symmetry__fk_wrist_height_lr_corr": heights("wrist"),
    }
    return single.join(frames.groupBy(key).agg(*[c.alias(n) for n, c in pairs.items()]), key), frames.select(key, "frame", "left_foot_z", "right_foot_z")


def spectral_features(series: dict[str, tuple[DataFrame, Column, float]], key: str) -> DataFrame:
    """The strongest frequency of each named series (a table with frames, its value, its rate): ``periodicity_symmetry__<name>_fft_peak_ratio`` and ``_hz``."""
    parts = []
    for name, (df, value, fps) in series.items():
        rows = df.select(F.struct(key, F.lit(name).alias("n")).alias("k"), "frame", value.alias("v")).where(F.col("v").isNotNull())
        parts.append(G.spectral_peaks(rows.withColumn("k", F.to_json("k")), "k", "v", fps))
    found = reduce(DataFrame.unionByName, parts)
    told = found.select(F.from_json("k", f"struct<{key}: string, n: string>").alias("k"), "share", "hertz").select(F.col(f"k.{key}").alias("__key"), "k.n", "share", "hertz")
    of = lambda n, c: F.max(F.when(F.col("n") == n, F.col(c)))
    named = [of(n, c).alias(f"periodicity_symmetry__{n}_fft_peak_{end}") for n in series for c, end in (("share", "ratio"), ("hertz", "hz"))]
    return told.groupBy("__key").agg(*named)


def diversity_features(root: DataFrame, joints: DataFrame, bodies: DataFrame, key: str, fps: float, stride: int = 4) -> DataFrame:
    """One row per motion: ``num_frames`` and 153 features, ``group__name``; what is no number is 0.

    Bodies are given at every ``stride``-th frame, numbered on. Root, joints and bodies are one window sort and a few aggregations each, all by motion; the spectra of
    six series are NumPy, one series a group.
    """
    slow = fps / stride
    limbs = paired_joints(joints, key)
    corr = lambda n, sign=1: A.correlation(F.col(f"left_{n}"), F.col(f"right_{n}") * sign)
    pairs = limbs.groupBy(key).agg(corr("hip", -1).alias("foot_gait_proxy__hip_pitch_lr_anti_corr"), corr("knee").alias("foot_gait_proxy__knee_lr_corr"), corr("elbow").alias("upper_body_workspace_proxy__elbow_lr_corr"))
    single, feet = body_features(bodies, key, slow)
    steps = _steps(root, [key], ["x", "y"], False)
    between = lambda n: F.col(f"left_{n}") - F.col(f"right_{n}")
    spectra = spectral_features({
        "root_speed": (steps, F.sqrt(F.col("d_x") ** 2 + F.col("d_y") ** 2) * fps, fps), "hip_pitch_diff": (limbs, between("hip"), fps), "knee_diff": (limbs, between("knee"), fps),
        "fk_left_foot_height": (feet, F.col("left_foot_z"), slow), "fk_right_foot_height": (feet, F.col("right_foot_z"), slow), "fk_foot_height_diff": (feet, F.col("left_foot_z") - F.col("right_foot_z"), slow),
    }, key)
    out = root_features(root, key, fps).join(joint_features(joints, key, fps), key, "left").join(pairs, key, "left").join(single, key, "left")
    out = out.join(spectra, F.col(key).cast("string") == F.col("__key"), "left").drop("__key")
    activity = F.col("root_locomotion__mean_xy_speed_m_s") / F.greatest("__leg_activity", F.lit(1e-6))
    out = out.withColumn("foot_gait_proxy__speed_to_leg_activity_ratio", activity).drop("__leg_activity")
    features = [c for c in out.columns if "__" in c]
    return out.select(key, "num_frames", *[F.coalesce(A.kept(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in features])
