"""Queries over calibration, stance offsets and the repair stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridelake.functions import rotations as R
from stridelake.operators import calibration as C
from stridelake.operators import motion as X
from stridelake.operators import stages as T
from stridelake.plans.base import TRACE, query, trace
from stridelake.plans.scalars import quats, vector, vectors
from stridelake.plans.series import FPS, r6

#: Joints with what generates their robot poses: scales by axis, offset, and turn about z in degrees. The elbow's human place is the root's, so no scale can be told.
JOINTS = (("Head", (0.7, 0.7, 0.7), (0.05, 0.0, 0.1), 30.0), ("LeftHand", (0.8, 0.8, 0.8), (0.1, 0.2, 0.3), 90.0), ("RightHand", (0.8, 0.8, 0.8), (0.1, -0.2, 0.3), -90.0), ("Elbow", (0.0, 0.0, 0.0), (0.3, 0.2, 0.1), 0.0), ("Hips", (0.9, 0.9, 0.9), (0.1, -0.2, 0.0), 45.0))
AXIS_JOINTS = (("Head", (0.7, 0.8, 0.9), (0.05, 0.0, 0.1), 30.0), ("LeftHand", (0.8, 0.9, 1.1), (0.1, 0.2, 0.3), 90.0), ("RightHand", (0.8, 0.9, 1.1), (0.1, -0.2, 0.3), -90.0), ("Elbow", (0.0, 0.0, 0.0), (0.3, 0.2, 0.1), 0.0), ("Hips", (0.9, 0.9, 0.9), (0.1, -0.2, 0.0), 45.0))
RATIO = 0.95


def observations(spark, sf_dir, joints, noise: float = 0.0):
    """Pose pairs made from known scales, offsets and turns, which the solver has to find again; noise is that share of three more components, added to the robot's place."""
    at = (F.col("id") % len(joints)).cast("int")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)
    rows = vectors(spark, sf_dir).withColumn("joint", pick([j[0] for j in joints]))
    hq, uq = quats()
    half = F.radians(pick([j[3] for j in joints])) / 2
    rows = rows.withColumns({"hq": hq, "uq": uq, "t": R.quat(F.lit(0.0), F.lit(0.0), F.sin(half), F.cos(half)), "ur": R.vec(F.col("e11"), F.col("e12"), 1.5 + F.col("e13") / 10), "d": vector()})
    vec3 = lambda k: R.vec(*[pick([float(j[k][i]) for j in joints]) for i in range(3)])
    plus = lambda a, b: R.each(lambda x, y: x + y, a, b, names="xyz")
    times = lambda a, b: R.each(lambda x, y: x * y, a, b, names="xyz")
    hips, elbow = F.col("joint") == "Hips", F.col("joint") == "Elbow"
    none = R.vec(*map(F.lit, (0.0, 0.0, 0.0)))
    rows = rows.withColumns({"s": vec3(1), "o": vec3(2), "d": F.when(hips | elbow, none).otherwise(F.col("d"))}).withColumn("rq", R.product(F.col("hq"), F.col("t")))
    rows = rows.withColumn("br", R.vec(F.lit(0.2), F.lit(0.3), F.lit(0.9)))
    scaled = R.rotate(F.col("uq"), times(R.rotate_back(F.col("uq"), F.col("d")), F.col("s")))
    limb = plus(plus(F.col("br"), scaled), R.rotate(F.col("rq"), F.col("o")))
    rows = rows.withColumn("rp", F.when(hips, plus(times(F.col("ur"), F.col("s")), F.col("o"))).otherwise(limb)).withColumn("hp", plus(F.col("ur"), F.col("d")))
    if noise:
        rows = rows.withColumn("rp", plus(F.col("rp"), R.vec(*[F.col(f"e{i}") * noise for i in (14, 15, 16)])))
    parts = [F.col(f"{p}.{a}").alias(f"{p}{a}") for p in ("hp", "ur", "rp", "br") for a in "xyz"] + [F.col(f"{p}.{a}").alias(f"{p}{a}") for p in ("hq", "uq", "rq") for a in "xyzw"]
    return rows.select("joint", *parts)


def _expected(joints) -> str:
    rows = []
    for k, (name, s, o, turn) in enumerate(joints):
        fixed = name == "Elbow"
        s = (RATIO,) * 3 if fixed else s
        group = "LeftHand<->RightHand" if name.endswith("Hand") else name
        state = "solved_fixed_scale_underconstrained" if fixed else "solved"
        rows.append(f"({k}, '{name}', '{state}', '{group}', {', '.join(f'{x}::DOUBLE' for x in (*s, *o))}, round(sin(radians({turn}) / 2), 5), 0.0::DOUBLE)")
    columns = "k, joint, state, scale_group, sx, sy, sz, ox, oy, oz, qz, worst"
    return f"WITH j({columns}) AS (VALUES {', '.join(rows)}) SELECT j.* EXCLUDE (k), count(*) AS samples FROM j JOIN embeddings ON vec_id % {len(joints)} = k GROUP BY ALL"


def _shown(out):
    five = lambda c, n=None: (F.round(c, 5) + 0.0).alias(n or c)
    worst = F.round(F.greatest("max_position_error", F.col("max_rotation_error") / 100), 4).alias("worst")
    return out.select("joint", "state", "scale_group", *[five(c) for c in ("sx", "sy", "sz", "ox", "oy", "oz", "qz")], worst, "samples")


@query("calibration_pairs", _expected(JOINTS))
def calibration_pairs(spark, sf_dir):
    """Mirrored joints share a scale; a joint without extent keeps the height ratio; the root is fitted to heights."""
    return _shown(C.calibrate_joints(observations(spark, sf_dir, JOINTS), "Hips", RATIO))


@query("calibration_axes", _expected(AXIS_JOINTS))
def calibration_axes(spark, sf_dir):
    """One scale for each axis of the root's frame."""
    return _shown(C.calibrate_joints(observations(spark, sf_dir, AXIS_JOINTS), "Hips", RATIO, C.CalibrationRules(by_axis=True)))


def _sql_unit(k: int, names: str) -> str:
    return ", ".join(f"e[{k + i + 1}] / sqrt({' + '.join(f'e[{k + j + 1}] ** 2' for j in range(4))}) AS {n}" for i, n in enumerate(names.split()))


def _sql_back(v: tuple[str, str, str]) -> list[str]:
    """A vector turned back by the quaternion px, py, pz, pw."""
    x, y, z = v
    cross = [f"(pz * {y} - py * {z})", f"(px * {z} - pz * {x})", f"(py * {x} - px * {y})"]
    again = [f"(py * {cross[2]} - pz * {cross[1]})", f"(pz * {cross[0]} - px * {cross[2]})", f"(px * {cross[1]} - py * {cross[0]})"]
    return [f"{v[i]} + 2 * (pw * {cross[i]} - {again[i]})" for i in range(3)]


_BACK = {n: _sql_back(v) for n, v in (("u", ("dx", "dy", "dz")), ("v", ("gx", "gy", "gz")))}
NOISY = f"""WITH j(k, joint, s, ox, oy, oz, turn) AS (VALUES {", ".join(f"({k}, '{n}', {s[0]}::DOUBLE, {', '.join(f'{x}::DOUBLE' for x in o)}, {t}::DOUBLE)" for k, (n, s, o, t) in enumerate(JOINTS[:3]))}),
e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), h AS (SELECT j.*, {_sql_unit(0, "hx hy hz hw")}, e[9] AS dx, e[10] AS dy, e[11] AS dz, e[15] * 0.05 AS ex, e[16] * 0.05 AS ey, e[17] * 0.05 AS ez FROM e JOIN j ON vec_id % {len(JOINTS)} = k),
p AS (SELECT *, hx * cos(radians(turn) / 2) + hy * sin(radians(turn) / 2) AS px, hy * cos(radians(turn) / 2) - hx * sin(radians(turn) / 2) AS py, hz * cos(radians(turn) / 2) + hw * sin(radians(turn) / 2) AS pz, hw * cos(radians(turn) / 2) - hz * sin(radians(turn) / 2) AS pw FROM h),
g AS (SELECT *, s * dx + (1 - 2 * (py ** 2 + pz ** 2)) * ox + 2 * (px * py - pw * pz) * oy + 2 * (px * pz + pw * py) * oz + ex AS gx, s * dy + 2 * (px * py + pw * pz) * ox + (1 - 2 * (px ** 2 + pz ** 2)) * oy + 2 * (py * pz - pw * px) * oz + ey AS gy,
  s * dz + 2 * (px * pz - pw * py) * ox + 2 * (py * pz + pw * px) * oy + (1 - 2 * (px ** 2 + py ** 2)) * oz + ez AS gz FROM p),
m AS (SELECT joint, count(*) AS n, sum(dx ** 2 + dy ** 2 + dz ** 2) AS bb, sum(dx * gx + dy * gy + dz * gz) AS bg, sum(gx ** 2 + gy ** 2 + gz ** 2) AS gg, {", ".join(f"sum({x}) AS {n}{i}" for n in "uv" for i, x in enumerate(_BACK[n]))} FROM g GROUP BY joint),
f AS (SELECT regexp_replace(joint, 'Left|Right', '') AS grp, sum(bg - (u0 * v0 + u1 * v1 + u2 * v2) / n) / sum(bb - (u0 ** 2 + u1 ** 2 + u2 ** 2) / n) AS scale FROM m GROUP BY grp)"""


@query("calibration_noisy", f"""{NOISY} SELECT joint, n AS samples, round(scale, 6) AS scale, {", ".join(f"round((v{i} - scale * u{i}) / n, 6) AS o{a}" for i, a in enumerate("xyz"))} FROM m JOIN f ON grp = regexp_replace(joint, 'Left|Right', '')""")
def calibration_noisy(spark, sf_dir):
    """Robot places with noise: the least squares of a single joint and of mirrored ones, as in closed form."""
    rows = observations(spark, sf_dir, JOINTS, 0.05).where("joint not in ('Elbow', 'Hips')")
    out = C.calibrate_joints(rows, "Hips", RATIO)
    return out.select("joint", "samples", r6(F.col("sx"), "scale"), *[r6(F.col(f"o{a}"), f"o{a}") for a in "xyz"])


STANCE = f"""{TRACE}, f AS (SELECT motion, frame, (q - 100) / 1000 AS l, (q - 110) / 1200 AS r, 0.1 + (frame % 5) * 0.01 AS lt, 0.12 AS rt, q / 20000 AS x FROM trace),
v AS (SELECT *, coalesce(abs(x - lag(x) OVER w), abs(x - lead(x) OVER w), 0) * 30 AS speed FROM f WINDOW w AS (PARTITION BY motion ORDER BY frame)),
c AS (SELECT *, (l + r) / 2 AS mean, least(l, r) AS low, exp(-(greatest(0, lt - 0.11) + greatest(0, rt - 0.11)) / 0.05) * exp(-((abs(l - r) / 0.02) ** 2)) * exp(-((speed / 0.2) ** 2)) AS conf FROM v),
k AS (SELECT *, count(*) OVER m AS n, max(conf) OVER m AS best, row_number() OVER (PARTITION BY motion ORDER BY conf DESC, frame DESC) AS rk FROM c WINDOW m AS (PARTITION BY motion)),
h AS (SELECT *, 0.001 - mean AS off, greatest(conf, 1e-6) ** 2 AS weight FROM k WHERE CASE WHEN best >= 0.5 THEN conf >= 0.5 ELSE rk <= greatest(1, least(10, n // 50)) END),
g AS (SELECT motion, off, sum(weight) AS weight FROM h GROUP BY ALL), u AS (SELECT *, sum(weight) OVER (PARTITION BY motion ORDER BY off) AS cum, sum(weight) OVER (PARTITION BY motion) AS total FROM g),
o AS (SELECT motion, min(off) FILTER (WHERE cum >= 0.95 * total - 1e-12) AS offset_ FROM u GROUP BY motion),
a AS (SELECT h.*, offset_, abs(mean + offset_) AS far FROM h JOIN o USING (motion)), b AS (SELECT motion, far, sum(weight) AS weight FROM a GROUP BY ALL),
e AS (SELECT *, sum(weight) OVER (PARTITION BY motion ORDER BY far) AS cum, sum(weight) OVER (PARTITION BY motion) AS total FROM b), p AS (SELECT motion, min(far) FILTER (WHERE cum >= 0.95 * total - 1e-12) AS p95 FROM e GROUP BY motion),
t AS (SELECT motion, count(*) AS candidates, sum(off * weight) / sum(weight) AS mean_offset, quantile_cont(mean + offset_, 0.5) AS p50 FROM a GROUP BY motion),
z AS (SELECT motion, count(*) AS num_frames, max(conf) AS confidence, arg_min(frame, struct_pack(c := -conf, f := frame)) AS best_frame, min(low) AS lowest, arg_min(frame, struct_pack(c := low, f := frame)) AS low_frame FROM c GROUP BY motion),
x AS (SELECT *, candidates / num_frames < 0.01 AS few, lowest + offset_ < -0.02 AS deep, p95 > 0.02 AS wide, confidence < 0.5 AS unsure FROM z JOIN o USING (motion) JOIN t USING (motion) JOIN p USING (motion))"""


@query("stance_offsets", f"""WITH {STANCE} SELECT motion, num_frames, best_frame, CASE WHEN deep THEN low_frame ELSE best_frame END AS review_frame, candidates, round(offset_, 6) AS offset_, round(mean_offset, 6) AS mean_offset, round(p50, 6) AS p50, round(p95, 6) AS p95,
 CASE WHEN few OR deep OR wide OR unsure THEN 'review' ELSE 'ok' END AS status, array_to_string(list_filter([CASE WHEN few THEN 'few_high_confidence_double_support_candidates' END, CASE WHEN deep THEN 'nonstance_global_penetration' END, CASE WHEN wide THEN 'stance_pair_mean_abs_p95' END,
 CASE WHEN unsure THEN 'no_candidate_above_confidence_threshold' END], lambda r: r IS NOT NULL), ';') AS reasons FROM x""")
def stance_offsets(spark, sf_dir):
    """Offsets from frames of confident double stance."""
    q, zero = F.col("q"), F.lit(0.0)
    rows = trace(spark, sf_dir).select(
        "motion", "frame", ((q - 100) / 1000).alias("left"), ((q - 110) / 1200).alias("right"), (0.1 + (F.col("frame") % 5) * 0.01).alias("left_thickness"), F.lit(0.12).alias("right_thickness"),
        (q / 20000).alias("lx"), zero.alias("ly"), zero.alias("lz"), zero.alias("rx"), zero.alias("ry"), zero.alias("rz"),
    )
    out = X.stance_offsets(rows, "motion", FPS, 0.11)
    return out.select("motion", "num_frames", "best_frame", "review_frame", "candidates", r6(F.col("offset"), "offset_"), r6(F.col("mean_offset"), "mean_offset"), r6(F.col("stance_p50"), "p50"), r6(F.col("stance_p95"), "p95"), "status", "reasons")


def stage_frames(spark, sf_dir):
    """Three joints that drift slowly. One motion in three has a step of its elbow at frame 20, one in three of its shoulder and its knee at once."""
    rows = trace(spark, sf_dir)
    joints = F.array(*[F.struct(F.lit(j).alias("joint"), F.lit(k).alias("k")) for j, k in (("left_shoulder_pitch", 1.0), ("left_elbow", 2.0), ("left_knee", 3.0))])
    late = F.col("frame") >= 20
    jump = ((F.col("motion") % 3 == 1) & (F.col("joint") == "left_elbow")) | ((F.col("motion") % 3 == 2) & (F.col("joint") != "left_elbow"))
    return rows.select("motion", "frame", F.inline(joints)).select("motion", "joint", "frame", (F.sin(F.col("frame") / 9) * F.col("k") + F.when(jump & late, 60.0).otherwise(0.0)).alias("q"))


STAGE = f"""{TRACE}, n AS (SELECT motion, count(*) AS n FROM trace GROUP BY motion), m AS (SELECT motion, n, CASE WHEN motion % 3 = 0 OR n <= 20 THEN 'clean' WHEN motion % 3 = 1 THEN 'repairable_transient_spike' ELSE 'hard_transient_multijoint_or_multichain' END AS risk FROM n),
s AS (SELECT *, CASE risk WHEN 'clean' THEN 'firstpass_clean' WHEN 'repairable_transient_spike' THEN 'repaired_postcheck_clean' ELSE 'firstpass_hard_manifest_only' END AS status FROM m)"""


def stage(spark, sf_dir):
    from stridelake.functions import names as N

    return T.repair_stage(stage_frames(spark, sf_dir), N.chain, 30.0)


@query("repair_stage", f"WITH {STAGE} SELECT motion, risk, status, CASE WHEN motion % 3 = 2 AND n > 20 THEN 'rejected' ELSE 'accepted' END AS decision, CASE WHEN status = 'repaired_postcheck_clean' THEN 0 END::BIGINT AS postcheck_events FROM s")
def repair_stage(spark, sf_dir):
    """Classified, repaired, classified again, accepted where clean."""
    return stage(spark, sf_dir)[0].select("motion", "risk", "status", "decision", "postcheck_events")


@query("repair_stage_frames", f"WITH {STAGE} SELECT motion, 3 * n AS rows, true AS smooth FROM s WHERE status <> 'firstpass_hard_manifest_only'")
def repair_stage_frames(spark, sf_dir):
    """The accepted frames: every frame of every accepted motion, without a step above the limit."""
    from stridelake.operators import series as S

    _, frames = stage(spark, sf_dir)
    steps = S.wrapped_steps(frames, ["motion", "joint"]).groupBy("motion").agg(F.max(F.abs("dq")).alias("worst"))
    return frames.groupBy("motion").agg(F.count("*").alias("rows")).join(steps, "motion", "left").select("motion", "rows", (F.coalesce("worst", F.lit(0.0)) <= 30).alias("smooth"))


@query("repair_stage_counts", f"""WITH {STAGE} SELECT count(*) AS input_total, count(*) FILTER (WHERE status = 'firstpass_clean') AS firstpass_clean, count(*) FILTER (WHERE risk = 'repairable_transient_spike') AS repairable_candidates, count(*) FILTER (WHERE risk = 'repairable_transient_spike') AS repaired_postcheck_clean,
 0::BIGINT AS repair_postcheck_rejected, count(*) FILTER (WHERE status = 'firstpass_hard_manifest_only') AS firstpass_hard_rejected, count(*) FILTER (WHERE status <> 'firstpass_hard_manifest_only') AS accepted_total, count(*) FILTER (WHERE status = 'firstpass_hard_manifest_only') AS rejected_total FROM s""")
def repair_stage_counts(spark, sf_dir):
    return T.stage_counts(stage(spark, sf_dir)[0])


@query("pose_pair_observations", """WITH v AS (SELECT vec_id AS id, vec_id // 3 AS pair, (['Hips', 'Hand', 'Tail'])[vec_id % 3 + 1] AS joint, embedding AS e FROM embeddings), h AS (SELECT pair, e FROM v WHERE joint = 'Hips')
SELECT v.pair, v.joint, round(v.e[9]::DOUBLE, 6) AS hx, round(h.e[9]::DOUBLE, 6) AS ux, round(v.e[9]::DOUBLE * 2, 6) AS rx, CASE WHEN v.pair % 4 <> 1 THEN round(h.e[9]::DOUBLE * 2, 6) END AS bx
FROM v JOIN h ON h.pair = v.pair WHERE v.joint <> 'Tail' AND NOT (v.joint = 'Hips' AND v.pair % 4 = 1) AND NOT (v.joint = 'Hand' AND v.pair % 5 = 2)""")
def pose_pair_observations(spark, sf_dir):
    """Observations of pose pairs: joints without a mapping and bodies that a pair lacks give no row."""
    rows = vectors(spark, sf_dir).withColumn("pair", F.floor(F.col("id") / 3))
    name = F.element_at(F.array(*map(F.lit, ("Hips", "Hand", "Tail"))), (F.col("id") % 3 + 1).cast("int"))
    human = rows.select("pair", name.alias("joint"), R.transform(vector(), quats()[0]).alias("t"))
    human = human.join(human.where("joint = 'Hips'").select("pair").distinct(), "pair", "left_semi")
    doubled = R.transform(R.each(lambda x: x * 2, F.col("t.p"), names="xyz"), F.col("t.q"))
    there = ((F.col("joint") == "Hips") & (F.col("pair") % 4 != 1)) | ((F.col("joint") == "Hand") & (F.col("pair") % 5 != 2))
    bodies = human.where(there).select("pair", F.concat(F.lit("b"), "joint").alias("body"), doubled.alias("t"))
    mapping = spark.createDataFrame([("Hips", "bHips", "bHips"), ("Hand", "bHand", "bHand")], "joint string, t_body string, r_body string")
    out = C.pose_observations(human, bodies, mapping, "Hips")
    return out.select("pair", "joint", r6(F.col("hpx"), "hx"), r6(F.col("urx"), "ux"), r6(F.col("rpx"), "rx"), r6(F.col("brx"), "bx"))


@query("judged_clips", f"""WITH {TRACE}, s AS (SELECT motion, frame, joint, CASE WHEN joint = 'view' THEN 0 ELSE q / 500 END AS p, q / 4 AS r FROM trace WHERE joint IN ('click', 'purchase', 'view')), f AS (SELECT motion, min(frame) FILTER (WHERE p > 0.5 OR r > 90) AS failed FROM s GROUP BY motion),
g AS (SELECT s.motion, max(failed) AS failed, min(frame) FILTER (WHERE p > 0.25 OR r > 45) AS warned, count(*) AS samples FROM s JOIN f USING (motion) WHERE failed IS NULL OR frame <= failed GROUP BY s.motion)
SELECT motion, CASE WHEN failed IS NOT NULL THEN 'failed' WHEN warned IS NOT NULL THEN 'warning' ELSE 'succeeded' END AS status, coalesce(failed, warned) AS first_frame, samples FROM g""")
def judged_clips(spark, sf_dir):
    """The status of clips by the joints that count; of one of them the rotation alone does."""
    samples = trace(spark, sf_dir).select("motion", "frame", "joint", (F.col("q") / 500).alias("position_error"), (F.col("q") / 4).alias("rotation_error"))
    weights = spark.createDataFrame([("click", 1.0), ("purchase", 0.5), ("view", 1.0), ("signup", 0.0)], "joint string, weight double")
    return X.clip_status(X.judged(samples, weights, ("click", "purchase", "signup"), ("view",)), "motion").select("motion", "status", "first_frame", "samples")
