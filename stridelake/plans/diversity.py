"""The query over the diversity features of motions."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridelake.operators import features as D
from stridelake.plans.base import TRACE, query, trace
from stridelake.plans.series import FPS
from stridelake.sources.motion_files import LAYOUTS

JOINTS = tuple(c.removesuffix("_dof") for c in LAYOUTS["humanoid_head"])


def tables(spark, sf_dir):
    """Root, joints and bodies made from the frame, the value and the number of joint or body."""
    rows = trace(spark, sf_dir, spread=True).select("motion", "frame", "q")
    f, q = F.col("frame"), F.col("q")
    root = rows.select("motion", "frame", (q * 0.0101731).alias("x"), (f * 0.0213773 * (F.col("motion") % 3)).alias("y"), (0.9 + q / 9871.3).alias("z"), (f % 13).cast("double").alias("roll"), (f % 7).cast("double").alias("pitch"), q.alias("yaw"))
    joints = F.array(*[F.struct(F.lit(j).alias("joint"), F.lit(i).alias("i")) for i, j in enumerate(JOINTS)])
    posed = rows.select("motion", "frame", "q", F.inline(joints)).select("motion", "frame", "joint", (F.sin(f / (5 + F.col("i"))) * (10 + F.col("i")) + q * 0.0101731 * (F.col("i") % 3)).alias("q"))
    named = F.array(*[F.struct(F.lit(b).alias("body"), F.lit(i).alias("i")) for i, b in enumerate(D.BODIES)])
    bodies = rows.where("frame % 4 = 0").select("motion", F.floor(f / 4).alias("frame"), "q", F.inline(named))
    k, i = F.col("frame"), F.col("i")
    places = [(k * 0.0503177).alias("x"), (q * 0.00101937 * i).alias("y"), (0.1 * i + F.sin(k / (2 + i)) * 0.05).alias("z"), (F.col("q") * 0.0005).alias("rx"), (i * 0.1 - q * 0.0002).alias("ry"), (F.cos(k / (3 + i)) * 0.1).alias("rz")]
    return root, posed, bodies.select("motion", "frame", "body", *places)


ALL = f"""{TRACE}, r AS (SELECT motion, frame, q * 0.0101731 AS x, frame * 0.0213773 * (motion % 3) AS y, 0.9 + q / 9871.3 AS z, q FROM trace),
s AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS st, z - lag(z) OVER w AS dz, q - lag(q) OVER w AS raw FROM r WINDOW w AS (PARTITION BY motion ORDER BY frame)), t AS (SELECT *, raw + 180 - 360 * floor((raw + 180) / 360) - 180 AS turn FROM s),
a AS (SELECT motion, count(*) AS num_frames, coalesce(sum(st), 0) AS path, sqrt((arg_max(x, frame) - arg_min(x, frame)) ** 2 + (arg_max(y, frame) - arg_min(y, frame)) ** 2) AS net, coalesce(avg(st) * 30, 0) AS speed, coalesce(stddev_pop(st * 30), 0) AS spread,
  coalesce(sum(abs(turn)), 0) AS turned, coalesce(max(abs(turn)) * 30, 0) AS fastest_turn, coalesce(sum(abs(dz)), 0) AS vertical, max(z) - min(z) AS z_range, stddev_pop(z) AS z_std FROM t GROUP BY motion),
n(i, joint) AS (VALUES {", ".join(f"({i}, '{j}')" for i, j in enumerate(JOINTS))}),
j AS (SELECT motion, frame, n.joint, sin(frame / (5.0 + i)) * (10 + i) + q * 0.0101731 * (i % 3) AS q FROM trace, n), v AS (SELECT *, abs(q - lag(q) OVER (PARTITION BY motion, joint ORDER BY frame)) * 30 AS vel FROM j),
e AS (SELECT motion, joint, max(q) - min(q) AS rng, sum(abs(q)) AS total, count(*) AS c, sum(vel) AS vel, count(vel) AS nv FROM v GROUP BY ALL),
b AS (SELECT motion, coalesce(avg(rng) FILTER (WHERE joint LIKE 'left_%' AND regexp_matches(joint, 'hip|knee|ankle')), 0) AS left_leg, coalesce(max(rng) FILTER (WHERE joint LIKE 'right_%' AND regexp_matches(joint, 'shoulder|elbow|wrist')), 0) AS right_arm_max,
  sum(total) FILTER (WHERE joint LIKE '%knee%') / sum(c) FILTER (WHERE joint LIKE '%knee%') AS knee, coalesce(sum(vel) / nullif(sum(nv), 0), 0) AS vel, avg((rng >= 15)::INT) AS active, stddev_pop(rng) AS rng_std FROM e GROUP BY motion),
p(i, body) AS (VALUES {", ".join(f"({i}, '{x}')" for i, x in enumerate(D.BODIES))}),
g AS (SELECT motion, frame // 4 AS k, body, (frame // 4) * 0.0503177 AS x, q * 0.00101937 * i AS y, 0.1 * i + sin((frame // 4) / (2.0 + i)) * 0.05 AS z, cos((frame // 4) / (3.0 + i)) * 0.1 AS rz FROM trace, p WHERE frame % 4 = 0),
h AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2) AS st FROM g WINDOW w AS (PARTITION BY motion, body ORDER BY k)),
m AS (SELECT motion, avg(z) FILTER (WHERE body = 'head') AS head_z, max(rz) FILTER (WHERE body = 'left_foot') - min(rz) FILTER (WHERE body = 'left_foot') AS foot_rel, coalesce(sum(st) FILTER (WHERE body = 'right_wrist'), 0) AS wrist_path,
  coalesce(quantile_cont(st * 7.5, 0.95) FILTER (WHERE body = 'left_foot'), 0) AS foot_p95 FROM h GROUP BY motion),
l AS (SELECT motion, k, max(z) FILTER (WHERE body = 'left_foot') AS lz, max(z) FILTER (WHERE body = 'right_foot') AS rz FROM g GROUP BY ALL), q10 AS (SELECT motion, quantile_cont(lz, 0.1) + 0.025 AS a, quantile_cont(rz, 0.1) + 0.025 AS b FROM l GROUP BY motion),
d AS (SELECT l.motion, avg((lz <= a AND rz <= b)::INT) AS double_support, coalesce(CASE WHEN count(*) >= 3 THEN corr(lz, rz) END, 0) AS feet_corr FROM l JOIN q10 USING (motion) GROUP BY l.motion)"""

SHOWN = {
    "root_locomotion__path_xy_m": "path", "root_locomotion__net_xy_m": "net", "root_locomotion__mean_xy_speed_m_s": "speed", "root_locomotion__std_xy_speed_m_s": "spread", "root_locomotion__yaw_abs_change_deg": "turned",
    "root_locomotion__max_abs_yaw_rate_deg_s": "fastest_turn", "root_locomotion__vertical_path_m": "vertical", "height_posture__root_z_range_m": "z_range", "height_posture__root_z_std_m": "z_std",
    "foot_gait_proxy__left_leg_range_mean_deg": "left_leg", "upper_body_workspace_proxy__right_arm_range_max_deg": "right_arm_max", "height_posture__knee_mean_abs_deg": "knee", "dynamics_complexity__joint_vel_mean_abs_deg_s": "vel",
    "joint_range_group__active_joint_fraction_15deg": "active", "joint_range_group__all_joint_range_std_deg": "rng_std", "height_posture__fk_head_z_mean_m": "head_z", "foot_gait_proxy__fk_left_foot_rel_z_range_m": "foot_rel",
    "upper_body_workspace_proxy__fk_right_wrist_path_m": "wrist_path", "foot_gait_proxy__fk_left_foot_speed_p95_m_s": "foot_p95", "foot_gait_proxy__fk_double_support_proxy_ratio": "double_support", "foot_gait_proxy__fk_foot_height_lr_corr": "feet_corr",
}


@query("diversity_features", f"WITH {ALL} SELECT motion, num_frames, {', '.join(f'round({c}, 5)::DOUBLE AS {c}' for c in SHOWN.values())} FROM a JOIN b USING (motion) JOIN m USING (motion) JOIN d USING (motion)")
def diversity_features(spark, sf_dir):
    """All features are made; SQL has a part of them, the rest is compared with NumPy in the tests."""
    out = D.diversity_features(*tables(spark, sf_dir), "motion", FPS)
    return out.select("motion", "num_frames", *[(F.round(f, 5) + 0.0).alias(c) for f, c in SHOWN.items()])
