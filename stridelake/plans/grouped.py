"""Queries over composite operators and those that need whole series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stridelake.functions import rotations as R
from stridelake.operators import grouped as G
from stridelake.operators import motion as X
from stridelake.plans.base import TRACE, query, trace
from stridelake.plans.detection import EVENTS, transient
from stridelake.plans.series import FPS, r6
from stridelake.plans.scalars import UNIT, VEC, vectors

M = ["motion"]


@query("spectral_peak")
def spectral_peak(spark, sf_dir):
    """No FFT in SQL: tested against sines of known frequency."""
    return G.spectral_peaks(trace(spark, sf_dir), "motion", "q", FPS)


def peaks(spark, sf_dir):
    best = F.max_by("frame0", F.struct("abs_dq", -F.col("frame0"))).alias("peak")
    return transient(spark, sf_dir).groupBy("motion", "cluster").agg(best).select("motion", "peak")


@query("repair_adaptive")
def repair_adaptive(spark, sf_dir):
    return G.repair_motions(trace(spark, sf_dir), peaks(spark, sf_dir))


@query("repair_clipped")
def repair_clipped(spark, sf_dir):
    return G.repair_motions(trace(spark, sf_dir), peaks(spark, sf_dir), method="clipped")


@query("quaternion_mean")
def quaternion_mean(spark, sf_dir):
    """An eigenvector: tested against NumPy."""
    q = R.normalised(R.quat(*[F.col(f"e{i}") for i in range(4)]))
    rows = vectors(spark, sf_dir).select((F.col("id") % 10).alias("grp"), q.alias("q")).select("grp", "q.*")
    return G.mean_quaternion(rows, ["grp"])


def quaternions(spark, sf_dir):
    w = Window.partitionBy("motion").orderBy("id")
    q = R.normalised(R.quat(*[F.col(f"e{i}") for i in range(4)]))
    rows = vectors(spark, sf_dir).withColumn("motion", F.col("id") % 5)
    return rows.select("motion", (F.row_number().over(w) - 1).cast("long").alias("frame"), q.alias("q"))


QUATS = f"{UNIT}, q AS (SELECT id % 5 AS motion, row_number() OVER (PARTITION BY id % 5 ORDER BY id) - 1 AS frame, ax, ay, az, aw FROM u)"


@query("quaternion_signs", f"""WITH {QUATS}, f AS (SELECT *, coalesce((lag(ax) OVER w * ax + lag(ay) OVER w * ay + lag(az) OVER w * az + lag(aw) OVER w * aw < 0)::INTEGER, 0) AS flip FROM q WINDOW w AS (PARTITION BY motion ORDER BY frame)),
s AS (SELECT *, CASE WHEN sum(flip) OVER (PARTITION BY motion ORDER BY frame) % 2 = 1 THEN -1 ELSE 1 END AS s FROM f) SELECT motion, frame, round(s * ax, 6) AS x, round(s * aw, 6) AS w FROM s""")
def quaternion_signs(spark, sf_dir):
    out = X.canonical_signs(quaternions(spark, sf_dir), M)
    return out.select("motion", "frame", F.round("q.x", 6).alias("x"), F.round("q.w", 6).alias("w"))


@query("angular_velocity", f"""WITH {QUATS}, n AS (SELECT *, coalesce(lag(ax) OVER w, ax) AS px, coalesce(lag(ay) OVER w, ay) AS py, coalesce(lag(az) OVER w, az) AS pz, coalesce(lag(aw) OVER w, aw) AS pw,
  coalesce(lead(ax) OVER w, ax) AS nx, coalesce(lead(ay) OVER w, ay) AS ny, coalesce(lead(az) OVER w, az) AS nz, coalesce(lead(aw) OVER w, aw) AS nw, CASE WHEN lag(ax) OVER w IS NULL OR lead(ax) OVER w IS NULL THEN 1 ELSE 2 END AS k FROM q WINDOW w AS (PARTITION BY motion ORDER BY frame)),
d AS (SELECT motion, frame, k, nx * pw - nw * px - ny * pz + nz * py AS dx, ny * pw - nw * py - nz * px + nx * pz AS dy, nz * pw - nw * pz - nx * py + ny * px AS dz, nw * pw + nx * px + ny * py + nz * pz AS dw FROM n),
s AS (SELECT *, CASE WHEN dw < 0 THEN -1 ELSE 1 END AS sg, sqrt(dx * dx + dy * dy + dz * dz) AS l FROM d), t AS (SELECT *, sg * 30 / k * CASE WHEN l > 1e-8 THEN 2 * atan2(l, sg * dw) / l ELSE 2 END AS f FROM s)
SELECT motion, frame, round(dx * f, 4) + 0.0 AS x, round(dy * f, 4) + 0.0 AS y, round(dz * f, 4) + 0.0 AS z FROM t""")
def angular_velocity(spark, sf_dir):
    out = X.angular_velocity(quaternions(spark, sf_dir), M, FPS)
    return out.select("motion", "frame", *[(F.round(F.col("omega")[a], 4) + 0.0).alias(a) for a in "xyz"])


@query("slerp_resample", f"""WITH {QUATS}, n AS (SELECT *, {", ".join(f"coalesce(lead(a{c}) OVER w, a{c}) AS to_{c}" for c in "xyzw")}, count(*) OVER (PARTITION BY motion) AS n FROM q WINDOW w AS (PARTITION BY motion ORDER BY frame)),
g AS (SELECT motion, n, unnest(range(0, floor(n * 50.0 / 120 + 0.5)::BIGINT)) AS i FROM (SELECT DISTINCT motion, n FROM n)), p AS (SELECT motion, i, least(floor(i * 2.4 + 1e-9), n - 1)::BIGINT AS f FROM g),
m AS (SELECT n.*, p.i, least(1, greatest(0, p.i * 2.4 - n.frame)) AS t, ax * to_x + ay * to_y + az * to_z + aw * to_w AS d FROM p JOIN n ON n.motion = p.motion AND n.frame = p.f), h AS (SELECT *, acos(least(1, abs(d))) AS th FROM m),
w AS (SELECT *, CASE WHEN abs(d) > 0.9995 THEN 1 - t ELSE sin((1 - t) * th) / greatest(sin(th), 1e-12) END AS wa, CASE WHEN d < 0 THEN -1 ELSE 1 END * CASE WHEN abs(d) > 0.9995 THEN t ELSE sin(t * th) / greatest(sin(th), 1e-12) END AS wb FROM h),
r AS (SELECT motion, i, {", ".join(f"wa * a{c} + wb * to_{c} AS {c}" for c in "xyzw")} FROM w)
SELECT motion, i AS target_frame, {", ".join(f"round({c} / sqrt(x * x + y * y + z * z + w * w), 5) AS q{c}" for c in "xyzw")} FROM r""")
def slerp_resample(spark, sf_dir):
    """Rotations at another rate along the shorter arcs."""
    out = X.slerp_resampled(quaternions(spark, sf_dir), M, 120.0, 50.0)
    return out.select("motion", "target_frame", *[F.round(F.col("q")[c], 5).alias(f"q{c}") for c in "xyzw"])


@query("height_offsets", f"""WITH {TRACE}, f AS (SELECT motion, frame, (q - 100) / 1000 AS l, (q - 110) / 1200 AS r FROM trace),
v AS (SELECT *, abs(coalesce(l - lag(l) OVER w, lead(l) OVER w - l, 0)) * 30 AS vl, abs(coalesce(r - lag(r) OVER w, lead(r) OVER w - r, 0)) * 30 AS vr FROM f WINDOW w AS (PARTITION BY motion ORDER BY frame)),
p AS (SELECT motion, count(*) AS n, count(*) FILTER (WHERE l <= 0.04 AND vl <= 0.2) AS hl, count(*) FILTER (WHERE r <= 0.04 AND vr <= 0.2) AS hr, quantile_cont(l, 0.2) AS pl, quantile_cont(r, 0.2) AS pr FROM v GROUP BY motion),
s AS (SELECT v.*, CASE WHEN hl >= greatest(5, 0.005 * n) THEN l <= 0.04 AND vl <= 0.2 ELSE l <= pl END AS sl, CASE WHEN hr >= greatest(5, 0.005 * n) THEN r <= 0.04 AND vr <= 0.2 ELSE r <= pr END AS sr FROM v JOIN p USING (motion)),
o AS (SELECT motion, quantile_cont(CASE WHEN sl AND sr AND greatest(l, r) <= 0.04 AND abs(l - r) <= 0.02 THEN least(l, r) END, 0.5) AS stance, quantile_cont(CASE WHEN sl OR sr THEN least(l, r) END, 0.5) AS support, min(least(l, r)) AS lowest FROM s GROUP BY motion)
SELECT motion, round(coalesce(0.001 - stance, 0.001 - support, -lowest), 6) AS offset_, CASE WHEN stance IS NOT NULL THEN 'double_stance' WHEN support IS NOT NULL THEN 'support' ELSE 'strict_min' END AS method, -(lowest + coalesce(0.001 - stance, 0.001 - support, -lowest)) > 0.02 AS review FROM o""")
def height_offsets(spark, sf_dir):
    feet = trace(spark, sf_dir).select("motion", "frame", ((F.col("q") - 100) / 1000).alias("left"), ((F.col("q") - 110) / 1200).alias("right"))
    out = X.height_offsets(feet, "motion", FPS)
    return out.select("motion", r6(F.col("offset"), "offset_"), "method", "review")


@query("keyframe_offsets", f"""WITH {VEC}, g AS (SELECT id % 7 AS motion, id // 7 AS frame, sqrt((e0 - e3) ** 2 + (e1 - e4) ** 2 + (e2 - e5) ** 2) AS d FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY motion ORDER BY d DESC, frame) AS k FROM g)
SELECT motion, count(*) AS n, round(avg(d), 6) AS mean, round(max(d), 6) AS largest, max(CASE WHEN k = 1 THEN frame END) AS frame FROM r GROUP BY motion""")
def keyframe_offsets(spark, sf_dir):
    v = vectors(spark, sf_dir).select((F.col("id") % 7).alias("motion"), F.floor(F.col("id") / 7).alias("frame"), F.lit("hand").alias("body"), *[F.col(f"e{i}") for i in range(6)])
    key = ["motion", "frame", "body"]
    target, body = (v.select(*key, *[F.col(f"e{i + k}").alias(f"{p}{a}") for i, a in enumerate("xyz")]) for p, k in (("t", 0), ("b", 3)))
    out = X.keyframe_offsets(target, body, M)
    return out.select("motion", "n", r6(F.col("mean"), "mean"), r6(F.col("largest"), "largest"), "frame")


@query("clip_status", f"""WITH {TRACE}, s AS (SELECT motion, frame, q / 500 AS p, q / 4 AS r FROM trace), f AS (SELECT motion, min(frame) FILTER (WHERE p > 0.5 OR r > 90) AS failed FROM s GROUP BY motion),
g AS (SELECT s.motion, max(failed) AS failed, min(frame) FILTER (WHERE p > 0.25 OR r > 45) AS warned, count(*) AS samples, max(p) AS mp FROM s JOIN f USING (motion) WHERE failed IS NULL OR frame <= failed GROUP BY s.motion)
SELECT motion, CASE WHEN failed IS NOT NULL THEN 'failed' WHEN warned IS NOT NULL THEN 'warning' ELSE 'succeeded' END AS status, coalesce(failed, warned) AS first_frame, samples, round(mp, 6) AS max_position FROM g""")
def clip_status(spark, sf_dir):
    samples = trace(spark, sf_dir).select("motion", "frame", "joint", (F.col("q") / 500).alias("position_error"), (F.col("q") / 4).alias("rotation_error"))
    return X.clip_status(samples, "motion").select("motion", "status", "first_frame", "samples", r6(F.col("max_position"), "max_position"))


@query("verify_export", f"""WITH {TRACE}, r AS (SELECT *, (frame % 7) * 2e-6 AS dq, (frame % 3) * 0.0005 AS dr FROM trace)
SELECT (SELECT count(*) FROM r WHERE motion % 10 = 3) AS unmatched, 'q' AS column_, round(max(dq) FILTER (WHERE motion % 10 <> 3), 7) AS largest, max(dq) FILTER (WHERE motion % 10 <> 3) <= 1e-5 AS within FROM r
UNION ALL SELECT (SELECT count(*) FROM r WHERE motion % 10 = 3), 'r', round(max(dr) FILTER (WHERE motion % 10 <> 3), 7), max(dr) FILTER (WHERE motion % 10 <> 3) <= 0.0015 FROM r""")
def verify_export(spark, sf_dir):
    """An export that lacks some motions and differs by frame: one column is within its tolerance."""
    rows = trace(spark, sf_dir).select("motion", "frame", "q", F.col("q").alias("r"))
    moved = rows.where("motion % 10 <> 3").select("motion", "frame", (F.col("q") + (F.col("frame") % 7) * 2e-6).alias("q"), (F.col("r") - (F.col("frame") % 3) * 0.0005).alias("r"))
    out = X.tables_agree(rows, moved, ["motion", "frame"], {"q": 1e-5, "r": 1.5e-3})
    return out.select("unmatched", F.col("column").alias("column_"), F.round("largest", 7).alias("largest"), "within")


@query("repairable_clusters", f"""WITH {EVENTS} SELECT motion, count(*) FILTER (WHERE risk = 'repairable_transient_spike') AS repairable, count(*) FILTER (WHERE risk <> 'repairable_transient_spike') AS rejected FROM risks GROUP BY motion""")
def repairable_clusters(spark, sf_dir):
    """Only repairable clusters go to repair; others become rejected rows."""
    from stridelake.plans.detection import clusters

    good = F.col("risk") == "repairable_transient_spike"
    return clusters(spark, sf_dir).groupBy("motion").agg(F.count_if(good).alias("repairable"), F.count_if(~good).alias("rejected"))


