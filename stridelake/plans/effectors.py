"""Queries over effectors, limbs, masks, predicates and ordered reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stridelake.functions import names as N
from stridelake.functions import rotations as R
from stridelake.operators import effectors as X
from stridelake.operators import relations as J
from stridelake.operators import series as S
from stridelake.operators import stats as A
from stridelake.plans.base import TRACE, WRAP, query, table, trace
from stridelake.plans.detection import JUMPS, jumps
from stridelake.plans.scalars import A as MA
from stridelake.plans.scalars import UNIT, VEC, quats, turned, vector, vectors
from stridelake.plans.series import FPS, r6

ZERO, ONE = (0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 1.0)


def still(*p):
    return R.transform(R.vec(*[x if not isinstance(x, (int, float)) else F.lit(float(x)) for x in p]), R.quat(*map(F.lit, ONE)))


LIMB = f"{VEC}, l AS (SELECT id, 0.3 + abs(e0) / 4 AS u, 0.3 + abs(e1) / 4 AS f, e8 AS tx, e9 AS ty, e10 AS tz FROM v), r AS (SELECT *, sqrt(tx * tx + ty * ty + tz * tz) AS d FROM l), c AS (SELECT *, greatest(abs(u - f), least(d, u + f - 1e-6)) AS reach FROM r)"


@query("two_bone_pose", f"WITH {LIMB} SELECT id, round(u, 5) AS upper, round(f, 5) AS lower, round(reach, 4) AS reach, round(tx / d, 4) AS dx, round(ty / d, 4) AS dy, round(tz / d, 4) AS dz, 1.0::DOUBLE AS tip_turn FROM c")
def two_bone_pose(spark, sf_dir):
    """A limb keeps the lengths of its bones, reaches as far as they allow, in the direction of the target, and takes its turn."""
    u, f = 0.3 + F.abs("e0") / 4, 0.3 + F.abs("e1") / 4
    rows = vectors(spark, sf_dir)
    a, b, c = still(0, 0, 0), still(u, 0, 0), still(u, f, 0)
    q = quats()[0]
    found = R.two_bone_pose(a, b, c, R.transform(vector(), q), F.lit(1.0), R.vec(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    rows = rows.withColumn("s", found).withColumn("q", q)
    minus = lambda m, n: R.each(lambda x, y: x - y, F.col(m), F.col(n), names="xyz")
    tip = F.col("s.tip.p")
    reach = R.length(tip)
    four = lambda x, n: F.round(x, 4).alias(n)
    return rows.select(
        "id", F.round(R.length(F.col("s.mid.p")), 5).alias("upper"), F.round(R.length(minus("s.tip.p", "s.mid.p")), 5).alias("lower"), four(reach, "reach"),
        *[four(tip[x] / reach, f"d{x}") for x in "xyz"], F.round(F.abs(R.dot(F.col("s.tip.q"), F.col("q"))), 5).alias("tip_turn"),
    )


@query("capsule_lowest", f"WITH {UNIT} SELECT id, round(e8 - sign({MA[2][2]}) * 0.2 * {MA[0][2]}, 6) AS x, round(e9 - sign({MA[2][2]}) * 0.2 * {MA[1][2]}, 6) AS y, round(e10 - abs({MA[2][2]}) * 0.2 - 0.05, 6) AS z FROM u")
def capsule_lowest(spark, sf_dir):
    axis = R.rotate(quats()[0], R.vec(F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    point = R.capsule_lowest(vector(), axis, F.lit(0.05), F.lit(0.2))
    return vectors(spark, sf_dir).select("id", *[r6(point[a], a) for a in "xyz"])


@query("quat_error", f"WITH {UNIT} SELECT id % 7 AS grp, round(degrees(max(2 * acos(least(1, abs(ax * bx + ay * by_ + az * bz + aw * bw))))), 5) AS worst FROM u GROUP BY id % 7")
def quat_error(spark, sf_dir):
    """The largest angle between two tables of rotations."""
    return vectors(spark, sf_dir).groupBy((F.col("id") % 7).alias("grp")).agg(F.round(F.max(R.angle_between(*quats())), 5).alias("worst"))


@query("axis_turns", f"""WITH {UNIT}, n AS (SELECT *, greatest(sqrt(e8 * e8 + e9 * e9 + e10 * e10), 1e-12) AS l, sqrt(e0 * e0 + e1 * e1 + e2 * e2 + e3 * e3) AS na2 FROM u)
SELECT id, round(e8 / l * sin(e11 / 2), 6) AS x, round(cos(e11 / 2), 6) AS w, round(e0 / greatest(na2, 1e-12), 6) AS floor_x FROM n""")
def axis_turns(spark, sf_dir):
    """Turns about any axis, and quaternions divided by a norm with a floor."""
    q = R.about(R.unit(vector()), F.col("e11"))
    floored = R.normalised_floor(R.quat(*[F.col(f"e{i}") for i in range(4)]))
    return vectors(spark, sf_dir).select("id", r6(q["x"], "x"), r6(q["w"], "w"), r6(floored["x"], "floor_x"))


#: Poses of three mapped joints by the row's number, with their factors and offsets.
MAPPED = ((0, "hip", "0.9,1.0,1.1", (0.1, 0.0, -0.05)), (1, "hand", "0.8", (0.0, 0.2, 0.0)), (2, "foot", "1.2,0.7,0.5", (0.0, 0.0, 0.0)))


def mapped_joints(spark):
    rows = spark.createDataFrame([(j, s, *o) for _, j, s, o in MAPPED], "joint string, scale string, x double, y double, z double")
    return rows.select("joint", X.parsed_scale(F.col("scale"), 0.5).alias("scale"), still(F.col("x"), F.col("y"), F.col("z")).alias("offset"))


def human_poses(spark, sf_dir):
    joint = F.element_at(F.array(*[F.lit(m[1]) for m in MAPPED]), (F.col("id") % 3 + 1).cast("int"))
    rows = vectors(spark, sf_dir)
    return rows.select(F.floor(F.col("id") / 3).alias("pose"), joint.alias("joint"), R.transform(vector(), quats()[0]).alias("t"))


def _matrix_of(p: str):
    return [[f"{p}.m{i}{j}" for j in range(3)] for i in range(3)]


EFFECTORS = f"""{UNIT}, m(kind, joint, sx, sy, sz, ox, oy, oz) AS (VALUES {", ".join(str((k, j, *[0.5 * float(x) for x in (s.split(",") * 3)[:3]], *o)) for k, j, s, o in MAPPED)}),
p AS (SELECT id // 3 AS pose, m.*, e8, e9, e10, {", ".join(f"{MA[i][j]} AS m{i}{j}" for i in range(3) for j in range(3))} FROM u JOIN m ON id % 3 = kind),
l AS (SELECT p.*, {", ".join(f"{t} * p.s{a} AS l{a}" for a, t in zip("xyz", turned(_matrix_of("r"), [f"(p.e{8 + i} - r.e{8 + i})" for i in range(3)], True)))}, {", ".join(f"r.m{i}{j} AS r{i}{j}" for i in range(3) for j in range(3))},
  r.e8 * r.sx AS rx, r.e9 * r.sy AS ry, r.e10 * r.sz AS rz FROM p JOIN p r ON r.pose = p.pose AND r.kind = 0),
effectors AS (SELECT pose, joint, {", ".join(f"(r{i}0 * lx + r{i}1 * ly + r{i}2 * lz + r{a} + m{i}0 * ox + m{i}1 * oy + m{i}2 * oz) AS {a}" for i, a in enumerate("xyz"))}, {", ".join(f"m{i}{j}" for i in range(3) for j in range(3))} FROM l)"""


@query("scaled_effectors", f"WITH {EFFECTORS} SELECT pose, joint, {', '.join(f'round({a}, 6) AS {a}' for a in 'xyz')} FROM effectors")
def scaled_effectors(spark, sf_dir):
    """Joints scaled as the root sees them, with the root's own scale and the joint's offset."""
    out = X.scaled_effectors(human_poses(spark, sf_dir), mapped_joints(spark), ["pose"], "hip")
    return out.select("pose", "joint", *[r6(F.col(f"t.p.{a}"), a) for a in "xyz"])


@query("buffer_effectors", f"WITH {EFFECTORS} SELECT pose, joint, {', '.join(f'round({a}, 5) AS {a}' for a in 'xyz')} FROM effectors")
def buffer_effectors(spark, sf_dir):
    """Effectors of whole buffers from local poses: the skeleton is walked level by level, then scaled."""
    names = F.array(*map(F.lit, ("hip", "hand", "foot")))
    parents = spark.createDataFrame([(0, -1), (1, 0), (2, 1)], "joint long, parent long")
    numbered = lambda df: df.withColumn("joint", F.array_position(names, F.col("joint")) - 1)
    local = J.local_poses(numbered(human_poses(spark, sf_dir)), parents, ["pose"])
    out = X.buffer_effectors(local, parents, numbered(mapped_joints(spark)), ["pose"], 0, 2)
    return out.select("pose", F.element_at(names, (F.col("joint") + 1).cast("int")).alias("joint"), *[F.round(f"t.p.{a}", 5).alias(a) for a in "xyz"])


@query("scaled_skeleton", f"""WITH {EFFECTORS}, up(joint, parent) AS (VALUES ('hand', 'hip'), ('foot', 'hand')) SELECT c.pose, c.joint, {", ".join(f"round({t}, 6) AS {a}" for a, t in zip("xyz", turned(_matrix_of("p"), [f"(c.{a} - p.{a})" for a in "xyz"], True)))}
FROM effectors c JOIN up ON up.joint = c.joint JOIN effectors p ON p.pose = c.pose AND p.joint = up.parent UNION ALL SELECT pose, joint, round(x, 6), round(y, 6), round(z, 6) FROM effectors WHERE joint = 'hip' OR NOT EXISTS (SELECT 1 FROM effectors e, up WHERE e.pose = effectors.pose AND up.joint = effectors.joint AND e.joint = up.parent)""")
def scaled_skeleton(spark, sf_dir):
    """The scaled effectors as a skeleton of the mapped joints."""
    parents = spark.createDataFrame([("hip", None), ("hand", "hip"), ("foot", "hand")], "joint string, parent string")
    out = X.scaled_skeleton(human_poses(spark, sf_dir), mapped_joints(spark), parents, ["pose"], "hip")
    return out.select("pose", "joint", *[r6(F.col(f"t.p.{a}"), a) for a in "xyz"])


@query("skinned_points", f"""WITH {UNIT}, i AS (SELECT id % 100 AS vertex, 0.25 + (id % 3) * 0.25 AS w, {", ".join(f"{t} + e{14 + k} AS t{k}" for k, t in enumerate(turned(MA, ("(id % 100) * 0.01", "1.0", "2.0"))))} FROM u)
SELECT vertex, round(sum(w * t0), 5) AS x, round(sum(w * t1), 5) AS y, round(sum(w * t2), 5) AS z FROM i GROUP BY vertex""")
def skinned_points(spark, sf_dir):
    """Three tables joined: points, influences and joints."""
    rows = vectors(spark, sf_dir)
    joints = rows.select(F.col("id").alias("joint"), R.transform(vector(14), quats()[0]).alias("t"))
    influences = rows.select((F.col("id") % 100).alias("vertex"), F.col("id").alias("joint"), (0.25 + (F.col("id") % 3) * 0.25).alias("weight"))
    points = influences.select("vertex").distinct().withColumn("p", R.vec(F.col("vertex") * 0.01, F.lit(1.0), F.lit(2.0)))
    return X.skinned(points, influences, joints).select("vertex", *[F.round(a, 5).alias(a) for a in "xyz"])


LABELS = "j AS (SELECT p_partkey AS id, 'robot/' || p_type || '/' || replace(lower(p_name), ' ', '_') AS label, (p_size % 3)::DOUBLE AS mask, lower(p_name) AS name FROM part)"


def labels(spark, sf_dir):
    label = F.concat(F.lit("robot/"), "p_type", F.lit("/"), F.replace(F.lower("p_name"), F.lit(" "), F.lit("_")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), label.alias("label"), (F.col("p_size") % 3).cast("double").alias("mask"))


@query("active_coordinates", f"WITH {LABELS} SELECT id, label FROM j WHERE mask > 0 AND NOT contains(name, 'red') AND (contains(name, 'e') OR contains(name, 'blue'))")
def active_coordinates(spark, sf_dir):
    return X.active_coordinates(labels(spark, sf_dir), ("RED",), ("e", "blue")).select("id", "label")


@query("coordinate_masks", f"WITH {LABELS}, m AS (SELECT DISTINCT replace(name, ' ', '_') AS body FROM j WHERE id % 4 = 0) SELECT id, CASE WHEN body IS NOT NULL THEN 0.25 ELSE 1.0 END::DOUBLE AS mask FROM j LEFT JOIN m ON body = replace(name, ' ', '_')")
def coordinate_masks(spark, sf_dir):
    rows = labels(spark, sf_dir)
    masks = rows.where("id % 4 = 0").select(N.leaf(F.col("label")).alias("body"), F.lit(0.25).alias("value")).distinct()
    return X.coordinate_masks(rows.drop("mask"), masks, 1.0).select("id", "mask")


@query("smooth_residual", f"WITH {TRACE} SELECT motion, frame, round(coalesce((q - lag(q) OVER (PARTITION BY motion ORDER BY frame)) * 0.5 * (frame % 2), 0), 6) AS residual FROM trace")
def smooth_residual(spark, sf_dir):
    rows = trace(spark, sf_dir).withColumn("mask", (F.col("frame") % 2).cast("double"))
    return X.smooth_residual(rows, ["motion"], 0.5).select("motion", "frame", r6(F.col("residual"), "residual"))


BODY = "h AS (SELECT motion, frame, q, q / 200 AS a FROM trace)"


@query("relative_bodies", f"""WITH {TRACE}, {BODY} SELECT motion, frame, round(cos(-2 * a) * (q * 0.02 - q * 0.01) - sin(-2 * a) * 0, 6) AS x, round(sin(-2 * a) * (q * 0.02 - q * 0.01), 6) AS y, 0.01::DOUBLE AS z FROM h""")
def relative_bodies(spark, sf_dir):
    """The hand as the foot sees it."""
    from stridelake.plans.files import bodies

    posed = bodies(spark, sf_dir, spread=True).select("motion", "frame", "body", R.transform(F.col("p"), F.col("q")).alias("t"))
    parents = spark.createDataFrame([("hand", "foot")], "body string, parent string")
    out = X.relative_bodies(posed, parents, ["motion", "frame"])
    return out.select("motion", "frame", *[(F.round(F.col(f"t.p.{a}"), 6) + 0.0).alias(a) for a in "xyz"])


@query("robot_of_files", "SELECT page_id AS id, CASE WHEN page_id % 3 = 0 THEN 'waist' WHEN page_id % 3 = 1 THEN 'head' WHEN list_contains(string_split(lower(url), '/'), 'en') THEN 'waist' WHEN list_contains(string_split(lower(url), '/'), 'fr') THEN 'head' ELSE 'unknown' END AS robot FROM pages")
def robot_of_files(spark, sf_dir):
    """The robot by columns of the header first, then by parts of the path."""
    column = F.when(F.col("page_id") % 3 == 0, "waist_roll_joint_dof").when(F.col("page_id") % 3 == 1, "head_yaw_joint_dof").otherwise("Frame")
    robot = X.robot_of(F.array(F.lit("Frame"), column), F.col("url"), {"waist": ("waist_roll_joint_dof",), "head": ("head_yaw_joint_dof", "head_pitch_joint_dof")}, {"waist": ("en",), "head": ("fr",)})
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), robot.alias("robot"))


@query("face_triangles", """WITH f AS (SELECT p_partkey AS face, list_transform(range(0, 3 + p_size % 3), lambda i: p_partkey * 10 + i) AS c FROM part)
SELECT face, c[1] AS a, c[2] AS b, c[3] AS c FROM f WHERE len(c) IN (3, 4) UNION ALL SELECT face, c[1], c[3], c[4] FROM f WHERE len(c) = 4""")
def face_triangles(spark, sf_dir):
    corners = F.transform(F.sequence(F.lit(0), 2 + F.col("p_size") % 3), lambda i: F.col("p_partkey") * 10 + i)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("face"), F.inline(X.triangles(corners)))


@query("path_partners", r"""WITH p AS (SELECT p_partkey AS id, '/csv/seed/' || CASE WHEN p_partkey % 2 = 0 THEN 'body_motion/' ELSE '' END || p_brand || '/m.' || p_partkey || '.csv' AS path FROM part)
SELECT id, '/bvh/seed/' || split_part(path, '/', CASE WHEN id % 2 = 0 THEN 5 ELSE 4 END) || '/m.' || id || '.bvh' AS partner, CASE WHEN id % 2 = 0 THEN split_part(path, '/', 5) || '/m.' || id || '.csv' END AS tail,
 CASE WHEN id % 2 = 1 THEN 'none of body_motion in ' || path END AS error, regexp_replace(path, '[^A-Za-z0-9]', '_', 'g') AS letters FROM p""")
def path_partners(spark, sf_dir):
    """The path of the other tree's file, what follows a marker folder or an error row, and names of letters and digits."""
    path = F.concat(F.lit("/csv/seed/"), F.when(F.col("p_partkey") % 2 == 0, "body_motion/").otherwise(""), "p_brand", F.lit("/m."), "p_partkey", F.lit(".csv"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), path.alias("path"))
    tail, error = N.after_marker(F.col("path"), ("body_motion",))
    return rows.select("id", N.rejoined(F.col("path"), "/csv", "/bvh", "body_motion", ".bvh").alias("partner"), tail.alias("tail"), error.alias("error"), N.plain_letters(F.col("path")).alias("letters"))


@query("split_side_groups", """WITH j AS (SELECT p_partkey AS id, (CASE p_partkey % 3 WHEN 0 THEN 'left_' WHEN 1 THEN 'right_' ELSE '' END) || (['shoulder', 'elbow', 'wrist', 'hip', 'knee', 'ankle', 'waist', 'head', 'tail'])[p_size % 9 + 1] AS joint FROM part)
SELECT id, CASE WHEN contains(joint, 'tail') THEN 'other' WHEN starts_with(joint, 'left_') THEN 'left_' || substr(joint, 6) WHEN starts_with(joint, 'right_') THEN 'right_' || substr(joint, 7) ELSE 'center_' || joint END AS part FROM j""")
def split_side_groups(spark, sf_dir):
    """Waist and head as parts of their own."""
    parts = F.array(*map(F.lit, ("shoulder", "elbow", "wrist", "hip", "knee", "ankle", "waist", "head", "tail")))
    joint = F.concat(F.when(F.col("p_partkey") % 3 == 0, "left_").when(F.col("p_partkey") % 3 == 1, "right_").otherwise(""), F.get(parts, F.col("p_size") % 9))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), N.side_group(joint, torso="split").alias("part"))


@query("label_leaves", "SELECT page_id AS id, split_part(url, '/', -1) AS leaf, CASE WHEN contains(url, '/') AND starts_with(replace(url, 'https', 'http'), 'http:') THEN split_part(url, '/', 1) END AS first FROM pages")
def label_leaves(spark, sf_dir):
    """What follows the last slash; the category rule for paths that are not of the seed set."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), N.leaf(F.col("url")).alias("leaf"), N.path_parts(F.col("url"), "category")["category"].alias("first"))


@query("subset_thresholds", "SELECT c_custkey AS id, (c_custkey % 7)::DOUBLE AS gait, NULL::DOUBLE AS bad, 3.0::DOUBLE AS height FROM customer")
def subset_thresholds(spark, sf_dir):
    """Thresholds are the numbers as they are."""
    m = N.thresholds_of(F.concat(F.lit("gait="), F.col("c_custkey") % 7, F.lit(",bad=x,height=3")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), m["gait"].alias("gait"), m["bad"].alias("bad"), m["height"].alias("height"))


@query("motion_extrema", f"""WITH {TRACE}, s AS (SELECT motion, frame, {WRAP.format("q - lag(q) OVER w")} AS dq FROM trace WINDOW w AS (PARTITION BY motion ORDER BY frame)), a AS (SELECT *, (dq * 30 - lag(dq * 30) OVER w) * 30 AS acc FROM s WINDOW w AS (PARTITION BY motion ORDER BY frame))
SELECT motion, round(coalesce(max(abs(dq)), 0), 6) AS max_dq, round(coalesce(max(abs(dq * 30)), 0), 4) AS max_vel, round(coalesce(max(abs(acc)), 0), 3) AS max_acc FROM a GROUP BY motion""")
def motion_extrema(spark, sf_dir):
    out = A.motion_extrema(trace(spark, sf_dir), ["motion"], FPS)
    return out.select("motion", r6(F.col("max_dq"), "max_dq"), F.round("max_vel", 4).alias("max_vel"), F.round("max_acc", 3).alias("max_acc"))


@query("plain_derivatives", f"""WITH {TRACE}, v AS (SELECT motion, frame, coalesce((q - lag(q) OVER w) * 30, 0) AS vel, (q - lag(q) OVER w) * 30 AS short FROM trace WINDOW w AS (PARTITION BY motion ORDER BY frame))
SELECT motion, frame, round(vel, 4) AS vel, round(coalesce((vel - lag(vel) OVER w) * 30, 0), 3) AS acc, round((short - lag(short) OVER w) * 30, 3) AS short_acc FROM v WINDOW w AS (PARTITION BY motion ORDER BY frame)""")
def plain_derivatives(spark, sf_dir):
    """Without wrapping, padded with zeros, and shortened (null where a neighbour lacks)."""
    rows = S.plain_derivatives(trace(spark, sf_dir), ["motion"], FPS)
    return rows.select("motion", "frame", F.round("vel", 4).alias("vel"), F.round("acc", 3).alias("acc"), F.round("short_acc", 3).alias("short_acc"))


@query("strided_frames", f"WITH {TRACE} SELECT motion, frame, joint FROM trace WHERE frame % 4 = 0 AND frame < 40 AND motion NOT IN (SELECT DISTINCT user_id FROM events WHERE user_id % 5 = 2)")
def strided_frames(spark, sf_dir):
    """Every fourth of the first forty frames of the motions whose subset is not passed over."""
    rows = trace(spark, sf_dir)
    return J.without_subsets(J.first_frames(J.every_nth(rows, 4), 40), rows.where("motion % 5 = 2").select("motion").distinct(), ["motion"]).select("motion", "frame", "joint")


@query("probable_slices", f"""WITH {JUMPS}, m AS (SELECT motion, count(*) FILTER (WHERE kind = 'probable_branch_switch') AS probable, max(abs_dq) AS dq, max(abs(acc)) AS acc FROM jumps GROUP BY motion)
SELECT motion, probable, round(dq, 6) AS dq FROM m WHERE probable > 0 AND ('set' || motion % 3) LIKE 'set1%' ORDER BY probable DESC, dq DESC, acc DESC, motion LIMIT 12""")
def probable_slices(spark, sf_dir):
    """The worst probable motions of subsets with a prefix: a report of the first twelve."""
    found = jumps(spark, sf_dir).groupBy("motion").agg(F.count_if(F.col("kind") == "probable_branch_switch").alias("probable"), F.max("abs_dq").alias("dq"), F.max(F.abs("acc")).alias("acc"))
    chosen = found.where((F.col("probable") > 0) & F.startswith(F.concat(F.lit("set"), F.col("motion") % 3), F.lit("set1")))
    return J.first_rows(chosen, [F.desc("probable"), F.desc("dq"), F.desc("acc"), F.col("motion")], 12).select("motion", "probable", r6(F.col("dq"), "dq"))


CHANGES = "d AS (SELECT l_suppkey AS supplier, avg(l_discount) FILTER (WHERE l_returnflag = 'R') AS a, avg(l_discount) FILTER (WHERE l_returnflag <> 'R') AS b FROM lineitem GROUP BY l_suppkey), c AS (SELECT supplier, round((a - b) / b * 100, 6) AS delta FROM d WHERE a IS NOT NULL AND b > 0)"


@query("regressions_and_gains", f"WITH {CHANGES} (SELECT 'regression' AS kind, supplier, delta FROM c ORDER BY delta DESC, supplier LIMIT 30) UNION ALL (SELECT 'improvement', supplier, delta FROM c ORDER BY delta, supplier LIMIT 30)")
def regressions_and_gains(spark, sf_dir):
    """The thirty largest changes in either direction: a report."""
    returned = F.col("l_returnflag") == "R"
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(F.avg(F.when(returned, F.col("l_discount"))).alias("a"), F.avg(F.when(~returned, F.col("l_discount"))).alias("b"))
    c = d.where("a IS NOT NULL AND b > 0").select("supplier", r6((F.col("a") - F.col("b")) / F.col("b") * 100, "delta"))
    worst, best = (J.first_rows(c, [o, F.col("supplier")], 30) for o in (F.desc("delta"), F.col("delta")))
    return worst.withColumn("kind", F.lit("regression")).unionByName(best.withColumn("kind", F.lit("improvement")))


@query("lost_dimensions", """WITH f AS (SELECT p_brand AS feature, CASE WHEN p_brand < 'Brand#3' THEN 'dynamics' ELSE 'other' END AS grp, (max(p_retailprice) FILTER (WHERE p_size > 10) - min(p_retailprice) FILTER (WHERE p_size > 10)) / (max(p_retailprice) - min(p_retailprice)) AS kept FROM part GROUP BY ALL)
(SELECT 'all' AS list, feature, round(kept, 6) AS kept FROM f ORDER BY round(kept, 12), feature LIMIT 10) UNION ALL (SELECT 'dynamics', feature, round(kept, 6) FROM f WHERE grp = 'dynamics' ORDER BY round(kept, 12), feature LIMIT 10)""")
def lost_dimensions(spark, sf_dir):
    """The features that lost most of their range, of all and of one group: reports of ten."""
    big = F.col("p_size") > 10
    price = F.col("p_retailprice")
    span = lambda x: F.max(x) - F.min(x)
    f = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("feature")).agg((span(F.when(big, price)) / span(price)).alias("kept"))
    order = [F.round("kept", 12), F.col("feature")]
    lists = [J.first_rows(f, order, 10).withColumn("list", F.lit("all")), J.first_rows(f.where(F.col("feature") < "Brand#3"), order, 10).withColumn("list", F.lit("dynamics"))]
    return lists[0].unionByName(lists[1]).select("list", "feature", r6(F.col("kept"), "kept"))


@query("largest_first", "SELECT doc_id, size, row_number() OVER (ORDER BY size DESC, doc_id) AS place FROM (SELECT doc_id, strlen(coalesce(text, '')) AS size FROM documents) QUALIFY place <= 25")
def largest_first(spark, sf_dir):
    """Work in order of size, the largest first: the first twenty-five of a run, by path."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    w = Window.orderBy(F.desc("size"), "doc_id")
    return J.first_rows(d, [F.desc("size"), F.col("doc_id")], 25).withColumn("place", F.row_number().over(w).cast("long"))


@query("shared_features", "SELECT unnest(['gait__a', 'range__b']) AS feature, unnest([0, 1]) AS place")
def shared_features(spark, sf_dir):
    """Feature columns that two tables share, in the first one's order."""
    t = table(spark, sf_dir, "region")
    a, b = (t.select(*[F.col("r_regionkey").alias(c) for c in cs]) for cs in (("gait__a", "id", "range__b", "height__c"), ("range__b", "gait__a", "id")))
    return spark.createDataFrame([(c, i) for i, c in enumerate(J.shared_columns(a, b))], "feature string, place int")


@query("moved_effectors", f"WITH {EFFECTORS} SELECT pose, joint, round(x + 0.1, 6) AS x, round(y - 0.2, 6) AS y, round(z + 0.35, 6) AS z FROM effectors")
def moved_effectors(spark, sf_dir):
    """The root's offset and the ground's height on all effectors."""
    out = X.offset_effectors(X.scaled_effectors(human_poses(spark, sf_dir), mapped_joints(spark), ["pose"], "hip"), (0.1, -0.2, 0.3), 0.05)
    return out.select("pose", "joint", *[r6(F.col(f"t.p.{a}"), a) for a in "xyz"])


PREVIEW = f"""{UNIT}, m(kind, joint) AS (VALUES (0, 'hip'), (1, 'hand'), (2, 'foot')), j AS (SELECT id // 3 AS pose, joint, 0.05 * abs(e11) * 3 AS pe, abs(degrees(e12 / 2)) AS re FROM u JOIN m ON id % 3 = kind),
w AS (SELECT *, pe > 0.05 OR re > 15 AS warning FROM j)"""


def preview(spark, sf_dir):
    poses = human_poses(spark, sf_dir)
    at = vectors(spark, sf_dir).select(F.floor(F.col("id") / 3).alias("pose"), F.element_at(F.array(*map(F.lit, ("hip", "hand", "foot"))), (F.col("id") % 3 + 1).cast("int")).alias("joint"), "e11", "e12")
    rows = poses.join(at, ["pose", "joint"])
    moved = R.vec(F.col("t.p.x") + F.col("e11") * 0.15, F.col("t.p.y"), F.col("t.p.z"))
    turned_ = R.product(F.col("t.q"), R.about(R.vec(F.lit(0.0), F.lit(0.0), F.lit(1.0)), F.col("e12") / 2))
    bodies = rows.select("pose", F.concat(F.lit("b_"), "joint").alias("body"), R.transform(moved, turned_).alias("t"))
    mapping = spark.createDataFrame([(j, f"b_{j}", f"b_{j}") for j in ("hip", "hand", "foot")], "joint string, t_body string, r_body string")
    return X.preview_report(poses, bodies, mapping, ["pose"])


@query("preview_joints", f"WITH {PREVIEW} SELECT pose, joint, round(pe, 6) AS position_error, round(re, 3) AS rotation_error, warning FROM w")
def preview_joints(spark, sf_dir):
    """Errors of mapped joints with their warnings."""
    return preview(spark, sf_dir)[0].select("pose", "joint", r6(F.col("position_error"), "position_error"), F.round("rotation_error", 3).alias("rotation_error"), "warning")


@query("preview_summary", f"WITH {PREVIEW} SELECT pose, round(avg(pe), 6) AS mean_position_error, round(max(re), 3) AS max_rotation_error, arg_max(joint, pe + re / 100) AS worst_joint, count(*) FILTER (WHERE warning) AS warnings FROM w GROUP BY pose")
def preview_summary(spark, sf_dir):
    return preview(spark, sf_dir)[1].select("pose", r6(F.col("mean_position_error"), "mean_position_error"), F.round("max_rotation_error", 3).alias("max_rotation_error"), "worst_joint", "warnings")


@query("sampled_poses", f"""WITH {TRACE}, n AS (SELECT *, coalesce(lead(q) OVER w, q) AS nq, count(*) OVER (PARTITION BY motion) AS n FROM trace WINDOW w AS (PARTITION BY motion ORDER BY frame)),
t AS (SELECT motion, n, k, (k * 0.37) AS tm FROM (SELECT DISTINCT motion, n FROM n), range(0, 8) r(k)), f AS (SELECT *, greatest(0, least(tm * 30, (n - 1)::DOUBLE)) AS p FROM t), g AS (SELECT *, least(floor(p), greatest(n - 2, 0))::BIGINT AS fr FROM f),
u AS (SELECT g.motion, g.k, g.p - g.fr AS b, n.q, n.nq FROM g JOIN n ON n.motion = g.motion AND n.frame = g.fr) SELECT motion, k, round(q + (nq - q) * b, 5) AS q, round((q + (nq - q) * b) * 0.01, 6) AS x, round(sin((q + (nq - q) * b) / 1931.7), 4) AS qz FROM u""")
def sampled_poses(spark, sf_dir):
    """Poses at times between frames; turns about z, whose arc is linear in the angle."""
    from stridelake.operators import motion as Y

    half = F.col("q") / 1931.7
    rows = trace(spark, sf_dir).select("motion", "frame", R.vec(F.col("q") * 0.01, F.lit(0.0), F.lit(0.0)).alias("p"), R.quat(F.lit(0.0), F.lit(0.0), F.sin(half), F.cos(half)).alias("q"), F.col("q").alias("knee"))
    times = rows.select("motion").distinct().select("motion", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).select("motion", F.col("k").cast("long").alias("k"), (F.col("k") * 0.37).alias("at"))
    out = Y.sampled_poses(rows, times, "motion", FPS, ["knee"])
    return out.select("motion", "k", F.round("knee", 5).alias("q"), r6(F.col("p.x"), "x"), F.round("q.z", 4).alias("qz"))


@query("adjacent_speeds", f"WITH {UNIT}, q AS (SELECT id % 5 AS motion, row_number() OVER (PARTITION BY id % 5 ORDER BY id) - 1 AS frame, ax, ay, az, aw FROM u), d AS (SELECT motion, frame, degrees(2 * acos(least(1, abs(ax * lag(ax) OVER w + ay * lag(ay) OVER w + az * lag(az) OVER w + aw * lag(aw) OVER w)))) * 30 AS speed, lag(ax) OVER w AS p FROM q WINDOW w AS (PARTITION BY motion ORDER BY frame)) SELECT motion, frame, round(speed, 3) AS speed FROM d WHERE p IS NOT NULL")
def adjacent_speeds(spark, sf_dir):
    """Degrees per second between neighbouring rotations, shortened."""
    from stridelake.plans.grouped import quaternions

    rows = quaternions(spark, sf_dir)
    before = F.lag("q").over(S.over(["motion"]))
    speeds = rows.withColumn("before", before).where("before IS NOT NULL")
    return speeds.select("motion", "frame", F.round(R.angle_between(F.col("q"), F.col("before")) * FPS, 3).alias("speed"))
