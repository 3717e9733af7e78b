"""Queries over rotations, geometry, strings and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridelake.functions import names as N
from stridelake.functions import rotations as R
from stridelake.functions.angles import centimetres, metres, number_or, wrap_radians
from stridelake.plans.base import TRACE, query, table, trace
from stridelake.plans.series import r6

VEC = "v AS (SELECT vec_id AS id, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(20)) + " FROM embeddings)"
UNIT = f"""{VEC}, u AS (SELECT *, e0 / na AS ax, e1 / na AS ay, e2 / na AS az, e3 / na AS aw, e4 / nb AS bx, e5 / nb AS by_, e6 / nb AS bz, e7 / nb AS bw FROM (
  SELECT *, sqrt(e0 * e0 + e1 * e1 + e2 * e2 + e3 * e3) AS na, sqrt(e4 * e4 + e5 * e5 + e6 * e6 + e7 * e7) AS nb FROM v))"""


def matrix(p: str) -> list[list[str]]:
    """Rotation matrix of the quaternion (px, py, pz, pw) as SQL: an own way to the same turns."""
    x, y, z, w = f"{p}x", f"{p}y" if p != "b" else "by_", f"{p}z", f"{p}w"
    return [
        [f"(1 - 2 * ({y} * {y} + {z} * {z}))", f"(2 * ({x} * {y} - {z} * {w}))", f"(2 * ({x} * {z} + {y} * {w}))"],
        [f"(2 * ({x} * {y} + {z} * {w}))", f"(1 - 2 * ({x} * {x} + {z} * {z}))", f"(2 * ({y} * {z} - {x} * {w}))"],
        [f"(2 * ({x} * {z} - {y} * {w}))", f"(2 * ({y} * {z} + {x} * {w}))", f"(1 - 2 * ({x} * {x} + {y} * {y}))"],
    ]


A, B = matrix("a"), matrix("b")
V8 = ("e8", "e9", "e10")


def turned(m, v, back: bool = False) -> list[str]:
    return ["(" + " + ".join(f"{m[j][i] if back else m[i][j]} * {v[j]}" for j in range(3)) + ")" for i in range(3)]


def sql_columns(parts: list[str], names: list[str]) -> str:
    return ", ".join(f"round({p}, 6) AS {n}" for p, n in zip(parts, names))


def vectors(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *[e[i].cast("double").alias(f"e{i}") for i in range(20)])


def quats():
    a, b = (R.normalised(R.quat(*[F.col(f"e{i}") for i in range(k, k + 4)])) for k in (0, 4))
    return a, b


def vector(k: int = 8):
    return R.vec(*[F.col(f"e{i}") for i in range(k, k + 3)])


def spread(df, value, names: list[str], fields: str = "xyz"):
    return df.select("id", *[r6(value[f], n) for f, n in zip(fields, names)])


@query("quat_angles", f"""WITH {UNIT} SELECT id, round(degrees(2 * acos(least(1, abs(aw)))), 5) AS angle, round(degrees(2 * acos(least(1, abs(ax * bx + ay * by_ + az * bz + aw * bw)))), 5) AS between_,
 {", ".join(f"round(sign(aw) * a{c} / sqrt(1 - aw * aw) * 2 * acos(least(1, abs(aw))), 5) AS r{c}" for c in "xyz")} FROM u""")
def quat_angles(spark, sf_dir):
    a, b = quats()
    five = lambda c, n: F.round(c, 5).alias(n)
    return vectors(spark, sf_dir).select("id", five(R.angle_degrees(a), "angle"), five(R.angle_between(a, b), "between_"), *[five(R.rotation_vector(a)[c], f"r{c}") for c in "xyz"])


@query("quat_product", f"""WITH {UNIT} SELECT id, {sql_columns(["aw * bx + ax * bw + ay * bz - az * by_", "aw * by_ + ay * bw + az * bx - ax * bz", "aw * bz + az * bw + ax * by_ - ay * bx", "aw * bw - ax * bx - ay * by_ - az * bz"], ["x", "y", "z", "w"])} FROM u""")
def quat_product(spark, sf_dir):
    return spread(vectors(spark, sf_dir), R.product(*quats()), ["x", "y", "z", "w"], "xyzw")


@query("rotate_vector", f"WITH {UNIT} SELECT id, {sql_columns(turned(A, V8), ['x', 'y', 'z'])}, {sql_columns(turned(A, V8, True), ['bx', 'by', 'bz'])} FROM u")
def rotate_vector(spark, sf_dir):
    a, _ = quats()
    there, back = R.rotate(a, vector()), R.rotate_back(a, vector())
    return vectors(spark, sf_dir).select("id", *[r6(there[f], f) for f in "xyz"], *[r6(back[f], f"b{f}") for f in "xyz"])


def trig(i: int) -> str:
    return f"cos(radians(e{i} * 180) / 2) AS c{i}, sin(radians(e{i} * 180) / 2) AS s{i}"


@query("euler_to_quat", f"""WITH {VEC}, t AS (SELECT id, {trig(11)}, {trig(12)}, {trig(13)} FROM v) SELECT id, {sql_columns(
    ["s11 * c12 * c13 + c11 * s12 * s13", "c11 * s12 * c13 - s11 * c12 * s13", "c11 * c12 * s13 + s11 * s12 * c13", "c11 * c12 * c13 - s11 * s12 * s13"], ["x", "y", "z", "w"])} FROM t""")
def euler_to_quat(spark, sf_dir):
    q = R.from_euler("xyz", [F.col(f"e{i}") * 180 for i in (11, 12, 13)])
    return spread(vectors(spark, sf_dir), q, ["x", "y", "z", "w"], "xyzw")


@query("quat_to_euler", f"""WITH {UNIT} SELECT id, {sql_columns([f"degrees(atan2({A[2][1]}, {A[2][2]}))", f"degrees(asin(greatest(-1, least(1, -{A[2][0]}))))", f"degrees(atan2({A[1][0]}, {A[0][0]}))"], ["x", "y", "z"])} FROM u""")
def quat_to_euler(spark, sf_dir):
    return spread(vectors(spark, sf_dir), R.to_euler_extrinsic_xyz(quats()[0]), ["x", "y", "z"])


ARC = f"""{UNIT}, d AS (SELECT *, ax * bx + ay * by_ + az * bz + aw * bw AS d FROM u), s AS (SELECT *, acos(least(1, abs(d))) AS th, CASE WHEN d < 0 THEN -1 ELSE 1 END AS sg FROM d),
w AS (SELECT *, CASE WHEN abs(d) > 0.9995 THEN 0.7 ELSE sin(0.7 * th) / sin(th) END AS wa, sg * CASE WHEN abs(d) > 0.9995 THEN 0.3 ELSE sin(0.3 * th) / sin(th) END AS wb FROM s)"""


@query("slerp", f"WITH {ARC} SELECT id, {sql_columns(['(wa * ax + wb * bx) / n', '(wa * ay + wb * by_) / n', '(wa * az + wb * bz) / n', '(wa * aw + wb * bw) / n'], ['x', 'y', 'z', 'w'])} FROM (SELECT *, sqrt((wa * ax + wb * bx) ** 2 + (wa * ay + wb * by_) ** 2 + (wa * az + wb * bz) ** 2 + (wa * aw + wb * bw) ** 2) AS n FROM w)")
def slerp(spark, sf_dir):
    return spread(vectors(spark, sf_dir), R.slerp(*quats(), F.lit(0.3)), ["x", "y", "z", "w"], "xyzw")


P = [f"({t} + e{11 + i})" for i, t in enumerate(turned(A, V8))]


@query("transform_compose", f"WITH {UNIT} SELECT id, {sql_columns(P, ['x', 'y', 'z'])}, {sql_columns([f'(-{t})' for t in turned(A, ('e11', 'e12', 'e13'), True)], ['ix', 'iy', 'iz'])}, {sql_columns(['aw * bx + ax * bw + ay * bz - az * by_', 'aw * by_ + ay * bw + az * bx - ax * bz', 'aw * bz + az * bw + ax * by_ - ay * bx', 'aw * bw - ax * bx - ay * by_ - az * bz', '-ay', 'aw'], ['qx', 'qy', 'qz', 'qw', 'iqy', 'iqw'])} FROM u")
def transform_compose(spark, sf_dir):
    a, b = quats()
    ta, tb = R.transform(vector(11), a), R.transform(vector(8), b)
    whole, inverse = R.compose(ta, tb), R.inverse(ta)
    both, back = whole["p"], inverse["p"]
    turns = [r6(whole["q"][f], f"q{f}") for f in "xyzw"] + [r6(inverse["q"][f], f"iq{f}") for f in "yw"]
    return vectors(spark, sf_dir).select("id", *[r6(both[f], f) for f in "xyz"], *[r6(back[f], f"i{f}") for f in "xyz"], *turns)


@query("twist_and_plane", f"""WITH {UNIT}, t AS (SELECT *, 0.6 * ax + 0.8 * az AS p, 0.6 * e8 + 0.8 * e10 AS d FROM u) SELECT id, round(0.8 * p / sqrt(p * p + aw * aw), 6) AS tz, round(aw / sqrt(p * p + aw * aw), 6) AS tw, round(e8 - 0.6 * d, 6) AS px, round(e9, 6) AS py, round(e10 - 0.8 * d, 6) AS pz,
 abs(ax * bx + ay * by_ + az * bz + aw * bw) >= 0.5 AS same_turn, sqrt((e8 - e11) ** 2 + (e9 - e12) ** 2 + (e10 - e13) ** 2) <= 0.3 AS same_place FROM t""")
def twist_and_plane(spark, sf_dir):
    axis = R.vec(F.lit(0.6), F.lit(0.0), F.lit(0.8))
    a, b = quats()
    t, p = R.twist(a, axis), R.onto_plane(vector(), axis)
    same = [R.same_rotation(a, b, 0.5).alias("same_turn"), R.same_position(vector(), vector(11), 0.3).alias("same_place")]
    return vectors(spark, sf_dir).select("id", r6(t["z"], "tz"), r6(t["w"], "tw"), r6(p["x"], "px"), r6(p["y"], "py"), r6(p["z"], "pz"), *same)


@query("space_conversion", f"WITH {VEC} SELECT id, round(e8, 6) AS mx, round(-e10, 6) AS my, round(e9, 6) AS mz, round(e10, 6) AS ax, round(e8, 6) AS ay, round(e9, 6) AS az, round(e8, 6) AS back FROM v")
def space_conversion(spark, sf_dir):
    m, a = R.to_space("mujoco", vector()), R.to_space("maya", vector())
    return vectors(spark, sf_dir).select("id", *[r6(m[f], f"m{f}") for f in "xyz"], *[r6(a[f], f"a{f}") for f in "xyz"], r6(R.to_space("maya", a, back=True)["x"], "back"))


HEAD = [f"(-{A[i][1]})" for i in range(3)]


@query("floor_root", f"WITH {UNIT} SELECT id, round(e8, 6) AS x, round(e9, 6) AS y, round(degrees(atan2({HEAD[0]}, -{HEAD[1]})), 5) AS heading, round(e10, 6) AS rest_z, 0.0::DOUBLE AS rest_x FROM u")
def floor_root(spark, sf_dir):
    a, _ = quats()
    found = R.floor_root(R.transform(vector(), a))
    q = found["root"]["q"]
    turn = F.degrees(2 * F.atan2(q["z"], q["w"]))
    return vectors(spark, sf_dir).select("id", r6(found["root"]["p"]["x"], "x"), r6(found["root"]["p"]["y"], "y"), F.round(turn, 5).alias("heading"), r6(found["rest"]["p"]["z"], "rest_z"), F.abs(F.round(found["rest"]["p"]["x"], 6)).alias("rest_x"))


@query("time_to_frame", """SELECT event_id AS id, least(floor(greatest(0, least(value * 0.7, 39))), 38)::BIGINT AS frame, round(greatest(0, least(value * 0.7, 39)) - least(floor(greatest(0, least(value * 0.7, 39))), 38), 6) AS blend FROM events""")
def time_to_frame(spark, sf_dir):
    at = R.time_to_frame(F.col("value") / 10, 7.0, F.lit(40))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), at["frame"].alias("frame"), r6(at["blend"], "blend"))


@query("limb_and_limits", """WITH q AS (SELECT event_id AS id, value / 100 AS q FROM events),
d AS (SELECT *, greatest(0.1 + 1e-6, least(0.7 - 1e-6, q / 4)) AS r, abs(q - 1) / (2 * 1.02) AS x FROM q)
SELECT id, round(degrees(acos(greatest(-1, least(1, (0.16 + 0.09 - r * r) / 0.24)))), 5) AS bend, round(least(3, greatest(-1, q)), 6) AS clamped, round(greatest(0, q - 3) + greatest(0, -1 - q), 6) AS violation,
 round(CASE WHEN x <= 1 THEN 0 ELSE 1 - exp(-pow(x, 6.5)) END, 6) AS softened FROM d""")
def limb_and_limits(spark, sf_dir):
    q, lo, hi = F.col("value") / 100, F.lit(-1.0), F.lit(3.0)
    bend = R.two_bone_bend(F.lit(0.4), F.lit(0.3), q / 4)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.round(bend, 5).alias("bend"), r6(R.clamped(q, lo, hi), "clamped"), r6(R.limit_violation(q, lo, hi), "violation"), r6(R.smooth_limit(q, lo, hi), "softened")
    )


@query("geom_extent", """WITH g AS (SELECT event_id AS id, (['capsule', 'cylinder', 'sphere', 'box', 'mesh'])[event_id % 5 + 1] AS kind, value / 100 AS z, (event_id % 11) / 10.0 AS a FROM events)
SELECT id, kind, round(CASE WHEN kind IN ('capsule', 'cylinder') THEN z - a * 0.2 - 0.05 WHEN kind = 'sphere' THEN z - 0.05 WHEN kind = 'box' THEN z - 0.3 ELSE z END, 6)::DOUBLE AS bottom,
 round(CASE WHEN kind IN ('capsule', 'cylinder') THEN z + a * 0.2 + 0.05 WHEN kind = 'sphere' THEN z + 0.05 WHEN kind = 'box' THEN z + 0.3 ELSE z END, 6)::DOUBLE AS top FROM g""")
def geom_extent(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("capsule", "cylinder", "sphere", "box", "mesh")))
    g = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.get(kinds, (F.col("event_id") % 5).cast("int")).alias("kind"), (F.col("value") / 100).alias("z"), ((F.col("event_id") % 11) / 10).alias("a"))
    sizes = (F.col("kind"), F.col("z"), F.col("a"), F.lit(0.05), F.lit(0.2), F.lit(0.1), F.lit(0.3))
    return g.select("id", "kind", r6(R.geom_bottom(*sizes), "bottom"), r6(R.geom_top(*sizes), "top"))


@query("hermite_segment", f"""WITH {VEC}, u AS (SELECT *, (id % 13) / 12.0::DOUBLE AS u FROM v)
SELECT id, round(e0 + (e1 - e0) * u, 6) AS linear, round((1 + 2 * u) * (1 - u) ** 2 * e0 + u * (1 - u) ** 2 * e2 + u * u * (3 - 2 * u) * e1 + u * u * (u - 1) * e3, 6) AS cubic,
 round((1 - u ** 3 * (10 - 15 * u + 6 * u * u)) * e0 + u ** 3 * (10 - 15 * u + 6 * u * u) * e1 + (u - 6 * u ** 3 + 8 * u ** 4 - 3 * u ** 5) * e2 + (-4 * u ** 3 + 7 * u ** 4 - 3 * u ** 5) * e3, 6) AS quintic FROM u""")
def hermite_segment(spark, sf_dir):
    u, (p0, p1, m0, m1) = (F.col("id") % 13) / F.lit(12.0), (F.col(f"e{i}") for i in range(4))
    zero = F.lit(0.0)
    return vectors(spark, sf_dir).select("id", r6(p0 + (p1 - p0) * u, "linear"), r6(R.cubic_hermite(u, p0, p1, m0, m1), "cubic"), r6(R.quintic_hermite(u, p0, p1, m0, m1, zero, zero), "quintic"))


@query("stance_confidence", f"WITH {VEC} SELECT id, round(exp(-abs(e0) / 0.05) * exp(-((e1 / 0.02) ** 2)) * exp(-((e2 / 0.2) ** 2)), 6) AS confidence FROM v")
def stance_confidence(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", r6(R.stance_confidence(F.abs("e0"), F.col("e1"), F.col("e2")), "confidence"))


@query("unit_conversion", f"""WITH {TRACE} SELECT motion, frame, round(q * 0.01, 6) AS m, round(q * 0.01 * 100, 6) AS cm, round(radians(q), 6) AS rad, round(radians(q) + pi() - 2 * pi() * floor((radians(q) + pi()) / (2 * pi())) - pi(), 6) AS wrapped FROM trace""")
def unit_conversion(spark, sf_dir):
    q = F.col("q")
    return trace(spark, sf_dir).select("motion", "frame", r6(metres(q), "m"), r6(centimetres(metres(q)), "cm"), r6(F.radians(q), "rad"), r6(wrap_radians(F.radians(q)), "wrapped"))


@query("coordinate_rows", f"""WITH {VEC} SELECT id, id // 10 AS pose, round_even(e8 - first_value(e8) OVER w, 6) AS x, round_even(e9 - first_value(e9) OVER w, 6) AS y FROM v WINDOW w AS (PARTITION BY id // 10 ORDER BY id)""")
def coordinate_rows(spark, sf_dir):
    """Coordinates relative to the root joint of each pose, rounded half to even."""
    from pyspark.sql import Window

    w = Window.partitionBy("pose").orderBy("id")
    rows = vectors(spark, sf_dir).withColumn("pose", F.floor(F.col("id") / 10))
    return rows.select("id", "pose", *[F.bround(F.col(c) - F.first(c).over(w), 6).alias(n) for c, n in (("e8", "x"), ("e9", "y"))])


@query("text_numbers", """SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN -1.0 ELSE round(value, 6) END AS x FROM events""")
def text_numbers(spark, sf_dir):
    """Numbers from text; empty, unparsable and non-finite ones get the default."""
    kinds = F.when(F.col("event_id") % 21 == 0, "").when(F.col("event_id") % 21 == 7, "abc").when(F.col("event_id") % 21 == 14, "NaN").otherwise(F.col("value").cast("string"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), r6(number_or(kinds, -1.0), "x"))


PATHS = """p AS (SELECT p_partkey AS id, (['seed', 'grab', 'nutan', 'walks'])[p_partkey % 4 + 1] || '/' || lower(p_type) || '/' || lower(replace(p_brand, '#', '')) || '/' || replace(p_name, ' ', '_') || '__A' || p_size || (CASE WHEN p_partkey % 2 = 0 THEN '_M' ELSE '' END) || '.csv' AS path FROM part)"""


def paths(spark, sf_dir):
    c = F.col
    kinds = F.array(*map(F.lit, ("seed", "grab", "nutan", "walks")))
    stem = F.concat(F.replace(c("p_name"), F.lit(" "), F.lit("_")), F.lit("__A"), c("p_size"), F.when(c("p_partkey") % 2 == 0, "_M").otherwise(""))
    path = F.concat_ws("/", F.get(kinds, (c("p_partkey") % 4).cast("int")), F.lower("p_type"), F.lower(F.replace(c("p_brand"), F.lit("#"), F.lit(""))), F.concat(stem, F.lit(".csv")))
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), path.alias("path"))


@query("path_metadata", f"""WITH {PATHS}, s AS (SELECT id, split_part(path, '/', 1) AS a, split_part(path, '/', 2) AS b FROM p)
SELECT id, a AS dataset, CASE WHEN a = 'seed' THEN b ELSE a END AS category, b AS subcategory, CASE WHEN a IN ('seed', 'grab') THEN b ELSE a END AS dataset_subset,
  CASE WHEN a IN ('seed', 'grab') THEN b WHEN a = 'nutan' THEN 'nutan' ELSE '' END AS flat_subset, CASE WHEN a IN ('seed', 'grab') THEN b ELSE '' END AS blank_subset, 'nutan' AS bare_dataset FROM s""")
def path_metadata(spark, sf_dir):
    path = F.col("path")
    subsets = [N.path_parts(path, mode)["subset"].alias(f"{mode}_subset") for mode in ("dataset", "flat", "blank")]
    bare = N.path_parts(N.leaf(path), "flat")["dataset"].alias("bare_dataset")
    return paths(spark, sf_dir).select("id", *[v.alias(k) for k, v in N.path_parts(path).items()], *subsets, bare)


@query("stem_and_key", f"""WITH {PATHS}, s AS (SELECT id, path, regexp_replace(split_part(path, '/', 4), '\\.csv$', '') AS stem FROM p)
SELECT id, regexp_replace(regexp_replace(stem, '_M$', ''), '__A[0-9]+$', '') AS family_stem, split_part(path, '/', 3) || '/' || stem AS match_key, stem || '_csv' AS safe FROM s""")
def stem_and_key(spark, sf_dir):
    stem = F.regexp_replace(N.leaf(F.col("path")), r"\.csv$", "")
    marked = F.regexp_replace("path", "^[^/]+/[^/]+/", "ok_only_csv/")
    return paths(spark, sf_dir).select("id", N.without_actor(stem).alias("family_stem"), N.match_key(marked, "ok_only_csv", "body_motion").alias("match_key"), N.safe_name(F.concat(stem, F.lit(" :csv/ "))).alias("safe"))


KEYWORDS = ("walk", "red", "green", "blue", "run")


@query("family_name", """WITH n AS (SELECT p_partkey AS id, lower(p_name) AS name FROM part), h AS (SELECT *, list_filter(['walk', 'red', 'green', 'blue', 'run'], lambda k: contains(name, k)) AS hits,
 list_filter(string_split_regex(name, '[^a-z0-9]+'), lambda t: t <> '' AND NOT regexp_full_match(t, '[0-9]+') AND t NOT IN ('l', 'r')) AS tokens FROM n)
SELECT id, CASE WHEN len(hits) > 0 THEN array_to_string(hits[1:3], '+') ELSE array_to_string(tokens[1:3], '_') END AS family, len(list_filter(['red', 'stand'], lambda k: contains(name, k))) > 0 AS low_dynamic FROM h""")
def family_name(spark, sf_dir):
    name = F.lower("p_name")
    low = F.exists(F.array(F.lit("red"), F.lit("stand")), lambda k: F.contains(name, k))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), N.family(F.col("p_name"), KEYWORDS).alias("family"), low.alias("low_dynamic"))


@query("metric_parse", """WITH m AS (SELECT p_partkey AS id, 'position/' || p_type || (CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '->' || p_brand END) AS metric, (CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'gait__' END) || p_type AS feature, (CASE WHEN p_partkey % 2 = 0 THEN 'Left' ELSE 'Right' END) || 'Hand' AS joint FROM part)
SELECT id, 'position' AS error_type, split_part(split_part(metric, '/', 2), '->', 1) AS body, split_part(metric, '->', 2) AS joint, CASE WHEN contains(feature, '__') THEN 'gait' ELSE 'unknown' END AS feature_group, CASE WHEN joint = 'LeftHand' THEN 'RightHand' ELSE 'LeftHand' END AS partner FROM m""")
def metric_parse(spark, sf_dir):
    c = F.col
    m = table(spark, sf_dir, "part").select(
        c("p_partkey").alias("id"), F.concat(F.lit("position/"), c("p_type"), F.when(c("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("->"), c("p_brand")))).alias("metric"),
        F.concat(F.when(c("p_partkey") % 5 == 0, "").otherwise("gait__"), c("p_type")).alias("feature"), F.concat(F.when(c("p_partkey") % 2 == 0, "Left").otherwise("Right"), F.lit("Hand")).alias("hand"),
    )
    return m.select("id", *[v.alias(k) for k, v in N.metric_parts(c("metric")).items()], N.feature_group(c("feature")).alias("feature_group"), N.mirrored_joint(c("hand")).alias("partner"))


@query("weight_maps", """SELECT c_custkey AS id, round((c_custkey % 7 + 1) / ((c_custkey % 7 + 1) + 3.0), 6)::DOUBLE AS gait, round(3 / ((c_custkey % 7 + 1) + 3.0), 6)::DOUBLE AS height FROM customer""")
def weight_maps(spark, sf_dir):
    m = N.weights_of(F.concat(F.lit("gait="), F.col("c_custkey") % 7 + 1, F.lit(",height=3")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), r6(m["gait"], "gait"), r6(m["height"], "height"))


@query("review_stamps", """SELECT o_orderkey AS id, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS stamp, epoch(o_orderdate)::BIGINT AS seconds FROM orders""")
def review_stamps(spark, sf_dir):
    """Folder stamps to times and back; unparsable stamps are null."""
    stamp = F.date_format("o_orderdate", "yyyyMMdd_HHmmss")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), stamp.alias("stamp"), F.unix_timestamp(F.try_to_timestamp(stamp, F.lit("yyyyMMdd_HHmmss"))).alias("seconds"))


@query("event_props", """SELECT event_id AS id, (props->>'$.k')::BIGINT AS k FROM events""")
def event_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").try_cast("long").alias("k"))
