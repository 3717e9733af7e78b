"""Queries from joint values and nested model files to poses of bodies, and the operators that start from these."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridelake.functions import rotations as R
from stridelake.operators import chains as C
from stridelake.operators import kinematics as N
from stridelake.plans.base import ORACLE_SQL, TRACE, query, table, trace
from stridelake.plans.detection import LIMBS, evidence_rows, last_value
from stridelake.plans.files import FILES, motions
from stridelake.plans.series import FPS, r6
from stridelake.sources import models as M
from stridelake.sources import motion_files as MF
from stridelake.sources import sinks as K
from stridelake.storage import shared_dir

WAIST = MF.LAYOUTS["humanoid_waist"]


def model_text(rows, name: str = "model"):
    """One XML text per model of rows ``(model, i, opened, closed)``: the tags that open at i, and how many bodies close after it."""
    closing = F.repeat(F.lit("</body>"), F.col("closed"))
    inner = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", F.concat("opened", closing).alias("x")))), lambda s: s["x"]), "\n  ")
    head = '">\n<!-- <body name="not one"> -->\n<compiler angle="degree"/>\n<default><joint axis="1 0 0"/></default>\n<worldbody>\n  '
    return rows.groupBy("model").agg(F.concat(F.lit('<mujoco model="'), F.first("model"), F.lit(head), inner, F.lit('\n</worldbody>\n<actuator><joint name="x"/></actuator>\n</mujoco>')).alias("value"))


def read_back(texts):
    """Bodies and joints of the models, through a file of each."""
    spark = texts.sparkSession
    folder = shared_dir(spark)
    texts.select("value", F.col("model").alias("of")).write.partitionBy("of").text(folder)
    return M.read_bodies(spark, folder, "*.txt"), M.read_joints(spark, folder, "*.txt")


NATIONS = """ranked AS (SELECT r_name AS model, n_name AS body, n_nationkey AS k, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation JOIN region ON n_regionkey = r_regionkey)"""


@query("model_tree", f"""WITH {NATIONS} SELECT c.model, c.body, CASE WHEN c.i > 0 THEN p.body END AS parent, CASE WHEN c.i = 0 THEN 0 ELSE (c.i + 1) // 2 END::INTEGER AS depth, c.k / 10.0 AS x, round(cos(radians(c.k)), 6) AS qw, round(sin(radians(c.k)), 6) AS qz
FROM ranked c LEFT JOIN ranked p ON p.model = c.model AND p.i = greatest(c.i - 2, 0)""")
def model_tree(spark, sf_dir):
    """Nested bodies of a model per region, two branches on a root: each body's parent, depth, place and turn."""
    i, n = F.col("i"), F.col("n")
    order = "row_number() over (partition by n_regionkey order by n_nationkey) - 1"
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select(F.col("r_name").alias("model"), "n_name", F.col("n_nationkey").alias("k"), F.expr(order).alias("rank"), F.expr("count(*) over (partition by n_regionkey)").alias("n"))
    rows = rows.withColumn("odd", F.floor(n / 2))  # in the file the branch of odd ranks comes before that of even ones
    rows = rows.withColumn("i", F.when(F.col("rank") == 0, 0).when(F.col("rank") % 2 == 1, (F.col("rank") + 1) / 2).otherwise(F.col("odd") + F.col("rank") / 2))
    last_odd, last = (i == F.col("odd")) & (i > 0), i == n - 1
    evens = n - 1 - F.col("odd")
    closed = F.when(last & last_odd, F.col("odd") + 1).when(last_odd, F.col("odd")).when(last, evens + 1).otherwise(0)
    tag = F.concat(F.lit('<body name="'), "n_name", F.lit('" pos="'), F.col("k") / 10, F.lit(' 0 0"'), F.lit(' euler="0 0 '), F.col("k") * 2, F.lit('"><geom size="1" name="a>b"/>'))
    texts = model_text(rows.select("model", "i", tag.alias("opened"), closed.cast("int").alias("closed")))
    found, _ = read_back(texts)
    return found.select("model", "body", "parent", "depth", F.col("t.p.x").alias("x"), r6(F.col("t.q.w"), "qw"), r6(F.col("t.q.z"), "qz"))


#: The humanoid of the first layout: joint i is of body i, whose parent is the body before, but for the first joints of limbs.
_AXIS = [1 if any(w in j for w in ("pitch", "knee", "elbow")) else 0 if "roll" in j else 2 for j in WAIST]
_PARENT = [-1 if i in (0, 6, 12) else 14 if i in (15, 22) else i - 1 for i in range(29)]
_CLOSED = [6 if i in (5, 11) else 7 if i == 21 else 11 if i == 28 else 0 for i in range(29)]
#: Offsets of the bodies from the table of parts.
OFFSETS = "offsets AS (SELECT p_partkey - 1 AS i, ((p_size % 7 - 3) * 0.02)::DOUBLE AS ox, ((p_size % 5 - 2) * 0.05)::DOUBLE AS oy, ((p_size % 11 - 5) * 0.04)::DOUBLE AS oz FROM part WHERE p_partkey BETWEEN 1 AND 29)"


def humanoid(spark, sf_dir):
    """The tree of a humanoid read back from its file; offsets are the sizes of 29 parts, joint i turns about the axis its name says."""
    size = F.col("p_size")
    structure = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(WAIST[i].removesuffix("_dof")).alias("joint"), F.lit(" ".join(str(int(a == _AXIS[i])) for a in range(3))).alias("axis"), F.lit(_CLOSED[i]).alias("closed")) for i in range(29)])
    rows = table(spark, sf_dir, "part").where("p_partkey between 1 and 29").withColumn("s", F.get(structure, (F.col("p_partkey") - 1).cast("int"))).select("s.*", size)
    place = F.concat_ws(" ", (size % 7 - 3) * 0.02, (size % 5 - 2) * 0.05, (size % 11 - 5) * 0.04)
    tag = F.concat(F.when(F.col("i") == 0, F.lit('<body name="pelvis"><freejoint name="root"/>')).otherwise(F.lit("")), F.lit('<body name="body'), "i", F.lit('" pos="'), place, F.lit('"><joint name="'), "joint", F.lit('" axis="'), "axis", F.lit('" range="-170 170"/>'))
    texts = model_text(rows.select(F.lit("humanoid").alias("model"), "i", tag.alias("opened"), "closed"))
    return N.tree_of(*read_back(texts), "humanoid")


def motion_frames(spark, sf_dir):
    """Root poses and joint angles read from motion files of the first layout."""
    path = f"{shared_dir(spark)}/motions"
    K.write_motion_csv(motions(spark, sf_dir, "humanoid_waist").where("motion % 2 = 0"), path, "humanoid_waist", per_motion=False)
    return MF.in_metres(MF.read_motion_csv(spark, path, "humanoid_waist"))


def _sql_product(a: str, b: tuple[str, str, str, str]) -> list[str]:
    x, y, z, w = (f"{a}.q{n}" for n in "xyzw")
    i, j, k, r = b
    return [f"{w} * {i} + {x} * {r} + {y} * {k} - {z} * {j}", f"{w} * {j} - {x} * {k} + {y} * {r} + {z} * {i}", f"{w} * {k} + {x} * {j} - {y} * {i} + {z} * {r}", f"{w} * {r} - {x} * {i} - {y} * {j} - {z} * {k}"]


def _sql_moved(g: str, o: tuple[str, str, str]) -> list[str]:
    x, y, z, w = (f"{g}.q{n}" for n in "xyzw")
    a, b, c = o
    cross = [f"({y} * {c} - {z} * {b})", f"({z} * {a} - {x} * {c})", f"({x} * {b} - {y} * {a})"]
    again = [f"({y} * {cross[2]} - {z} * {cross[1]})", f"({z} * {cross[0]} - {x} * {cross[2]})", f"({x} * {cross[1]} - {y} * {cross[0]})"]
    return [f"{g}.p{n} + {o[i]} + 2 * {w} * {cross[i]} + 2 * {again[i]}" for i, n in enumerate("xyz")]


_TURN = ("cos(radians(frame % 50) / 2)", "sin(radians(frame % 50) / 2)", "cos(radians(frame % 30) / 2)", "sin(radians(frame % 30) / 2)", "cos(radians(frame % 20) / 2)", "sin(radians(frame % 20) / 2)")
_CX, _SX, _CY, _SY, _CZ, _SZ = _TURN
_HALF = ("(t.axis = 0)::INT * sin(radians(g.q + t.i) / 2)", "(t.axis = 1)::INT * sin(radians(g.q + t.i) / 2)", "(t.axis = 2)::INT * sin(radians(g.q + t.i) / 2)", "cos(radians(g.q + t.i) / 2)")
POSED = f"""{FILES.replace(TRACE, "RECURSIVE " + TRACE)}, {OFFSETS},
tree AS (SELECT i, ox, oy, oz, ([{", ".join(map(str, _AXIS))}])[i + 1] AS axis, ([{", ".join(map(str, _PARENT))}])[i + 1] AS parent FROM offsets),
posed AS (SELECT rel_path, frame, q, -1 AS i, q * 0.001::DOUBLE AS px, frame * 0.01::DOUBLE AS py, (0.9 + q * 0.0001)::DOUBLE AS pz,
  {_SX} * {_CY} * {_CZ} - {_CX} * {_SY} * {_SZ} AS qx, {_CX} * {_SY} * {_CZ} + {_SX} * {_CY} * {_SZ} AS qy, {_CX} * {_CY} * {_SZ} - {_SX} * {_SY} * {_CZ} AS qz, {_CX} * {_CY} * {_CZ} + {_SX} * {_SY} * {_SZ} AS qw FROM w WHERE motion % 2 = 0
  UNION ALL SELECT g.rel_path, g.frame, g.q, t.i, {", ".join(_sql_moved("g", ("t.ox", "t.oy", "t.oz")))}, {", ".join(_sql_product("g", _HALF))} FROM posed g JOIN tree t ON t.parent = g.i)"""


@query("body_poses", f"WITH {POSED} SELECT rel_path, frame AS Frame, CASE WHEN i < 0 THEN 'pelvis' ELSE 'body' || i END AS body, {', '.join(f'round(p{a}, 6) + 0.0 AS p{a}' for a in 'xyz')}, {', '.join(f'round(q{a} * CASE WHEN qw < 0 THEN -1 ELSE 1 END, 5) + 0.0 AS q{a}' for a in 'xyz')}, abs(round(qw, 5)) AS qw FROM posed WHERE abs(qw) > 1e-4")
def body_poses(spark, sf_dir):
    """All bodies of a humanoid at every frame of motion files; quaternions with w positive."""
    rows = N.body_poses(motion_frames(spark, sf_dir), humanoid(spark, sf_dir), ["rel_path", "Frame"], "root").where("abs(t.q.w) > 1e-4")
    sign = F.when(F.col("t.q.w") < 0, -1.0).otherwise(1.0)
    return rows.select("rel_path", "Frame", "body", *[(F.round(F.col(f"t.p.{a}"), 6) + 0.0).alias(f"p{a}") for a in "xyz"], *[(F.round(F.col(f"t.q.{a}") * sign, 5) + 0.0).alias(f"q{a}") for a in "xyz"], F.abs(F.round("t.q.w", 5)).alias("qw"))


@query("bodies_beside_root", f"""WITH {POSED}, r AS (SELECT * FROM posed WHERE i = -1), d AS (SELECT b.rel_path, b.frame, b.i, r.qx, r.qy, r.qz, r.qw, b.px - r.px AS dx, b.py - r.py AS dy, b.pz - r.pz AS dz FROM posed b JOIN r ON r.rel_path = b.rel_path AND r.frame = b.frame WHERE b.i IN (5, 14, 28) AND b.frame % 4 = 0),
e AS (SELECT rel_path, frame, i, sqrt(dx ** 2 + dy ** 2 + dz ** 2) AS away, (1 - 2 * (qy ** 2 + qz ** 2)) * dx + 2 * (qx * qy + qw * qz) * dy + 2 * (qx * qz - qw * qy) * dz AS x FROM d)
SELECT rel_path, 'body' || i AS body, count(*) AS frames, round(avg(x), 6) + 0.0 AS x, round(max(away), 6) AS away FROM e GROUP BY ALL""")
def bodies_beside_root(spark, sf_dir):
    """Every fourth frame: three bodies in the frame of the root, how far ahead on average and how far away at most."""
    frames = motion_frames(spark, sf_dir).where("Frame % 4 = 0")
    poses = N.body_poses(frames, humanoid(spark, sf_dir), ["rel_path", "Frame"], "root", ["body5", "body14", "body28"])
    rows = N.beside_root(poses, ["rel_path", "Frame"], frames.select("rel_path", "Frame", "root"))
    away = F.sqrt(R.dot(F.col("r"), F.col("r"), "xyz"))
    return rows.groupBy("rel_path", "body").agg(F.count("*").alias("frames"), (F.round(F.avg("r.x"), 6) + 0.0).alias("x"), F.round(F.max(away), 6).alias("away"))


@query("evidence_from_model", ORACLE_SQL["chain_evidence"])
def evidence_from_model(spark, sf_dir):
    """Limb evidence whose bodies come from joint angles and a model: a hinge about x for each body of a limb, its tip 0.3 m away, on a free root. The rows of ``chain_evidence``."""
    names = ["_".join(limb[i] for i in (0, 2, 3)) for limb in LIMBS]
    tags = [(i, f'<body name="{n}_link"><joint name="{n}" axis="1 0 0"/><body name="{n}" pos="0 .3 0"/>', 1) for i, n in enumerate(names)]
    texts = model_text(spark.createDataFrame([("limbs", -1, '<body name="base"><freejoint/>', 0), *(("limbs", *t) for t in tags), ("limbs", len(tags), "", 1)], "model string, i int, opened string, closed int"))
    tree = N.tree_of(*read_back(texts), "limbs")
    root = R.transform(R.vec(F.lit(0.0), F.lit(0.0), last_value("error") / 1000 + 0.9), R.quat(*map(F.lit, (0.0, 0.0, 0.0, 1.0))))
    frames = trace(spark, sf_dir).select("motion", "frame", root.alias("root"), *[F.radians(last_value(limb[3])).alias(n) for limb, n in zip(LIMBS, names)])
    poses = N.body_poses(frames, tree, ["motion", "frame", "root"], "root", names)
    limb = F.element_at(F.create_map(*[x for n, part in zip(names, LIMBS) for x in (F.lit(n), F.struct(*[F.lit(v).alias(k) for k, v in zip(("chain", "kind", "role", "body"), part)]))]), F.col("body"))
    placed = poses.select("motion", "frame", limb.alias("limb"), "t", F.col("root.p").alias("r"))
    flat = placed.select("motion", "limb.*", "frame", *[F.col(f"t.q.{a}").alias(f"q{a}") for a in "xyzw"], *[(F.col(f"t.p.{a}") - F.col(f"r.{a}")).alias(f"p{a}") for a in "xyz"], *[F.col(f"r.{a}").alias(f"r{a}") for a in "xyz"])
    return evidence_rows(C.chain_evidence(flat, "motion", FPS))
