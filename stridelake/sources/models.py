"""Robot models: nested XML as tables of bodies and joints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridelake.functions import rotations as R
from stridelake.operators.kinematics import Body, body_poses
from stridelake.sources import motion_files as MF

#: One tag with its attributes, whose values may hold angle brackets.
_TAG = r"""<(?:[^<>"']++|"[^"]*"|'[^']*')*+>"""


def attribute(tag: Column, name: str) -> Column:
    """An attribute's text; null if the tag lacks it or it is empty."""
    found = F.regexp_extract(tag, rf"""\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)')""", 1)
    other = F.regexp_extract(tag, rf"""\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)')""", 2)
    return F.nullif(F.trim(F.concat(found, other)), F.lit(""))


def numbers(text: Column, n: int) -> Column:
    """The text as n numbers; null unless it is just that."""
    values = F.transform(F.split(F.trim(text), r"\s+"), lambda x: x.try_cast("double"))
    return F.when((F.size(values) == n) & F.forall(values, lambda x: x.isNotNull()), values)


def _vec(values: Column, default: tuple[float, float, float]) -> Column:
    return R.vec(*[F.coalesce(values[i], F.lit(d)) for i, d in enumerate(default)])


def model_tags(spark: SparkSession, path: str, pattern: str = "*.xml") -> DataFrame:
    """``(model, place, kind, tag, depth, degrees)``: tags of bodies and what they hold in the order of the file, with the number of bodies open before each.

    ``model`` is the name that the root element gives, else the file's without its ending. The unit of angles is the compiler's, degrees if it names none. Comments are passed over; files are read whole, each by one task.
    """
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    text = F.regexp_replace("value", r"(?s)<!--.*?-->", "")
    root = F.regexp_extract(text, r"<mujoco\b[^>]*>", 0)
    model = F.coalesce(attribute(root, "model"), F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)\.[^./]*$", 1))
    unit = F.lower(F.regexp_extract(text, r"""<compiler[^>]*\sangle\s*=\s*["']([^"']*)["']""", 1))
    tags = whole.select(model.alias("model"), (unit != "radian").alias("degrees"), F.posexplode(F.regexp_extract_all(text, F.lit(_TAG), F.lit(0))).alias("place", "tag"))
    kinds = tags.withColumn("kind", F.regexp_extract("tag", r"^<\s*(/?[A-Za-z_]+)", 1)).where(F.col("kind").isin("body", "/body", "joint", "freejoint", "geom"))
    step = F.when(F.col("kind") == "/body", -1).when((F.col("kind") == "body") & ~F.col("tag").rlike(r"/\s*>$"), 1).otherwise(0)
    order = Window.partitionBy("model").orderBy("place")
    return kinds.withColumn("depth", F.coalesce(F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))


def _owned(tags: DataFrame) -> DataFrame:
    """Each tag but closing ones with the name of the body that holds it (null outside of bodies): of the bodies one level up the last one opened before."""
    named = tags.where("kind <> '/body'").withColumn("name", F.coalesce(attribute(F.col("tag"), "name"), F.concat(F.col("kind"), F.col("place").cast("string"))))
    nothing = F.lit(None).cast("string")
    asks = F.struct((F.col("depth") + 1).alias("level"), F.lit(True).alias("asks"), nothing.alias("holder"))
    holds = F.struct((F.col("depth") + 2).alias("level"), F.lit(False).alias("asks"), F.col("name").alias("holder"))
    both = named.select("*", F.inline(F.when(F.col("kind") == "body", F.array(asks, holds)).otherwise(F.array(asks))))
    up = Window.partitionBy("model", "level").orderBy("place")
    return both.withColumn("owner", F.last("holder", ignorenulls=True).over(up)).where("asks").drop("level", "asks", "holder")


def _turn(tag: Column, degrees: Column) -> Column:
    """A body's turn: a quaternion (w first), turns about its own axes, or an axis and an angle; none by default."""
    q, e, a = numbers(attribute(tag, "quat"), 4), numbers(attribute(tag, "euler"), 3), numbers(attribute(tag, "axisangle"), 4)
    in_degrees = lambda x: F.when(degrees, x).otherwise(F.degrees(x))
    euler = R.from_euler("xyz", [in_degrees(e[i]) for i in range(3)])
    about = R.about(R.unit(R.vec(a[0], a[1], a[2])), F.radians(in_degrees(a[3])))
    none = R.quat(*map(F.lit, (0.0, 0.0, 0.0, 1.0)))
    return F.when(q.isNotNull(), R.normalised(R.quat(q[1], q[2], q[3], q[0]))).when(e.isNotNull(), euler).when(a.isNotNull(), about).otherwise(none)


def read_bodies(spark: SparkSession, path: str, pattern: str = "*.xml") -> DataFrame:
    """``(model, place, body, parent, depth, t)``: every body of the models under a path with the one around it (null for roots) and its transform in it."""
    rows = _owned(model_tags(spark, path, pattern)).where("kind = 'body'")
    t = R.transform(_vec(numbers(attribute(F.col("tag"), "pos"), 3), (0.0, 0.0, 0.0)), _turn(F.col("tag"), F.col("degrees")))
    return rows.select("model", "place", F.col("name").alias("body"), F.col("owner").alias("parent"), "depth", t.alias("t"))


def read_joints(spark: SparkSession, path: str, pattern: str = "*.xml") -> DataFrame:
    """``(model, place, joint, body, kind, axis, anchor, rest, lo, hi)``: every joint of a body; ``kind`` is hinge, slide, ball or free, angles are in radians.

    ``rest`` is the value at which the body stands as the file has it, ``lo`` and ``hi`` are null without a range. Joints outside of bodies (defaults, actuators) are no joints.
    """
    rows = _owned(model_tags(spark, path, pattern)).where("kind in ('joint', 'freejoint') and owner is not null")
    tag = F.col("tag")
    kind = F.when(F.col("kind") == "freejoint", "free").otherwise(F.coalesce(attribute(tag, "type"), F.lit("hinge")))
    angle = lambda x: F.when(F.col("degrees") & (kind != "slide"), F.radians(x)).otherwise(x)
    ends, rest = numbers(attribute(tag, "range"), 2), F.coalesce(attribute(tag, "ref").try_cast("double"), F.lit(0.0))
    axis = R.unit(_vec(numbers(attribute(tag, "axis"), 3), (0.0, 0.0, 1.0)))
    return rows.select(
        "model", "place", F.col("name").alias("joint"), F.col("owner").alias("body"), kind.alias("kind"), axis.alias("axis"), _vec(numbers(attribute(tag, "pos"), 3), (0.0, 0.0, 0.0)).alias("anchor"),
        angle(rest).alias("rest"), angle(ends[0]).alias("lo"), angle(ends[1]).alias("hi"),
    )


def poses_of_files(spark: SparkSession, path: str, tree: list[Body]) -> DataFrame:
    """``(path, body, p, q)`` of pose files: the transforms of bodies where a file has them, else those of the model with the file's root and joint values.

    Joint values are a vector (seven numbers of the root, then the model's joints in order) or named; a joint that is not named is at rest, a root that is not given stands as in the model.
    """
    kinds = "robot_body_transforms map<string, array<double>>, robot_root_position array<double>, robot_root_rotation_xyzw array<double>, robot_joints map<string, double>, robot_joint_q array<double>"
    rows = MF.read_config(spark, path, kinds).withColumn("path", F.col("_metadata.file_path"))
    base, names = tree[0], [j.name for b in tree for j in b.joints if j.kind != "free"]
    v = F.col("robot_joint_q")
    place, turn = F.col("robot_root_position"), F.col("robot_root_rotation_xyzw")
    own_p, own_q = (F.array(*map(F.lit, x)) for x in (base.place, base.turn))
    p, q = F.coalesce(F.slice(v, 1, 3), place, own_p), F.coalesce(F.slice(v, 4, 4), turn, own_q)
    root = R.transform(R.vec(*[p[i] for i in range(3)]), R.normalised(R.quat(*[q[i] for i in range(4)])))
    values = [F.coalesce(F.get(v, F.lit(7 + i)), F.col("robot_joints")[n]).alias(n) for i, n in enumerate(names)]
    made = body_poses(rows.where("robot_body_transforms is null").select("path", root.alias("__root"), *values), tree, ["path"], "__root").select("path", "body", "t.p", "t.q")
    t = F.col("t")
    held = rows.where("robot_body_transforms is not null").select("path", F.explode("robot_body_transforms").alias("body", "t"))
    return held.select("path", "body", R.vec(t[0], t[1], t[2]).alias("p"), R.normalised_floor(R.quat(t[3], t[4], t[5], t[6])).alias("q")).unionByName(made)
