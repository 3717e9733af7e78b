"""Human poses onto robots: scaled effectors and skeletons, masks and active coordinates, skinning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelake.functions import rotations as R
from stridelake.functions.names import leaf
from stridelake.operators import relations as J
from stridelake.operators import series as S


def parsed_scale(text: Column, ratio: float = 1.0) -> Column:
    """A scale as text, one number for all axes or three with commas, times a ratio, as x, y and z. Other counts are an error."""
    parts = F.transform(F.split(text, ","), lambda t: F.trim(t).cast("double"))
    wrong = F.raise_error(F.concat(F.lit("a scale is one number or three: "), text)).cast("double")
    at = lambda i: F.when(F.size(parts) == 3, F.get(parts, F.lit(i))).when(F.size(parts) == 1, F.get(parts, F.lit(0))).otherwise(wrong) * ratio
    return F.struct(*[at(i).alias(a) for i, a in enumerate("xyz")])


def scaled_effectors(poses: DataFrame, mapped: DataFrame, keys: list[str], root: str, animate: bool = True) -> DataFrame:
    """``(keys, joint, t)`` for the joints of ``mapped(joint, scale, offset)``, from global poses ``poses(keys, joint, t)``.

    A joint's place relative to the root, as the root sees it, is scaled axis by axis and turned back, the root's own place is scaled by the root's factors, and the
    joint's offset, a transform, is added in the joint's space. Without ``animate`` only heights are scaled. The mapping is a skeleton's joints, so it is broadcast.
    """
    small = F.broadcast(mapped.select("joint", "scale", F.col("offset").alias("o")))
    own = F.col("scale") if animate else F.struct(F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.col("scale.z").alias("z"))
    rows = poses.join(small, "joint").withColumn("s", own)
    times = lambda a, b: R.each(lambda x, y: x * y, a, b, names="xyz")
    plus = lambda a, b: R.each(lambda x, y: x + y, a, b, names="xyz")
    minus = lambda a, b: R.each(lambda x, y: x - y, a, b, names="xyz")
    at_root = rows.where(F.col("joint") == root).select(*keys, F.col("t").alias("__r"), times(F.col("t.p"), F.col("s")).alias("__rp"))
    out = rows.join(at_root, keys).withColumn("__local", R.rotate_back(F.col("__r.q"), minus(F.col("t.p"), F.col("__r.p"))))
    out = out.withColumn("__q", R.product(F.col("t.q"), F.col("o.q")))
    place = plus(plus(R.rotate(F.col("__r.q"), times(F.col("__local"), F.col("s"))), F.col("__rp")), R.rotate(F.col("__q"), F.col("o.p")))
    return out.select(*keys, "joint", R.transform(place, F.col("__q")).alias("t"))


def buffer_effectors(local: DataFrame, parents: DataFrame, mapped: DataFrame, keys: list[str], root: str, depth: int, animate: bool = True) -> DataFrame:
    """Effectors of every frame of a motion from its local poses: the tree is walked level by level, then scaled."""
    return scaled_effectors(J.global_poses(local, parents, keys, depth), mapped, keys, root, animate)


def offset_effectors(effectors: DataFrame, shift: tuple[float, float, float] = (0.0, 0.0, 0.0), ground: float = 0.0) -> DataFrame:
    """All effectors moved by the root's offset and the height of the ground."""
    moved = F.struct(*[(F.col(f"t.p.{a}") + d).alias(a) for a, d in zip("xyz", (shift[0], shift[1], shift[2] + ground))])
    return effectors.withColumn("t", R.transform(moved, F.col("t.q")))


def preview_report(effectors: DataFrame, bodies: DataFrame, mapping: DataFrame, keys: list[str], position: float = 0.05, rotation: float = 15.0) -> tuple[DataFrame, DataFrame]:
    """Errors of every mapped joint against its robot bodies, and a summary per pose.

    ``effectors(keys, joint, t)``, ``bodies(keys, body, t)``, ``mapping(joint, t_body, r_body)``: places are compared with one body, turns with the other. A joint warns beyond
    either limit; the worst joint has the largest sum of metres and hundredths of degrees.
    """
    place = bodies.select(*keys, F.col("body").alias("t_body"), F.col("t.p").alias("__p"))
    turn = bodies.select(*keys, F.col("body").alias("r_body"), F.col("t.q").alias("__q"))
    rows = effectors.join(F.broadcast(mapping), "joint").join(place, [*keys, "t_body"]).join(turn, [*keys, "r_body"])
    gap = R.length(R.each(lambda a, b: a - b, F.col("t.p"), F.col("__p"), names="xyz"))
    joints = rows.select(*keys, "joint", "t_body", "r_body", gap.alias("position_error"), R.angle_between(F.col("t.q"), F.col("__q")).alias("rotation_error"))
    joints = joints.withColumn("warning", (F.col("position_error") > position) | (F.col("rotation_error") > rotation))
    worst = F.min_by("joint", F.struct(-(F.col("position_error") + F.col("rotation_error") / 100), "joint"))
    figures = [f(f"{c}_error").alias(f"{n}_{c}_error") for c in ("position", "rotation") for n, f in (("mean", F.avg), ("max", F.max))]
    return joints, joints.groupBy(*keys).agg(*figures, worst.alias("worst_joint"), F.count_if("warning").alias("warnings"))


def scaled_skeleton(poses: DataFrame, mapped: DataFrame, parents: DataFrame, keys: list[str], root: str) -> DataFrame:
    """The mapped joints as a skeleton of their own: scaled effectors relative to ``parents(joint, parent)`` of the mapped joints."""
    return J.local_poses(scaled_effectors(poses, mapped, keys, root), parents, keys)


def skinned(points: DataFrame, influences: DataFrame, joints: DataFrame) -> DataFrame:
    """``(vertex, x, y, z)``: weighted sums of each joint's transform of the vertex; ``points(vertex, p)``, ``influences(vertex, joint, weight)``, ``joints(joint, t)``."""
    rows = influences.join(points, "vertex").join(joints, "joint")
    moved = R.each(lambda a, b: a + b, R.rotate(F.col("t.q"), F.col("p")), F.col("t.p"), names="xyz")
    rows = rows.withColumn("m", moved)
    return rows.groupBy("vertex").agg(*[F.sum(F.col("weight") * F.col(f"m.{a}")).alias(a) for a in "xyz"])


def triangles(corners: Column) -> Column:
    """An array of corners as triangles: three stay, four are split along the first diagonal, others give none."""
    one = lambda *at: F.struct(*[F.get(corners, F.lit(i)).alias(k) for i, k in zip(at, "abc")])
    return F.when(F.size(corners) == 3, F.array(one(0, 1, 2))).when(F.size(corners) == 4, F.array(one(0, 1, 2), one(0, 2, 3)))


def robot_of(header: Column, path: Column, hints: dict[str, tuple[str, ...]], tokens: dict[str, tuple[str, ...]], other: str = "unknown") -> Column:
    """The robot some of whose own columns the header (an array) has, else the first a part of the path names."""
    found = F.lit(other)
    for robot, words in reversed(tokens.items()):
        named = F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*map(F.lit, words)))
        found = F.when(named, robot).otherwise(found)
    for robot, columns in reversed(hints.items()):
        found = F.when(F.arrays_overlap(header, F.array(*map(F.lit, columns))), robot).otherwise(found)
    return found


def coordinate_masks(joints: DataFrame, masks: DataFrame, default: float) -> DataFrame:
    """Adds ``mask`` to ``joints(label, ...)``: the value ``masks(body, value)`` has for the label's leaf, else the default."""
    named = masks.select(F.col("body").alias("__leaf"), F.col("value").alias("__mask"))
    rows = joints.withColumn("__leaf", leaf(F.col("label"))).join(named, "__leaf", "left")
    return rows.withColumn("mask", F.coalesce("__mask", F.lit(default))).drop("__leaf", "__mask")


def active_coordinates(joints: DataFrame, exclude: tuple[str, ...] = (), include: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``joints(label, mask, ...)`` that count: the lower-cased leaf holds none of the excluded words, one of the included if there are any, and the mask is above 0."""
    name = F.lower(leaf(F.col("label")))
    holds = lambda words: F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(name, w))
    kept = F.col("mask") > 0
    if exclude:
        kept = kept & ~holds(exclude)
    if include:
        kept = kept & holds(include)
    return joints.where(kept)


def smooth_residual(df: DataFrame, keys: list[str], weight: float, value: str = "q", mask: str = "mask", frame: str = "frame") -> DataFrame:
    """Adds ``residual``: the change from the frame before times a weight and the coordinate's mask; 0 at the first frame."""
    before = F.lag(value).over(S.over(keys, frame))
    return df.withColumn("residual", F.coalesce((F.col(value) - before) * weight * F.col(mask), F.lit(0.0)))


def relative_bodies(bodies: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Body poses ``bodies(keys, body, t)`` relative to the body that ``parents(body, parent)`` names.

    The bodies of one pose meet in a window over the keys, so rows are never dealt by a body's name; rows that lie by a part of the keys stay where they are. ``parents`` are a skeleton's bodies, so it is broadcast.
    """
    known = bodies.where(F.forall(F.array(*[F.col(k).isNotNull() for k in keys]), lambda x: x))
    all_of = F.collect_list(F.struct("body", "t")).over(Window.partitionBy(*keys))
    rows = known.withColumn("__all", all_of).join(F.broadcast(parents), "body")
    rows = rows.withColumn("__above", F.explode(F.filter("__all", lambda x: x["body"] == F.col("parent"))))
    return rows.select(*keys, "body", R.compose(R.inverse(F.col("__above.t")), F.col("t")).alias("t"))
