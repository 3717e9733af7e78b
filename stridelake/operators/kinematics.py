"""Poses of bodies from joint values and a model: products of transforms along the tree, for many frames at a time in NumPy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stridelake.functions import rotations as R

Vector = tuple[float, ...]


@dataclass(frozen=True)
class Joint:
    """A joint of one degree, or a free one."""

    name: str
    kind: str
    axis: Vector
    anchor: Vector
    rest: float


@dataclass(frozen=True)
class Body:
    """A body in the one around it."""

    name: str
    parent: str | None
    depth: int
    place: Vector
    turn: Vector
    joints: tuple[Joint, ...]


def tree_of(bodies: DataFrame, joints: DataFrame, model: str) -> list[Body]:
    """One model as a list, outer bodies first: a model is of the size of a schema, and it becomes expressions. Names must be unique; ball joints are an error."""
    held: dict[str, list[Joint]] = {}
    for r in joints.where(F.col("model") == model).orderBy("place").collect():
        if r["kind"] not in ("hinge", "slide", "free"):
            raise ValueError(f"joint {r['joint']} of model {model} is of kind {r['kind']}")
        held.setdefault(r["body"], []).append(Joint(r["joint"], r["kind"], tuple(r["axis"]), tuple(r["anchor"]), r["rest"]))
    rows = bodies.where(F.col("model") == model).orderBy("depth", "place").collect()
    out = [Body(r["body"], r["parent"], r["depth"], tuple(r["t"]["p"]), tuple(r["t"]["q"]), tuple(held.get(r["body"], ()))) for r in rows]
    if not out:
        raise ValueError(f"there is no model {model}")
    if len({b.name for b in out}) < len(out):
        raise ValueError(f"model {model} has bodies of the same name")
    return out


Pose = tuple[list, list]


def _rotate(q: list, v: list) -> list:
    cx, cy, cz = (2 * (q[a] * v[b] - q[b] * v[a]) for a, b in ((1, 2), (2, 0), (0, 1)))
    return [v[0] + q[3] * cx + q[1] * cz - q[2] * cy, v[1] + q[3] * cy + q[2] * cx - q[0] * cz, v[2] + q[3] * cz + q[0] * cy - q[1] * cx]


def _compose(a: Pose, b: Pose) -> Pose:
    """a after b, in the order of operations of :func:`stridelake.functions.rotations.compose`."""
    (ax, ay, az, aw), (bx, by, bz, bw) = a[1], b[1]
    turn = [aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - (ax * bx + ay * by + az * bz)]
    return [m + n for m, n in zip(_rotate(a[1], list(b[0])), a[0])], turn


def _of_joint(joint: Joint, parts: list) -> Pose:
    """The transform of a joint's value: a shift along its axis, or a turn about the axis through its anchor. ``parts`` is the shift, or sine and cosine of half the turn."""
    if joint.kind == "slide":
        return [parts[0] * x for x in joint.axis], [0.0, 0.0, 0.0, 1.0]
    turn = [*[parts[0] * x for x in joint.axis], parts[1]]
    return ([a - b for a, b in zip(joint.anchor, _rotate(turn, list(joint.anchor)))] if any(joint.anchor) else [0.0, 0.0, 0.0]), turn


def _poses(tree: list[Body], parts: dict[str, list], root: Pose | None) -> dict[str, Pose]:
    """The pose of every body, outer ones first, so that each transform is computed once however many bodies hang on it."""
    out: dict[str, Pose] = {}
    for b in tree:
        t: Pose = (list(b.place), list(b.turn))
        for j in b.joints:
            if j.kind != "free":
                t = _compose(t, _of_joint(j, parts.get(j.name) or ([0.0] if j.kind == "slide" else [0.0, 1.0])))
        if b.parent is not None:
            t = _compose(out[b.parent], t)
        elif root is not None:
            t = root if any(j.kind == "free" for j in b.joints) else _compose(root, t)
        out[b.name] = t
    return out


#: Frames whose poses a task holds at once.
FRAMES = 2048


def body_poses(df: DataFrame, tree: list[Body], keys: list[str], root: str | None = None, bodies: list[str] | None = None) -> DataFrame:
    """``(*keys, body, t)``: the pose in space of every body (or of those named) of every row of ``df``.

    ``df`` has a column for each joint (radians, or metres of slides) and, named by ``root``, the pose of the free body or, without one, of the model's base. A joint without a column, or a
    null, is at rest; a column that is neither key, root nor joint is an error, as it would be a joint that the model lacks. Nothing is shuffled: a row holds a whole
    frame, and a task multiplies the transforms of some thousand frames at a time along the tree. A row without a root's pose has null poses.
    """
    known = {j.name: j for b in tree for j in b.joints}
    if unknown := [c for c in df.columns if c not in {*keys, root, *known}]:
        raise ValueError(f"the model lacks the joints {', '.join(unknown)}")
    if missing := sorted(set(bodies or ()) - {b.name for b in tree}):
        raise ValueError(f"the model lacks the bodies {', '.join(missing)}")
    tree = sorted(tree, key=lambda b: b.depth)
    shown = [b.name for b in tree if bodies is None or b.name in bodies]
    values: list[Column] = []
    places: dict[str, list[int]] = {}
    for j in (known[c] for c in df.columns if c in known and c not in {*keys, root} and known[c].kind != "free"):
        moved = F.coalesce(F.col(f"`{j.name}`").cast("double"), F.lit(j.rest)) - F.lit(j.rest)
        own = [moved] if j.kind == "slide" else [F.sin(moved / 2), F.cos(moved / 2)]
        places[j.name] = list(range(len(values), len(values) + len(own)))
        values += own
    if root is not None:
        values += [F.col(f"{root}.{c}").cast("double") for c in ("p.x", "p.y", "p.z", "q.x", "q.y", "q.z", "q.w")]
    kinds = T.StructType([*[T.StructField(k, df.schema[k].dataType) for k in keys], T.StructField("body", T.StringType()), T.StructField("t", T.StructType([T.StructField(n, T.StructType([T.StructField(a, T.DoubleType()) for a in names])) for n, names in (("p", "xyz"), ("q", "xyzw"))]))])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FRAMES):
                part = batch.slice(at, FRAMES)
                n, columns = part.num_rows, part.columns[len(keys) :]
                x = [c.to_numpy(zero_copy_only=False) for c in columns]
                base = (x[-7:-4], x[-4:]) if root is not None else None
                found = _poses(tree, {j: [x[i] for i in own] for j, own in places.items()}, base)
                lost = np.zeros(n, bool)
                for c in columns[-7:] if root is not None else ():
                    lost |= c.is_null().to_numpy(zero_copy_only=False)
                hidden = np.repeat(lost, len(shown)) if lost.any() else None

                def axis(half: int, i: int) -> pa.Array:
                    stacked = np.empty((n, len(shown)))
                    for k, b in enumerate(shown):
                        stacked[:, k] = found[b][half][i]
                    return pa.array(stacked.ravel(), mask=hidden)

                t = pa.StructArray.from_arrays([pa.StructArray.from_arrays([axis(0, i) for i in range(3)], list("xyz")), pa.StructArray.from_arrays([axis(1, i) for i in range(4)], list("xyzw"))], ["p", "q"])
                row = pa.array(np.repeat(np.arange(n), len(shown)))
                body = pa.array(shown, pa.string()).take(pa.array(np.tile(np.arange(len(shown)), n)))
                yield pa.RecordBatch.from_arrays([*[c.take(row) for c in part.columns[: len(keys)]], body, t], names=[*keys, "body", "t"])

    return df.select(*keys, *[v.alias(f"__v{i}") for i, v in enumerate(values)]).mapInArrow(of_batches, kinds)


def beside_root(poses: DataFrame, keys: list[str], root: DataFrame) -> DataFrame:
    """``(*keys, body, t, r)``: poses with the place of each body in the frame of ``root(keys, root)``."""
    rows = poses.join(root, keys)
    away = R.each(lambda a, b: a - b, F.col("t.p"), F.col("root.p"), names="xyz")
    return rows.select(*keys, "body", "t", R.rotate_back(F.col("root.q"), away).alias("r"))
