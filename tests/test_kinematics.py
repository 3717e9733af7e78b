"""Models from nested XML and poses along their trees, against plain products of matrices."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridelake.functions import rotations as R
from stridelake.operators import kinematics as N
from stridelake.sources import models as M

MODEL = """<?xml version="1.0"?>
<mujoco model="arm"><compiler angle="radian"/>
  <default><joint axis="1 0 0"/><!-- <body name="ghost"> --></default>
  <worldbody><geom name="floor" size="1 > 2"/>
    <body name="base" pos="0 0 1" quat="2 0 0 0"><freejoint name="free"/>
      <body name="left" pos='0 .5 0' euler="0 0 1.5707963267948966"><joint name="swing" axis="0 2 0" pos="0 0 -.2" ref="0.1" range="-1 2"/><joint name="slide" type="slide" axis="1 0 0"/>
        <body name="tip" pos="0 0 .3"/></body>
      <body pos="1 0 0"><joint name="bare"/><body name="end" axisangle="1 0 0 0.5" pos="0 0 2"/></body>
    </body>
  </worldbody><actuator><joint name="swing"/></actuator>
</mujoco>"""


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("models")
    (folder / "x.xml").write_text(MODEL)
    (folder / "plain.xml").write_text("<mujoco><worldbody><body name='only' euler='0 0 90'><joint name='j' range='-90 90' ref='45'/></body></worldbody></mujoco>")
    (folder / "empty.xml").write_text("")
    return M.read_bodies(spark, str(folder)), M.read_joints(spark, str(folder))


def test_tables_of_a_model(model):
    bodies, joints = ({r[n]: r for r in df.collect()} for df, n in zip(model, ("body", "joint")))
    assert {b: r.parent for b, r in bodies.items()} == {"base": None, "left": "base", "tip": "left", "end": next(b for b in bodies if b.startswith("body")), next(b for b in bodies if b.startswith("body")): "base", "only": None}
    assert {r.model for r in bodies.values()} == {"arm", "plain"} and bodies["tip"].depth == 2 and "ghost" not in bodies
    assert (joints["swing"].body, joints["swing"].lo, joints["swing"].hi, joints["swing"].rest) == ("left", -1.0, 2.0, 0.1) and tuple(joints["swing"].axis) == (0.0, 1.0, 0.0)
    assert joints["free"].kind == "free" and joints["slide"].kind == "slide" and tuple(joints["bare"].axis) == (0.0, 0.0, 1.0)
    assert joints["j"].lo == pytest.approx(-np.pi / 2) and joints["j"].rest == pytest.approx(np.pi / 4)  # degrees where no unit is named


def turn(axis, angle):
    axis = np.array(axis, float) / np.linalg.norm(axis)
    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


def place(p, r=np.eye(3)):
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = r, p
    return out


def test_poses_are_products_of_matrices(spark, model):
    tree = N.tree_of(*model, "arm")
    root = R.transform(R.vec(F.lit(1.0), F.lit(2.0), F.lit(3.0)), R.quat(F.lit(0.0), F.sin(F.lit(0.2)), F.lit(0.0), F.cos(F.lit(0.2))))
    frames = spark.createDataFrame([(0, 0.7, -0.3, 0.9), (1, None, 0.0, 0.0)], "frame long, swing double, slide double, bare double").withColumn("root", root)
    found = {(r.frame, r.body): (np.array(tuple(r.t.p)), np.array(tuple(r.t.q))) for r in N.body_poses(frames, tree, ["frame"], "root").collect()}
    base = place([1, 2, 3], turn([0, 1, 0], 0.4))
    for frame, swing, slide, bare in ((0, 0.7, -0.3, 0.9), (1, 0.1, 0.0, 0.0)):
        left = base @ place([0, 0.5, 0], turn([0, 0, 1], np.pi / 2)) @ place([0, 0, -0.2]) @ place([0, 0, 0], turn([0, 1, 0], swing - 0.1)) @ place([0, 0, 0.2]) @ place([slide, 0, 0])
        end = base @ place([1, 0, 0]) @ place([0, 0, 0], turn([0, 0, 1], bare)) @ place([0, 0, 2], turn([1, 0, 0], 0.5))
        for body, want in (("base", base), ("left", left), ("tip", left @ place([0, 0, 0.3])), ("end", end)):
            p, q = found[frame, body]
            assert p == pytest.approx(want[:3, 3], abs=1e-9)
            x, y, z, w = q
            assert np.allclose([1 - 2 * (y * y + z * z), 2 * (x * y + z * w)], want[:2, 0], atol=1e-9)
    assert {b for _, b in found} == {b.name for b in tree}


def test_what_a_model_lacks(spark, model):
    tree = N.tree_of(*model, "arm")
    frame = spark.createDataFrame([(0, 0.0)], "frame long, tail double")
    with pytest.raises(ValueError, match="joints tail"):
        N.body_poses(frame, tree, ["frame"])
    with pytest.raises(ValueError, match="bodies nose"):
        N.body_poses(frame.drop("tail"), tree, ["frame"], bodies=["nose"])
    with pytest.raises(ValueError, match="no model"):
        N.tree_of(*model, "empty")
    assert N.body_poses(frame.drop("tail").where("false"), tree, ["frame"]).isEmpty()
    assert [r.body for r in N.body_poses(frame.drop("tail"), tree, ["frame"], bodies=["tip"]).collect()] == ["tip"]


def test_pose_files_with_and_without_transforms(spark, model, tmp_path):
    tree = N.tree_of(*model, "arm")
    half = [0.0, 0.0, np.sin(np.pi / 4), np.cos(np.pi / 4)]
    docs = {
        "told": {"robot_body_transforms": {"tip": [1, 2, 3, 0, 0, 0, 2]}}, "named": {"robot_root_position": [1, 0, 0], "robot_root_rotation_xyzw": half, "robot_joints": {"swing": 0.1, "slide": 0.5}},
        "vector": {"robot_joint_q": [1, 0, 0, *half, 0.1, 0.5, 0.0]}, "rest": {"robot_type": "x"},
    }
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    found = {(r.path.rsplit("/", 1)[1][:-5], r.body): (tuple(r.p), tuple(r.q)) for r in M.poses_of_files(spark, str(tmp_path), tree).collect()}
    assert found["told", "tip"] == ((1.0, 2.0, 3.0), (0.0, 0.0, 0.0, 1.0)) and ("told", "base") not in found
    want = place([1, 0, 0], turn([0, 0, 1], np.pi / 2)) @ place([0, 0.5, 0], turn([0, 0, 1], np.pi / 2)) @ place([0.5, 0, 0]) @ place([0, 0, 0.3])
    for name in ("named", "vector"):
        assert found[name, "tip"][0] == pytest.approx(want[:3, 3], abs=1e-9)
    assert found["rest", "base"][0] == (0.0, 0.0, 1.0) and found["rest", "tip"][0] == pytest.approx((0.0, 0.5, 1.3))


def test_deep_trees_are_computed_once_a_body(spark):
    """A chain of 40 hinges: each level once held the expressions of all above it, some milliseconds a frame for a humanoid (body_poses, evidence_from_model)."""
    tree = [N.Body(f"b{i}", f"b{i - 1}" if i else None, i, (1.0, 0.0, 0.0), (0.0, 0.0, 0.0, 1.0), (N.Joint(f"j{i}", "hinge", (0.0, 0.0, 1.0), (0.0, 0.0, 0.0), 0.0),)) for i in range(40)]
    base = F.from_json(F.when(F.col("id") != 7, F.lit('{"p": {"x": 2.0, "y": 0.0, "z": 0.5}, "q": {"x": 0.0, "y": 0.0, "z": 0.0, "w": 1.0}}')), "p struct<x: double, y: double, z: double>, q struct<x: double, y: double, z: double, w: double>")
    rows = spark.range(3000).select("id", base.alias("root"), *[(F.col("id") % 5 * 0.01).alias(f"j{i}") for i in range(40)])
    poses = N.body_poses(rows, tree, ["id"], "root", ["b39"])
    assert "lambdafunction" not in poses._jdf.queryExecution().optimizedPlan().toString()
    found = {r.id: r.t for r in poses.collect()}
    assert len(found) == 3000 and found[7].p.x is None
    for i in (0, 1, 2999):
        turn = i % 5 * 0.01
        assert abs(found[i].p.x - (2 + sum(math.cos(k * turn) for k in range(40)))) < 1e-9 and abs(found[i].p.y - sum(math.sin(k * turn) for k in range(40))) < 1e-9
        assert abs(found[i].q.z - math.sin(20 * turn)) < 1e-9 and found[i].p.z == 0.5
