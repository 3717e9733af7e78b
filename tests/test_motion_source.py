"""The data source of motion files: headers of all orders, pruned columns, and writes that are seen as a whole or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from stridelake.sources import motion_files as M
from stridelake.sources import motion_source as S


def frames(spark, motions=(("a/x.csv", 3), ("a/y.csv", 2), ("z.csv", 1))):
    rows = [(p, i, *[float(i + k) for k in range(6)], 5.0, 7.0) for p, n in motions for i in range(n)]
    return spark.createDataFrame(rows, ["rel_path", "Frame", *M.ROOT, "left_knee_joint_dof", "own_dof"])


def test_round_trip_and_pruning(spark, tmp_path):
    path = str(tmp_path / "out")
    S.write_motions(frames(spark), path)
    S.write_motions(frames(spark, (("later.csv", 2),)), path)
    found = S.read_motions(spark, path, ["Frame", "own_dof"])
    assert found.columns == ["Frame", "own_dof", "rel_path"]
    assert sorted((r.rel_path, r.Frame, r.own_dof) for r in found.collect()) == sorted([(p, i, 7.0) for p, n in (("a/x.csv", 3), ("a/y.csv", 2), ("z.csv", 1), ("later.csv", 2)) for i in range(n)])
    whole = S.read_motions(spark, f"file://{path}")
    assert whole.where("left_knee_joint_dof = 5").count() == 8 and whole.where("right_knee_joint_dof is not null").isEmpty()
    S.write_motions(frames(spark, (("only.csv", 1),)), path, "overwrite")
    assert {r.rel_path for r in S.read_motions(spark, path).collect()} == {"only.csv"}
    assert len([d for d in os.listdir(path) if d.startswith("part-")]) == 1 and not os.listdir(f"{path}/_temporary")


def test_files_of_other_tools(spark, tmp_path):
    root = ",".join(M.ROOT)
    for name, text in {
        "a.csv": f"Frame,{root},x_dof\n0,1,2,3,4,5,6,nan\n", "b.csv": f'"x_dof",{",".join(reversed(M.ROOT))},Frame,note\n1.5,6,5,4,3,2,1,4,hi\n', "empty.csv": "", "line.csv": "\n", "summary.csv": "motion\nm\n", "_hidden/c.csv": "q\n1\n", "head.csv": f"Frame,{root}\n",
    }.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = {r.rel_path: r for r in S.read_motions(spark, str(tmp_path), ["Frame", "root_translateX", "x_dof", "note"]).collect()}
    assert set(rows) == {"a.csv", "b.csv"} and rows["a.csv"].x_dof != rows["a.csv"].x_dof and rows["a.csv"].note is None
    assert (rows["b.csv"].Frame, rows["b.csv"].root_translateX, rows["b.csv"].x_dof, rows["b.csv"].note) == (4, 1.0, 1.5, "hi")
    (tmp_path / "bad.csv").write_text("Frame,x_dof\n0,1\n")
    with pytest.raises(Exception, match="columns .* are missing"):
        S.read_motions(spark, str(tmp_path), ["Frame"]).collect()
    assert S.read_motions(spark, str(tmp_path / "nowhere"), ["Frame"]).isEmpty()


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    S.write_motions(frames(spark), path)
    broken = frames(spark, (("b.csv", 2), ("c.csv", 2), ("d.csv", 2))).withColumn("own_dof", F.when(F.col("rel_path") == "c.csv", F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("own_dof")))
    with pytest.raises(Exception, match="lost"):
        S.write_motions(broken, path)
    assert {r.rel_path for r in S.read_motions(spark, path, ["Frame"]).collect()} == {"a/x.csv", "a/y.csv", "z.csv"}
    assert not os.listdir(f"{path}/_temporary") and len(os.listdir(f"{path}/_manifest")) == 1
    (tmp_path / "out" / "part-left").mkdir()
    (tmp_path / "out" / "part-left" / "ghost.csv").write_text("Frame\n0\n")  # of a commit that never got its manifest
    assert S.read_motions(spark, path, ["Frame"]).where("rel_path = 'ghost.csv'").isEmpty()
    with pytest.raises(Exception, match="no path of a motion"):
        S.write_motions(frames(spark, (("../up.csv", 1),)), path)
