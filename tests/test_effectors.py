"""Bodies relative to each other on made-up poses, and how their rows are dealt."""

import re

from pyspark.sql import functions as F

from stridelake.functions import rotations as R
from stridelake.operators import effectors as X
from stridelake.operators import relations as J
from stridelake.plans import effectors as P
from stridelake.plans import selection as L

SF = "/root/testdata/sf0.001"


def test_relative_bodies_are_a_self_join(spark):
    """Several bodies of a parent, several parents of a body, an absent parent, a repeated body, a null key and a null body."""
    rows = [(1, "foot", 1.0), (1, "hand", 3.0), (1, "head", 7.0), (2, "hand", 4.0), (3, "foot", 2.0), (3, "hand", 2.5), (3, "hand", 6.5), (None, "foot", 1.0), (None, "hand", 2.0), (1, None, 9.0)]
    half = F.col("x") / 2
    bodies = spark.createDataFrame(rows, "pose int, body string, x double").select("pose", "body", R.transform(R.vec(F.col("x"), F.lit(0.5), -F.col("x")), R.quat(F.lit(0.0), F.lit(0.0), F.sin(half), F.cos(half))).alias("t"))
    parents = spark.createDataFrame([("hand", "foot"), ("head", "foot"), ("head", "hand"), ("foot", None)], "body string, parent string")
    above = bodies.select("pose", F.col("body").alias("parent"), F.col("t").alias("above"))
    want = bodies.join(parents, "body").join(above, ["pose", "parent"]).select("pose", "body", R.compose(R.inverse(F.col("above")), F.col("t")).alias("t"))
    told = lambda df: sorted(map(str, df.collect()))
    assert told(X.relative_bodies(bodies, parents, ["pose"])) == told(want) and want.count() == 5


def test_no_row_is_dealt_by_a_name(spark):
    """A body's or a subset's name has few values, so an exchange by it alone would fill a task (relative_bodies, pose trees, gqs_select)."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        relative, scaled, buffers, chosen = (plan(f(spark, SF)) for f in (P.relative_bodies, P.scaled_skeleton, P.buffer_effectors, L.gqs_select))
        frames = spark.range(9).select((F.col("id") % 3).alias("motion"), F.col("id").alias("joint"), F.lit(1.0).alias("q"))
        conformed = plan(J.conformed(frames, spark.range(4).select(F.col("id").alias("joint"), F.lit(0.5).alias("ref")), ["motion"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert set(re.findall(r"hashpartitioning\((\w+)#", relative)) == {"user_id"} and "REPARTITION_BY_NUM" in relative
    alone = r"hashpartitioning\((joint|subset|__j|_w\d+)#\w+, \d+\)"
    assert not any(re.search(alone, p) for p in (scaled, buffers, chosen, conformed))
