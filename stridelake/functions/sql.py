"""The expressions and operators for Spark SQL text: ``register(spark)`` makes functions and table functions that queries call by name."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

_Q = "STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE, w: DOUBLE>"
_V = "STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE>"
#: Native functions: name, parameters, result and body. Spark puts the body in the place of the call, so nothing leaves the JVM.
FUNCTIONS = (
    ("wrap_degrees", "a DOUBLE", "DOUBLE", "pmod(a + 180, 360) - 180"),
    ("finite_or", "a DOUBLE, other DOUBLE", "DOUBLE", "CASE WHEN a IS NULL OR isnan(a) OR abs(a) = double('infinity') THEN other ELSE a END"),
    ("quat", "x DOUBLE, y DOUBLE, z DOUBLE, w DOUBLE", _Q, "named_struct('x', x, 'y', y, 'z', z, 'w', w)"),
    ("quat_norm", f"q {_Q}", "DOUBLE", "sqrt(q.x * q.x + q.y * q.y + q.z * q.z + q.w * q.w)"),
    ("quat_unit", f"q {_Q}", _Q, "CASE WHEN quat_norm(q) > 1e-8 THEN quat(q.x / quat_norm(q), q.y / quat_norm(q), q.z / quat_norm(q), q.w / quat_norm(q)) ELSE q END"),
    ("quat_inverse", f"q {_Q}", _Q, "quat(-q.x, -q.y, -q.z, q.w)"),
    (
        "quat_product", f"a {_Q}, b {_Q}", _Q,
        "quat(a.w * b.x + a.x * b.w + a.y * b.z - a.z * b.y, a.w * b.y - a.x * b.z + a.y * b.w + a.z * b.x, a.w * b.z + a.x * b.y - a.y * b.x + a.z * b.w, a.w * b.w - a.x * b.x - a.y * b.y - a.z * b.z)",
    ),
    ("quat_angle", f"a {_Q}, b {_Q}", "DOUBLE", "degrees(2 * acos(least(1.0D, abs(a.x * b.x + a.y * b.y + a.z * b.z + a.w * b.w))))"),
    (
        "quat_rotate", f"q {_Q}, v {_V}", _V,
        "named_struct('x', v.x + 2 * (q.w * (q.y * v.z - q.z * v.y) + q.y * (q.x * v.y - q.y * v.x) - q.z * (q.z * v.x - q.x * v.z)),"
        " 'y', v.y + 2 * (q.w * (q.z * v.x - q.x * v.z) + q.z * (q.y * v.z - q.z * v.y) - q.x * (q.x * v.y - q.y * v.x)),"
        " 'z', v.z + 2 * (q.w * (q.x * v.y - q.y * v.x) + q.x * (q.z * v.x - q.x * v.z) - q.y * (q.y * v.z - q.z * v.y)))",
    ),
)


class MotionJumps:
    """``motion_jumps(TABLE(t), limit)``: of ``t`` with a motion, a frame and a value ``q`` in degrees, every wrapped step of more than ``limit`` as a row of kind ``event``, and a row of kind
    ``summary`` for each motion. Spark deals the table by motion and orders it by frame; the motion's type is the table's. A motion streams past: its last value and three numbers are held.
    """

    def __init__(self):
        self.motion, self.frame, self.last, self.frames, self.events, self.largest = None, None, None, 0, 0, 0.0

    @staticmethod
    def analyze(rows: AnalyzeArgument, limit: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not isinstance(rows.dataType, T.StructType):
            raise ValueError("motion_jumps takes a table and a limit")
        if missing := {"motion", "frame", "q"} - set(rows.dataType.fieldNames()):
            raise ValueError(f"the table of motion_jumps lacks {', '.join(sorted(missing))}")
        schema = T.StructType([
            T.StructField("motion", rows.dataType["motion"].dataType), T.StructField("kind", T.StringType()), T.StructField("frame0", T.LongType()), T.StructField("frame", T.LongType()),
            T.StructField("jump", T.DoubleType()), T.StructField("count", T.LongType()),
        ])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("motion")], orderBy=[OrderingColumn("frame")])

    def eval(self, row: Row, limit: float) -> Iterator[tuple]:
        q, frame = row["q"], row["frame"]
        self.motion = row["motion"]
        self.frames += 1
        if q is not None and self.last is not None:
            jump = abs((q - self.last + 180.0) % 360.0 - 180.0)
            self.largest = max(self.largest, jump)
            if jump > limit:
                self.events += 1
                yield self.motion, "event", self.frame, frame, jump, None
        if q is not None:
            self.last, self.frame = q, frame

    def terminate(self) -> Iterator[tuple]:
        if self.frames:
            yield self.motion, "summary", None, self.frames, self.largest, self.events


class SkeletonRows:
    """``skeleton_rows(text)``: the joints, channels and values of a skeleton file, one row a channel and frame."""

    def eval(self, text: str) -> Iterator[tuple]:
        from stridelake.operators.grouped import BVH_SCHEMA, parse_bvh

        places = [BVH_SCHEMA.fieldNames().index(c) for c in ("joint_idx", "joint", "parent", "channel", "place", "frame", "value")]
        for row in parse_bvh("", text or ""):
            yield tuple(row[i] for i in places)


def register(spark: SparkSession) -> None:
    """Temporary functions of the session: the expressions of :data:`FUNCTIONS`, ``motion_jumps`` and ``skeleton_rows``."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udtf.register("motion_jumps", udtf(MotionJumps))
    spark.udtf.register("skeleton_rows", udtf(SkeletonRows, returnType="joint_idx int, joint string, parent string, channel string, place int, frame long, value double"))
