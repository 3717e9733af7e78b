"""Writers: motion CSV, report tables, caches, exports."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.functions import rotations as R
from stridelake.operators import motion as X
from stridelake.operators import series as S
from stridelake.operators import stats as A
from stridelake.operators.relations import key_union
from stridelake.sources.motion_files import LAYOUTS, ROOT


def write_motion_csv(df: DataFrame, path: str, layout: str, mode: str = "errorifexists", per_motion: bool = True, rows_per_file: int = 500_000) -> None:
    """Motion files with the layout's header in its order, rows of a motion sorted by frame.

    One folder with one file per motion, as other tools read them; for large sets ``per_motion=False`` writes files of about ``rows_per_file``
    rows that have ``rel_path`` as a column, so there are not millions of small ones. The reader takes both.
    """
    columns = ("Frame", *ROOT, *LAYOUTS[layout])
    dealt = df.select("rel_path", *columns).repartition("rel_path").sortWithinPartitions("rel_path", "Frame")
    if per_motion:
        dealt.write.mode(mode).option("header", True).partitionBy("rel_path").csv(path)
    else:
        dealt.select(*columns, "rel_path").write.mode(mode).option("header", True).option("maxRecordsPerFile", rows_per_file).csv(path)


def adjusted_heights(df: DataFrame, offsets: DataFrame) -> DataFrame:
    """Root heights (cm) raised by each motion's offset (metres)."""
    return df.join(offsets, "rel_path", "left").withColumn(ROOT[2], F.col(ROOT[2]) + 100 * F.coalesce("offset", F.lit(0.0))).drop("offset")


def write_rows(df: DataFrame, path: str, fields: list[str], mode: str = "errorifexists") -> None:
    """A report with fixed fields; arrays are joined by semicolons, missing fields are empty."""
    kinds = dict(df.dtypes)

    def field(c: str):
        if c not in kinds:
            return F.lit(None).cast("string").alias(c)
        return (F.array_join(c, ";") if kinds[c].startswith("array") else F.col(c)).alias(c)

    df.select(*map(field, fields)).write.mode(mode).option("header", True).csv(path)


def write_union(frames: list[DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Tables of different columns as one report."""
    key_union(frames).write.mode(mode).option("header", True).csv(path)


SCORE_FIRST = ("motion", "passed", "score", "num_frames", "duration_sec", "path", "error")


def score_columns(df: DataFrame) -> DataFrame:
    """Score table with the known columns first, the others by name."""
    first = [c for c in SCORE_FIRST if c in df.columns]
    return df.select(*first, *sorted(c for c in df.columns if c not in first))


def append_cache(df: DataFrame, path: str) -> None:
    """Appends results as JSON lines."""
    df.write.mode("append").json(path)


def append_labels(df: DataFrame, path: str) -> str:
    """Appends review labels. If the stored table has other columns, they go to a version beside it that is named by a digest of the columns, so
    that two schemas never share a place. Returns where."""
    spark = df.sparkSession
    try:
        old = spark.read.parquet(path).dtypes
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        old = df.dtypes
    target = path if old == df.dtypes else f"{path}.{hashlib.sha256(repr(df.dtypes).encode()).hexdigest()[:12]}"
    df.write.mode("append").parquet(target)
    return target


def write_selection(df: DataFrame, path: str, by: list[str], overwrite: bool = False) -> None:
    """Selected motions as a partitioned table instead of copied files."""
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*by).parquet(path)


def motion_rows(df: DataFrame, joints: list[str], fps: float, count: int | None = None, motions: DataFrame | None = None) -> DataFrame:
    """One nested row per motion for training sets: root positions and rotations, joint values (the first ``count``), rate.

    Fewer joints than ``count`` are an error at once; a motion of ``motions(rel_path)`` without frames is one when the rows are made.
    """
    if count is not None and len(joints) < count:
        raise ValueError(f"{count} joints are expected, there are {len(joints)}")
    own = joints[:count] if count else joints
    frame = F.struct("Frame", F.array(*[F.col(c) for c in ROOT[:3]]).alias("p"), F.array(*[F.col(c) for c in ROOT[3:]]).alias("r"), F.array(*[F.col(c) for c in own]).alias("q"))
    held = df.groupBy("rel_path").agg(F.array_sort(F.collect_list(frame)).alias("f"))
    if motions is not None:
        held = motions.select("rel_path").distinct().join(held, "rel_path", "left")
        problem = F.raise_error(F.concat(F.lit("no frames: "), F.col("rel_path"))).cast(dict(held.dtypes)["f"])
        held = held.withColumn("f", F.coalesce("f", problem))
    return held.select("rel_path", F.lit(fps).alias("fps"), *[F.col(f"f.{k}").alias(n) for k, n in (("p", "root_position"), ("r", "root_rotation"), ("q", "dof"))])


def finite_differences(df: DataFrame, keys: list[str], values: list[str], fps: float, frame: str = "frame") -> DataFrame:
    """Adds ``<value>_vel``: half the step over both neighbours times the rate inside, the single step at the ends, 0 for one frame."""
    w = S.over(keys, frame)
    at = lambda v, k: F.lead(v, k).over(w) if k > 0 else F.lag(v, -k).over(w)

    def velocity(v: str):
        before, after = at(v, -1), at(v, 1)
        span = F.when(before.isNotNull() & after.isNotNull(), 2.0).otherwise(1.0)
        return (F.coalesce(after, F.col(v)) - F.coalesce(before, F.col(v))) * fps / span

    return df.withColumns({f"{v}_vel": velocity(v) for v in values})


def motion_export(joints: DataFrame, bodies: DataFrame, fps: float) -> DataFrame:
    """One nested row per motion: joint positions with their velocities, body positions and turns with linear and angular velocities.

    ``joints(motion, frame, joint, q)`` in radians, ``bodies(motion, frame, body, p, q)`` with p and q as structs. Body turns get signs without
    jumps first. Frames are arrays in order, each an array by name; ``joint_names`` and ``body_names`` give that order.
    """
    j = finite_differences(joints, ["motion", "joint"], ["q"], fps)
    own = ["motion", "body"]
    b = X.angular_velocity(X.canonical_signs(bodies, own), own, fps)
    b = finite_differences(b.withColumns({f"p{a}": F.col(f"p.{a}") for a in "xyz"}), own, ["px", "py", "pz"], fps)
    b = b.withColumn("v", F.struct(*[F.col(f"p{a}_vel").alias(a) for a in "xyz"]))

    def each_frame(field: str):
        return F.transform("f", lambda x: x["r"][field])

    def framed(df: DataFrame, name: str, columns: dict[str, str]) -> DataFrame:
        row = F.array_sort(F.collect_list(F.struct(name, *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns.values())])))
        frames = df.groupBy("motion", "frame").agg(row.alias("r"))
        whole = frames.groupBy("motion").agg(F.array_sort(F.collect_list(F.struct("frame", "r"))).alias("f"))
        parts = [each_frame(f"c{i}").alias(n) for i, n in enumerate(columns)]
        return whole.select("motion", F.get(F.col("f"), F.lit(0))["r"][name].alias(f"{name}_names"), *parts)

    left = framed(j, "joint", {"joint_pos": "q", "joint_vel": "q_vel"})
    right = framed(b, "body", {"body_pos": "p", "body_rot": "q", "body_lin_vel": "v", "body_ang_vel": "omega"})
    return left.join(right, "motion").withColumn("fps", F.lit(fps))


def target_export(targets: DataFrame, names: list[str], skipped: int, most: int | None = None) -> DataFrame:
    """Target poses of some joints for a solver, ``targets(motion, frame, target, p, q)``: without the first ``skipped`` frames (warm-up), renumbered, ``most`` frames at most."""
    kept = targets.where(F.col("target").isin(names) & (F.col("frame") >= skipped)).withColumn("frame", F.col("frame") - skipped)
    kept = kept if most is None else kept.where(F.col("frame") < most)
    row = F.array_sort(F.collect_list(F.struct("target", "p", "q"))).alias("r")
    return kept.groupBy("motion", "frame").agg(row).select("motion", "frame", F.col("r.target").alias("names"), F.col("r.p").alias("positions"), F.col("r.q").alias("rotations"))


def local_bodies(bodies: DataFrame, root: DataFrame) -> DataFrame:
    """Body positions as the root sees them: ``bodies(motion, frame, body, p)`` less the root's place, turned back; ``root(motion, frame, p, q)``."""
    held = root.select("motion", "frame", F.col("p").alias("__p"), F.col("q").alias("__q"))
    moved = R.each(lambda a, b: a - b, F.col("p"), F.col("__p"), names="xyz")
    joined = bodies.join(held, ["motion", "frame"]).withColumn("__d", moved)
    return joined.withColumn("p", R.rotate(R.conjugate(F.col("__q")), F.col("__d"))).drop("__p", "__q", "__d")


def library_index(motions: DataFrame, weight: float = 1.0) -> str:
    """The index of a motion library as YAML text, ``motions(file)`` in order of the name: a list for a person or a loader, one line per file."""
    lines = [f"  - file: {json.dumps(r['file'])}\n    weight: {weight}" for r in motions.select("file").distinct().orderBy("file").toLocalIterator()]
    return "\n".join(["motions:", *lines]) + "\n"


def score_summary(df: DataFrame, threshold: float, config: dict[str, object]) -> str:
    """The JSON beside a score table: threshold, counts and configuration (results themselves are the table)."""
    n = df.agg(F.count("*").alias("n"), F.count_if(F.col("passed")).alias("passed")).first()
    told = {"threshold": threshold, "num_motions": n["n"], "num_passed": n["passed"], "num_failed": n["n"] - n["passed"], "config": config}
    return json.dumps(told, indent=2)


PAIR_FIELDS = ("key", "renderable", "robot_type", "human_path", "robot_path")


def pair_manifest(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs of a review as rows of fixed fields, and their statistics: counts by robot type and whether a pair can be shown."""
    rows = pairs.select(*PAIR_FIELDS)
    return rows, rows.groupBy("robot_type").agg(F.count("*").alias("pairs"), F.count_if("renderable").alias("renderable"), F.count_distinct("key").alias("keys"))


def pose_documents(poses: DataFrame, robot: str) -> DataFrame:
    """One JSON text per pose file, named after its file: ``poses(path, body, p, q)`` as a map from body to seven numbers."""
    seven = F.array(*[F.col(f"p.{a}") for a in "xyz"], *[F.col(f"q.{a}") for a in "xyzw"])
    held = poses.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("body", seven.alias("t"))))).alias("robot_body_transforms"))
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    body = F.struct(F.lit("robot_pose.v1").alias("schema"), stem.alias("name"), F.lit(robot).alias("robot_type"), "robot_body_transforms")
    return held.select("path", F.to_json(body).alias("value"))


def calibration_report(joints: DataFrame, facts: dict[str, object]) -> str:
    """A calibration's report as Markdown: facts as a list, then a row per joint of ``joints(joint, status, samples, scale, mean_position, max_position, mean_rotation, max_rotation)``."""
    lines = ["# Calibration report", "", *(f"- {k}: {v}" for k, v in facts.items()), ""]
    titles = ("Joint", "Status", "Samples", "Scale", "Mean Pos m", "Max Pos m", "Mean Rot deg", "Max Rot deg")
    lines += [f"| {' | '.join(titles)} |", "| --- | --- | ---: | ---: | ---: | ---: | ---: | ---: |"]
    for r in joints.orderBy("joint").collect():  # a skeleton's joints
        values = (r["joint"], r["status"], r["samples"], f"{r['scale']:.6f}", *(f"{r[c]:.4f}" for c in ("mean_position", "max_position")), *(f"{r[c]:.2f}" for c in ("mean_rotation", "max_rotation")))
        lines.append(f"| {' | '.join(map(str, values))} |")
    return "\n".join(lines) + "\n"


def padded_table(df: DataFrame, columns: list[str], limit: int | None = None) -> str:
    """A small report with columns of even width: rates as percents, points of percent and other numbers with three digits, nothing for null."""

    def cell(c: str, v) -> str:
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            return str(v)
        return f"{100 * v:.2f}%" if c.endswith("_rate") or "_rate_" in c else f"{v:.3f}"

    rows = [[cell(c, r[c]) for c in columns] for r in (df.limit(limit) if limit is not None else df).select(*columns).collect()]  # a report
    if not rows:
        return "_No rows._"
    wide = [max(map(len, column)) for column in zip(columns, *rows)]
    line = lambda values: "| " + " | ".join(v.ljust(w) for v, w in zip(values, wide)) + " |"
    return "\n".join([line(columns), "| " + " | ".join("-" * w for w in wide) + " |", *map(line, rows)])


def clip_reports(samples: DataFrame, metrics: list[str]) -> dict[str, DataFrame]:
    """The four tables of an evaluation in one pass each over ``samples(source_path, robot, frame, status, reason, <metrics>)``: clips, their metrics, warnings and failures.

    ``clip_metrics`` has count, mean, extremes and confidence bounds per clip and metric, and per robot over all clips (source_path null).
    """
    by = ["source_path", "robot"]
    bad = lambda s: samples.where(F.col("status") == s).select(*by, "frame", "reason", *metrics)
    clips = samples.groupBy(*by).agg(
        F.count("*").alias("frames"), F.count_if(F.col("status") == "failed").alias("failures"), F.count_if(F.col("status") == "warning").alias("warnings"), *[F.max(m).alias(f"max_{m}") for m in metrics]
    )
    long = samples.unpivot(by, metrics, "metric", "x")
    sets = long.groupingSets([[*by, "metric"], ["robot", "metric"]], *by, "metric").agg(*A.welford(F.col("x")))
    return {"clips": clips, "clip_metrics": sets, "warnings": bad("warning"), "failures": bad("failed")}


def markdown_table(df: DataFrame, columns: list[str], limit: int = 30, digits: int = 4) -> str:
    """A report's first rows (the table must be ordered) as Markdown; numbers with fixed digits, very small or large ones in powers of ten."""

    def cell(v) -> str:
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        if isinstance(v, float):
            return f"{v:.{digits}e}" if v and not 1e-4 <= abs(v) < 1e6 else f"{v:.{digits}f}"
        return str(v).replace("|", "\\|")

    rows = df.select(*columns).limit(limit).collect()
    if not rows:
        return "_No rows._"
    lines = [" | ".join(columns), " | ".join("---" for _ in columns), *(" | ".join(cell(r[c]) for c in columns) for r in rows)]
    return "\n".join(f"| {x} |" for x in lines)
