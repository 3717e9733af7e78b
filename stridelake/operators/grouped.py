"""Operators that need a whole series at once: spectra, trajectory repair, calibration, quaternion means, skeleton files.

Each runs NumPy on one group per task; groups are single motions, joints or files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def spectral_peak(values: np.ndarray, fps: float, low: float = 0.2, high: float = 8.0, least: int = 16, most: int = 4096) -> tuple[float, float]:
    """Share of the strongest frequency in a band, and that frequency; (0, 0) for short or flat series. Longer ones are thinned evenly."""
    x = np.asarray(values, float)
    x = x[np.isfinite(x)]
    if len(x) < least:
        return 0.0, 0.0
    if len(x) > most:
        kept = np.linspace(0, len(x) - 1, most).astype(int)
        fps, x = fps * most / len(x), x[kept]
    power = np.abs(np.fft.rfft(x - x.mean())) ** 2
    freq = np.fft.rfftfreq(len(x), 1 / fps)
    band = (freq >= low) & (freq <= high)
    total = power[band].sum()
    if not band.any() or total <= 1e-12:
        return 0.0, 0.0
    best = int(np.argmax(power[band]))
    return float(power[band][best] / total), float(freq[band][best])


def spectral_peaks(df: DataFrame, key: str, value: str, fps: float, frame: str = "frame") -> DataFrame:
    def of_group(rows: pd.DataFrame) -> pd.DataFrame:
        share, hertz = spectral_peak(rows.sort_values(frame)[value].to_numpy(), fps)
        return pd.DataFrame({key: [rows[key].iloc[0]], "share": [share], "hertz": [hertz]})

    return df.select(key, frame, value).groupBy(key).applyInPandas(of_group, f"{key} {dict(df.dtypes)[key]}, share double, hertz double")


def unwrap_degrees(x: np.ndarray) -> np.ndarray:
    steps = (np.diff(x) + 180.0) % 360.0 - 180.0
    return np.concatenate([x[:1], x[:1] + np.cumsum(steps)])


def end_slope(y: np.ndarray, at_end: bool) -> float:
    """Slope per frame at one end of up to six values: a cubic through five or more, a parabola through three, else the difference."""
    n = len(y)
    if n < 2:
        return 0.0
    x = np.arange(n) - (n - 1 if at_end else 0)
    if n < 3:
        return float(y[1] - y[0])
    return float(np.polyfit(x, y, 3 if n >= 5 else 2)[-2])


def clipped_repair(x: np.ndarray, frame: int, pre: int = 4, post: int = 8, limit: float = 2.0) -> np.ndarray:
    """A cubic with slopes clipped to ``limit`` per frame between the frames around an event; the two ends stay as they are."""
    y = unwrap_degrees(x)
    left, right = max(0, frame - pre), min(len(y) - 1, frame + 1 + post)
    return _cubic(y, left, right, *(float(np.clip(s, -limit, limit)) for s in _slopes(y, left, right)))


def radius_repair(x: np.ndarray, frame: int, radius: int) -> np.ndarray:
    """A cubic between the frames ``radius`` before and after an event, with slopes fitted outside."""
    y = unwrap_degrees(x)
    left, right = max(0, frame - radius), min(len(y) - 1, frame + 1 + radius)
    return _cubic(y, left, right, *_slopes(y, left, right))


def _slopes(y: np.ndarray, left: int, right: int) -> tuple[float, float]:
    return end_slope(y[max(0, left - 5) : left + 1], True), end_slope(y[right : right + 6], False)


def _cubic(y: np.ndarray, left: int, right: int, m0: float, m1: float) -> np.ndarray:
    out, n = y.copy(), right - left
    if n > 1:
        u = np.arange(n + 1) / n
        h = ((2 * u**3 - 3 * u**2 + 1) * y[left] + (u**3 - 2 * u**2 + u) * m0 * n + (3 * u**2 - 2 * u**3) * y[right] + (u**3 - u**2) * m1 * n)
        out[left + 1 : right] = h[1:-1]
    return out


def anchor_change(before: np.ndarray, after: np.ndarray, left: int, right: int) -> float:
    """The largest change of the step into and out of the repaired window."""
    a, b = np.diff(unwrap_degrees(before)), np.diff(after)
    return float(max((abs(a[i] - b[i]) for i in (left - 1, right) if 0 <= i < len(a)), default=0.0))


def adaptive_repair(x: np.ndarray, frame: int, radii: tuple[int, ...] = tuple(range(12, 61, 6)), limit: float = 1.5) -> tuple[np.ndarray, int]:
    """The radius with the least change at its anchors (``limit`` at most), then the least step after, then the least radius; the first one if none is allowed."""
    best = None
    for r in radii:
        y = radius_repair(x, frame, r)
        left, right = max(0, frame - r), min(len(x) - 1, frame + 1 + r)
        change = anchor_change(x, y, left, right)
        if change <= limit:
            rank = (change, float(np.abs(np.diff(y)).max(initial=0.0)), r)
            if best is None or rank < best[0]:
                best = rank, y
    if best is None:
        return radius_repair(x, frame, radii[0]), radii[0]
    return best[1], best[0][2]


def repair_motions(frames: DataFrame, clusters: DataFrame, motion: str = "motion", limit: float = 90.0, method: str = "adaptive") -> DataFrame:
    """``frames(motion, frame, q)`` with the peaks of ``clusters(motion, peak)`` smoothed one after the other; steps of ``limit`` or less are left.

    Adds ``repaired``, the value after all repairs, and ``error`` for motions that cannot be repaired (a row, not an exception).
    """
    kind = dict(frames.dtypes)[motion]

    def of_motion(key, rows: pd.DataFrame, events: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame")
        y, error = rows["q"].to_numpy(float), None
        if not np.isfinite(y).all():
            error, out = "non-finite values", y
        else:
            out = unwrap_degrees(y) if len(y) else y
            for peak in sorted(events["peak"].astype(int)) if len(events) else []:
                if 0 <= peak < len(out) - 1 and abs((out[peak + 1] - out[peak] + 180) % 360 - 180) > limit:
                    out = adaptive_repair(out, peak)[0] if method == "adaptive" else clipped_repair(out, peak)
        return pd.DataFrame({motion: key[0], "frame": rows["frame"].to_numpy(), "q": y, "repaired": out, "error": error})

    schema = f"{motion} {kind}, frame long, q double, repaired double, error string"
    return frames.select(motion, "frame", "q").groupBy(motion).cogroup(clusters.select(motion, "peak").groupBy(motion)).applyInPandas(of_motion, schema)


def repair_clusters(frames: DataFrame, clusters: DataFrame, limit: float | None, keys: tuple[str, str] = ("motion", "joint")) -> DataFrame:
    """``frames(motion, joint, frame, q)`` with the largest step of each of ``clusters(motion, joint, start, end)`` smoothed adaptively, clusters one after the
    other by their frames; a step of ``limit`` or less by then is passed over, without a limit none is. Adds ``repaired``. One series is a task's group, a motion's frames at most."""
    kinds = dict(frames.dtypes)

    def of_series(key, rows: pd.DataFrame, events: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame")
        out = rows["q"].to_numpy(float)
        for first, last in sorted(zip(events["start"].astype(int), events["end"].astype(int))) if len(rows) > 1 else []:
            lo, hi = max(0, first), min(len(out) - 2, last)
            if lo > hi:
                continue
            steps = np.abs((np.diff(out[lo : hi + 2]) + 180.0) % 360.0 - 180.0)
            if limit is None or steps.max() > limit:
                out = adaptive_repair(out, lo + int(steps.argmax()))[0]
        return pd.DataFrame({keys[0]: key[0], keys[1]: key[1], "frame": rows["frame"].to_numpy(), "q": rows["q"].to_numpy(float), "repaired": out})

    schema = f"{keys[0]} {kinds[keys[0]]}, {keys[1]} {kinds[keys[1]]}, frame long, q double, repaired double"
    events = clusters.select(*keys, "start", "end").toDF("__motion", "__joint", "start", "end")  # new columns: both sides may come from one table
    return frames.select(*keys, "frame", "q").groupBy(*keys).cogroup(events.groupBy("__motion", "__joint")).applyInPandas(of_series, schema)


def mean_quaternion(df: DataFrame, keys: list[str], names: tuple[str, ...] = ("x", "y", "z", "w")) -> DataFrame:
    """The mean rotation of each key: the first eigenvector of the sum of outer products, with w not negative. Ten sums are aggregated, then one small matrix is solved per key."""
    pairs = [(i, j) for i in range(4) for j in range(i, 4)]
    sums = df.groupBy(*keys).agg(F.array(*[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs]).alias("m"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for m in rows["m"]:
                a = np.zeros((4, 4))
                for (i, j), v in zip(pairs, m):
                    a[i, j] = a[j, i] = v
                q = np.linalg.eigh(a)[1][:, -1]
                out.append(q if q[3] >= 0 else -q)
            yield pd.concat([rows[keys].reset_index(drop=True), pd.DataFrame(np.array(out).reshape(-1, 4), columns=list(names))], axis=1)

    kinds = dict(df.dtypes)
    return sums.mapInPandas(solve, ", ".join([*[f"{k} {kinds[k]}" for k in keys], *[f"{n} double" for n in names]]))


BVH_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("joint_idx", T.IntegerType()), T.StructField("joint", T.StringType()), T.StructField("parent", T.StringType()),
    T.StructField("offset", T.ArrayType(T.DoubleType())), T.StructField("channel", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("frame", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("frame_time", T.DoubleType()),
])


Joints = list[tuple[str, str | None, list[float], list[str]]]


def _parts_of_bvh(text: str) -> tuple[Joints, list[str], float | None]:
    """Joints (name, parent, offset, channels), the lines of frames and the frame time of a hierarchy and motion file. Names lose their namespace."""
    head, _, motion = text.partition("MOTION")
    joints: Joints = []
    stack: list[int] = []
    pending: int | None = None
    tokens = iter(head.replace("{", " { ").replace("}", " } ").split())
    for token in tokens:
        if token in ("ROOT", "JOINT"):
            joints.append((next(tokens).split(":")[-1], joints[stack[-1]][0] if stack else None, [0.0] * 3, []))
            pending = len(joints) - 1
        elif token == "End":
            next(tokens)
            pending = -1
        elif token == "{":
            stack.append(pending if pending is not None else -1)
            pending = None
        elif token == "}":
            stack.pop()
        elif token == "OFFSET":
            values = [float(next(tokens)) for _ in range(3)]
            if stack and stack[-1] >= 0:
                joints[stack[-1]][2][:] = values
        elif token == "CHANNELS":
            count = int(next(tokens))
            joints[stack[-1]][3].extend(next(tokens) for _ in range(count))
    times = re.search(r"Frame Time:\s*([0-9.eE+-]+)", motion)
    frame_time = float(times.group(1)) if times else None
    body = motion[times.end() :] if times else ""
    return joints, [x for x in body.splitlines() if x.strip()], frame_time


def _values_of(path: str, lines: list[str], first: int, width: int) -> list[list[str]]:
    rows = [line.split() for line in lines]
    for frame, values in enumerate(rows, first):
        if len(values) != width:
            raise ValueError(f"{path}: frame {frame} has {len(values)} values, the hierarchy {width} channels")
    return rows


def parse_bvh(path: str, text: str) -> Iterator[tuple]:
    """Rows (joint, channel, frame, value) of a hierarchy and motion file; joints without channels have one row without frame."""
    joints, lines, frame_time = _parts_of_bvh(text)
    layout = [(i, c, place) for i, j in enumerate(joints) for place, c in enumerate(j[3])]
    for frame, line in enumerate(lines):
        for (i, channel, place), value in zip(layout, _values_of(path, [line], frame, len(layout))[0]):
            yield path, i, joints[i][0], joints[i][1], joints[i][2], channel, place, frame, float(value), frame_time
    for i, j in enumerate(joints):
        if not j[3]:
            yield path, i, j[0], j[1], j[2], None, None, None, None, frame_time


#: Rows of a batch (about) that is read from skeleton files.
BATCH = 20_000


def _batches_of_bvh(path: str, text: str) -> Iterator[pa.RecordBatch]:
    """The rows of :func:`parse_bvh` as batches: a frame's numbers become one row of a matrix."""
    joints, lines, frame_time = _parts_of_bvh(text)
    layout = [(i, c, place) for i, j in enumerate(joints) for place, c in enumerate(j[3])]
    bare = [(i, None, None) for i, j in enumerate(joints) if not j[3]]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.float64()), pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.float64()]

    def batch(rows: list[tuple], frames: pa.Array, values: pa.Array, times: int) -> pa.RecordBatch:
        each = [[i for i, *_ in rows], [joints[i][0] for i, *_ in rows], [joints[i][1] for i, *_ in rows], [joints[i][2] for i, *_ in rows], [r[1] for r in rows], [r[2] for r in rows]]
        at, n = pa.array(np.tile(np.arange(len(rows)), times)), len(rows) * times
        held = [pa.array(x, k).take(at) for x, k in zip(each, kinds[1:7])]
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(path, pa.string()), n), *held, frames, values, pa.repeat(pa.scalar(frame_time, pa.float64()), n)], names=BVH_SCHEMA.fieldNames())

    step = max(1, BATCH // max(1, len(layout)))
    for first in range(0, len(lines), step):
        rows = _values_of(path, lines[first : first + step], first, len(layout))
        if layout:
            frames = np.repeat(np.arange(first, first + len(rows)), len(layout))
            yield batch(layout, pa.array(frames, pa.int64()), pa.array(np.array(rows, float).ravel()), len(rows))
    if bare:
        yield batch(bare, pa.nulls(len(bare), pa.int64()), pa.nulls(len(bare), pa.float64()), 1)


def read_bvh(spark: SparkSession, path: str, pattern: str = "*.bvh", packed: bool = False) -> DataFrame:
    """All skeleton files under a path, a task's files one after the other, some thousand values at a time; ``place`` is a channel's among its joint's.

    ``packed``: the path holds the files as rows ``(path, value)`` of Parquet. Listing and opening a file for each of very many short motions costs more than reading them.
    """

    def of_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for rows in batches:
            for name, text in zip(rows.column(0), rows.column(1)):
                for part in _batches_of_bvh(name.as_py(), text.as_py() or ""):
                    held.append(part)
                    if sum(x.num_rows for x in held) >= BATCH:
                        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                        held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    if packed:
        return spark.read.schema("path string, value string").parquet(path).mapInArrow(of_files, BVH_SCHEMA)
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), "value").mapInArrow(of_files, BVH_SCHEMA)
