"""Calibration of human joints on robot bodies: scales and offsets by least squares, mirrored joints with one scale."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridelake.functions import rotations as R
from stridelake.storage import written

AXES = ("x", "y", "z")
TURN = ("x", "y", "z", "w")


@dataclass(frozen=True)
class CalibrationRules:
    """Bounds of a scale relative to the height ratio, the least span in metres of an axis that is solved, and the mode."""

    low: float = 0.3
    high: float = 1.5
    span: float = 0.02
    by_axis: bool = False
    align_root: bool = True


#: Sums of one joint: scales, offset and residual are linear, so their products are all that a solver needs.
_GRAM = [f"q{a}{b}" for i, a in enumerate(TURN) for b in TURN[i:]]
_BB = [f"bb{i}{j}" for i in range(3) for j in range(i, 3)]
_BF = [f"bf{i}{j}" for i in range(3) for j in range(3)]
_BG, _FG = [f"bg{i}" for i in range(3)], [f"fg{i}" for i in range(3)]
_LOW, _HIGH = [f"low{a}" for a in AXES], [f"high{a}" for a in AXES]


def _cell(p: str, axes=AXES) -> Column:
    return (R.vec if len(axes) == 3 else R.quat)(*[F.col(f"{p}{a}") for a in axes])


def _minus(a: Column, b: Column) -> Column:
    return R.each(lambda x, y: x - y, a, b, names="xyz")


def turn_sums(observations: DataFrame) -> DataFrame:
    """Per joint the sum of outer products of the robot's turns in the human's: ten numbers, added up in every task."""
    q = R.product(R.conjugate(R.normalised(_cell("hq", TURN))), R.normalised(_cell("rq", TURN)))
    rows = observations.select("joint", q.alias("q"))
    return rows.groupBy("joint").agg(*[F.sum(F.col(f"q.{n[1]}") * F.col(f"q.{n[2]}")).alias(n) for n in _GRAM])


def mean_turn(sums: dict[str, float]) -> np.ndarray:
    """The first eigenvector of the sum of outer products, with w not negative."""
    gram = np.array([[sums[f"q{a}{b}"] if f"q{a}{b}" in sums else sums[f"q{b}{a}"] for b in TURN] for a in TURN])
    v = np.linalg.eigh(gram)[1][:, -1]
    return v if v[3] >= 0 else -v


def _turns(observations: DataFrame) -> DataFrame:
    """``(joint, turn)``: one row a joint."""

    def of_sums(batches):
        for rows in batches:
            yield pd.DataFrame({"joint": rows["joint"], "turn": [mean_turn(r).tolist() for r in rows.to_dict("records")]})

    return turn_sums(observations).mapInPandas(of_sums, "joint string, turn array<double>")


def _systems(observations: DataFrame, turns: DataFrame, root_scale: float, rules: CalibrationRules) -> DataFrame:
    """Each observation as three linear equations ``goal = b0 s0 + b1 s1 + b2 s2 + f0 o0 + f1 o1 + f2 o2`` of scales by axis of the human root and the offset in the robot body."""
    t = F.col("turn")
    rows = observations.join(turns, "joint").withColumns({"human": R.normalised(_cell("hq", TURN)), "robot": R.normalised(_cell("rq", TURN)), "axes": R.normalised(_cell("uq", TURN))})
    rows = rows.withColumn("predicted", R.product(F.col("human"), R.quat(*[t[i] for i in range(4)])))
    scaled = [F.col(f"ur{a}") * root_scale for a in AXES]
    base = [F.coalesce(F.col(f"br{a}"), x) for a, x in zip(AXES, scaled)] if rules.align_root else scaled
    goal = R.vec(*[F.col(f"rp{a}") - x for a, x in zip(AXES, base)])
    local = R.rotate_back(F.col("axes"), _minus(_cell("hp"), _cell("ur")))
    error = F.degrees(2 * F.acos(F.least(F.lit(1.0), F.abs(R.dot(F.col("predicted"), F.col("robot"))))))
    rows = rows.withColumns({"goal": goal, "local": local, "turn_error": error})
    axis = lambda i: R.vec(*[F.lit(float(i == j)) for j in range(3)])
    b = {f"b{i}": R.each(lambda x, a=AXES[i]: x * F.col(f"local.{a}"), R.rotate(F.col("axes"), axis(i)), names="xyz") for i in range(3)}
    f = {f"f{i}": R.rotate(F.col("predicted"), axis(i)) for i in range(3)}
    return rows.withColumns({**b, **f})


def position_sums(systems: DataFrame) -> DataFrame:
    """Per joint the products of its equations and the span of its local places: thirty numbers, added up in every task."""
    dot = lambda x, y: F.sum(R.dot(F.col(x), F.col(y), "xyz"))
    return systems.groupBy("joint").agg(
        F.count("*").alias("samples"), *[dot(f"b{n[2]}", f"b{n[3]}").alias(n) for n in _BB], *[dot(f"b{n[2]}", f"f{n[3]}").alias(n) for n in _BF], *[dot(f"b{n[2]}", "goal").alias(n) for n in _BG],
        *[dot(f"f{n[2]}", "goal").alias(n) for n in _FG], *[F.min(f"local.{a}").alias(f"low{a}") for a in AXES], *[F.max(f"local.{a}").alias(f"high{a}") for a in AXES],
    )


class _Joints:
    """The sums of one joint or of a mirrored pair: scales by axis of the root's frame, an offset per joint."""

    def __init__(self, rows: pd.DataFrame, ratio: float, rules: CalibrationRules):
        rows = rows.sort_values("joint")
        self.names, self.ratio, self.rules, self.n = rows["joint"].tolist(), ratio, rules, rows["samples"].to_numpy(float)
        whole = lambda names: rows[names].to_numpy(float)
        self.bb = np.zeros((3, 3))
        for name, total in zip(_BB, whole(_BB).sum(axis=0)):
            self.bb[int(name[2]), int(name[3])] = self.bb[int(name[3]), int(name[2])] = total
        self.bf = whole(_BF).reshape(-1, 3, 3)
        self.bg, self.fg = whole(_BG).sum(axis=0), whole(_FG)
        self.span = whole(_HIGH).max(axis=0) - whole(_LOW).min(axis=0)

    def fit(self, free: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """Least squares over scales ``free @ s + fixed`` and the offsets: scales by axis, offsets, and whether the rank is full.

        Turned axes have length one, so an offset's own block is its count. Directions whose singular value is below 1e-7 of the greatest count as missing: squares tell no less.
        """
        k, m = free.shape[1], len(self.names)
        gram = np.zeros((k + 3 * m, k + 3 * m))
        gram[:k, :k] = free.T @ self.bb @ free
        right = np.zeros(k + 3 * m)
        right[:k] = free.T @ (self.bg - self.bb @ fixed)
        for i in range(m):
            at = slice(k + 3 * i, k + 3 * i + 3)
            gram[:k, at] = free.T @ self.bf[i]
            gram[at, :k] = gram[:k, at].T
            gram[at, at] = np.eye(3) * self.n[i]
            right[at] = self.fg[i] - self.bf[i].T @ fixed
        values, vectors = np.linalg.eigh(gram)
        good = values > max(values[-1], 0.0) * 1e-14
        found = vectors[:, good] @ ((vectors[:, good].T @ right) / values[good])
        return free @ found[:k] + fixed, found[k:].reshape(m, 3), bool(good.all())

    def offsets(self, scale: np.ndarray) -> np.ndarray:
        """Mean of what a scale leaves over, in each joint's own frame."""
        return (self.fg - np.einsum("mij,i->mj", self.bf, scale)) / self.n[:, None]

    def outside(self, scale: np.ndarray) -> np.ndarray:
        return (scale < self.rules.low * self.ratio) | (scale > self.rules.high * self.ratio)

    def solve(self) -> tuple[np.ndarray, np.ndarray, str, str]:
        """Scale by axis, offsets, state and note: by axis where that is asked for and the data allow it, else one scale, else the height ratio."""
        one, zero, plain = np.ones((3, 1)), np.zeros(3), np.full(3, self.ratio)
        if self.rules.by_axis:
            scale, offsets, full = self.fit(np.eye(3), zero)
            weak = self.outside(scale) | (self.span < self.rules.span)
            if full and not weak.any():
                return scale, offsets, "solved", ""
            if weak.sum() == 1:
                two, _, full = self.fit(np.eye(3)[:, ~weak], plain * weak)
                if full and not self.outside(two)[~weak].any():
                    two[weak] = two[~weak].mean()
                    return two, self.offsets(two), "solved_axis_filled_underconstrained", f"s{AXES[int(np.argmax(weak))]} is the mean of the other two"
        scale, offsets, full = self.fit(one, zero)
        if full and not self.outside(scale).any():
            return (scale, offsets, "solved_degenerated_single_axis", "one scale for all axes") if self.rules.by_axis else (scale, offsets, "solved", "")
        return plain, self.offsets(plain), "solved_fixed_scale_underconstrained", "the rank is too low or the scale out of bounds"

    def report(self) -> pd.DataFrame:
        scale, offsets, state, note = self.solve()
        return pd.DataFrame({"joint": self.names, "state": state, "note": note, "scale_group": "<->".join(self.names), "scale": [scale.tolist()] * len(self.names), "offset": offsets.tolist()})


# The states and columns of a calibration report.
REPORT = [
    "joint", "state", "note", "samples", "scale_group", "sx", "sy", "sz", "cx", "cy", "cz", "ox", "oy", "oz", "qx", "qy", "qz", "qw",
    "mean_position_error", "max_position_error", "mean_rotation_error", "max_rotation_error",
]


def root_solution(observations: DataFrame, root: str, ratio: float, rules: CalibrationRules = CalibrationRules()) -> tuple[float, float, float]:
    """The root's scale, fitted to heights and clipped to its bounds, and its offset in x and y; the ratio and nothing without observations."""
    rows = observations.where(F.col("joint") == root)
    tall = F.abs("urz") > 1e-6
    sums = rows.agg(F.sum(F.when(tall, F.col("urz") * F.col("rpz"))).alias("a"), F.sum(F.when(tall, F.col("urz") * F.col("urz"))).alias("b"), *[F.avg(c).alias(c) for c in ("rpx", "rpy", "urx", "ury")]).first()
    if sums["rpx"] is None:
        return ratio, 0.0, 0.0
    scale = min(max(sums["a"] / sums["b"], rules.low * ratio), rules.high * ratio) if sums["b"] else ratio
    return scale, sums["rpx"] - scale * sums["urx"], sums["rpy"] - scale * sums["ury"]


def partner_group(joint: Column) -> Column:
    """Left and right joints of one name are a group, all others their own."""
    return F.regexp_replace(joint, "^(Left|Right)", "<>")


def calibrate_joints(observations: DataFrame, root: str, ratio: float, rules: CalibrationRules = CalibrationRules()) -> DataFrame:
    """One row per joint: state, scales (effective and relative to the ratio), offset, turn and errors.

    ``observations(joint, hp*, hq*, ur*, uq*, rp*, rq*, br*)``: place and turn of the human joint, of the human root, of the robot body, and the
    place of the robot's root (null if unknown). The root comes first, from sums over its rows. Three passes over the pose pairs follow, each of which adds up a few numbers per joint
    in every task: the mean turns; the products of the linear equations, from which a joint or mirrored pair is solved; the errors. A group of one side alone is solved as a
    single joint. However many pairs a joint has, no task holds them.
    """
    scale, dx, dy = root_solution(observations, root, ratio, rules)
    turns = written(_turns(observations))
    systems = _systems(observations, turns, scale, rules)
    sums = position_sums(systems.where(F.col("joint") != root)).withColumn("grp", partner_group(F.col("joint")))
    solved = sums.groupBy("grp").applyInPandas(lambda rows: _Joints(rows, ratio, rules).report(), "joint string, state string, note string, scale_group string, scale array<double>, offset array<double>")
    at_root = turns.where(F.col("joint") == root).select("joint", F.lit("solved").alias("state"), F.lit("").alias("note"), F.lit(root).alias("scale_group"), F.array(*[F.lit(scale)] * 3).alias("scale"), F.array(F.lit(dx), F.lit(dy), F.lit(0.0)).alias("offset"))
    solutions = written(solved.unionByName(at_root))
    s, o = F.col("scale"), F.col("offset")
    parts = lambda n, v: [R.each(lambda x, i=i: x * v[i], F.col(f"{n}{i}"), names="xyz") for i in range(3)]
    limb = R.each(lambda *x: sum(x[1:], x[0]), *parts("b", s), *parts("f", o), names="xyz")
    whole = R.vec(*[F.col(f"ur{a}") * scale + x for a, x in zip(AXES, (dx, dy, 0.0))])
    away = F.when(F.col("joint") == root, R.length(_minus(whole, _cell("rp")))).otherwise(R.length(_minus(limb, F.col("goal"))))
    rows = systems.join(solutions, "joint").select("joint", away.alias("away"), "turn_error")
    errors = rows.groupBy("joint").agg(
        F.count("*").alias("samples"), F.avg("away").alias("mean_position_error"), F.max("away").alias("max_position_error"), F.avg("turn_error").alias("mean_rotation_error"), F.max("turn_error").alias("max_rotation_error"),
    )
    named = [s[i].alias(f"s{a}") for i, a in enumerate(AXES)] + [(s[i] / ratio).alias(f"c{a}") for i, a in enumerate(AXES)] + [o[i].alias(f"o{a}") for i, a in enumerate(AXES)]
    return solutions.join(turns, "joint").join(errors, "joint").select("*", *named, *[F.col("turn")[i].alias(f"q{a}") for i, a in enumerate(TURN)]).select(*REPORT)


def pose_observations(human: DataFrame, bodies: DataFrame, mapping: DataFrame, root: str) -> DataFrame:
    """The observations of :func:`calibrate_joints` from ``human(pair, joint, t)``, ``bodies(pair, body, t)`` and ``mapping(joint, t_body, r_body)``.

    Joints or bodies that a pair lacks give no row; the robot's root is null where a pair has no body for it; a pair without the human root is an error.
    """
    pairs = human.select("pair").distinct().join(human.where(F.col("joint") == root).select("pair", F.col("t").alias("ur")), "pair", "left")
    missing = F.raise_error(F.concat(F.lit(f"no {root} in "), F.col("pair").cast("string"))).cast(dict(pairs.dtypes)["ur"])
    pairs = pairs.withColumn("ur", F.coalesce("ur", missing))
    small = F.broadcast(mapping)
    own_root = bodies.join(F.broadcast(mapping.where(F.col("joint") == root).select(F.col("t_body").alias("body"))), "body").select("pair", F.col("t.p").alias("br"))
    place = bodies.select("pair", F.col("body").alias("t_body"), F.col("t.p").alias("rp"))
    turn = bodies.select("pair", F.col("body").alias("r_body"), F.col("t.q").alias("rq"))
    rows = human.join(small, "joint").join(pairs, "pair").join(place, ["pair", "t_body"]).join(turn, ["pair", "r_body"]).join(own_root, "pair", "left")
    parts = [(p, c, axes) for p, c, axes in (("hp", "t.p", AXES), ("hq", "t.q", TURN), ("ur", "ur.p", AXES), ("uq", "ur.q", TURN), ("rp", "rp", AXES), ("rq", "rq", TURN), ("br", "br", AXES))]
    return rows.select("pair", "joint", "t_body", "r_body", *[F.col(f"{c}.{a}").alias(f"{p}{a}") for p, c, axes in parts for a in axes])
