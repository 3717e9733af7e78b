"""Quaternions, vectors and rigid transforms as plain structs of doubles, in native expressions.

Quaternions are ``struct<x, y, z, w>`` unless a function says otherwise, vectors ``struct<x, y, z>``. Plain structs let unused fields be pruned.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(f: Callable[..., Column]) -> Callable[..., Column]:
    """Evaluates the column arguments of ``f`` once: what follows refers to them by name instead of repeating their expressions.

    Formulas over structs use each argument many times, so nested ones would grow exponentially as plain expressions.
    """

    @wraps(f)
    def once(*args, **kwargs):
        places = [i for i, a in enumerate(args) if isinstance(a, Column)]
        held = F.struct(*[args[i].alias(f"a{i}") for i in places])
        return F.transform(F.array(held), lambda h: f(*[h[f"a{i}"] if i in places else a for i, a in enumerate(args)], **kwargs))[0]

    return once


def let(f: Callable[..., Column], **values: Column) -> Column:
    """``f`` of the values, each of which is evaluated once."""
    held = F.struct(*[v.alias(k) for k, v in values.items()])
    return F.transform(F.array(held), lambda h: f(**{k: h[k] for k in values}))[0]


def vec(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def quat(x: Column, y: Column, z: Column, w: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"), w.cast("double").alias("w"))


def dot(a: Column, b: Column, names: str = "xyzw") -> Column:
    total = a[names[0]] * b[names[0]]
    for n in names[1:]:
        total = total + a[n] * b[n]
    return total


def each(f: Callable[..., Column], *qs: Column, names: str = "xyzw") -> Column:
    return F.struct(*[f(*(q[n] for q in qs)).alias(n) for n in names])


@bound
def normalised(q: Column, least: float = 1e-8) -> Column:
    """The unit quaternion; one shorter than ``least`` is left as it is."""
    n = F.sqrt(dot(q, q))
    return each(lambda c: F.when(n > least, c / n).otherwise(c), q)


@bound
def normalised_floor(q: Column, least: float = 1e-12) -> Column:
    """Divided by the norm, but by ``least`` at least."""
    n = F.greatest(F.sqrt(dot(q, q)), F.lit(least))
    return each(lambda c: c / n, q)


@bound
def product(a: Column, b: Column) -> Column:
    """a b: first b, then a."""
    return quat(
        a["w"] * b["x"] + a["x"] * b["w"] + a["y"] * b["z"] - a["z"] * b["y"],
        a["w"] * b["y"] - a["x"] * b["z"] + a["y"] * b["w"] + a["z"] * b["x"],
        a["w"] * b["z"] + a["x"] * b["y"] - a["y"] * b["x"] + a["z"] * b["w"],
        a["w"] * b["w"] - dot(a, b, "xyz"),
    )


def conjugate(q: Column) -> Column:
    return quat(-q["x"], -q["y"], -q["z"], q["w"])


def angle_degrees(q: Column) -> Column:
    """How far a unit quaternion turns, 0 to 180."""
    return F.degrees(2 * F.acos(F.least(F.lit(1.0), F.abs(q["w"]))))


@bound
def angle_between(a: Column, b: Column) -> Column:
    return F.degrees(2 * F.acos(F.least(F.lit(1.0), F.abs(dot(a, b)))))


@bound
def rotation_vector(q: Column) -> Column:
    """Axis times angle in radians; twice the vector part for small angles."""
    n = F.sqrt(dot(q, q, "xyz"))
    s = F.when(q["w"] < 0, -1.0).otherwise(1.0)
    scale = F.when(n > 1e-8, 2 * F.atan2(n, s * q["w"]) / n).otherwise(F.lit(2.0))
    return each(lambda c: s * c * scale, q, names="xyz")


def axis_angle(axis: str, degrees: Column) -> Column:
    half = F.radians(degrees) / 2
    return quat(*[F.sin(half) if n == axis else F.lit(0.0) for n in "xyz"], F.cos(half))


def from_euler(order: str, degrees: list[Column]) -> Column:
    """Intrinsic turns about the axes of ``order``, one after the other (``xyz``: x first); extrinsic ones are the reverse order."""
    out = axis_angle(order[0], degrees[0])
    for axis, angle in zip(order[1:], degrees[1:]):
        out = product(out, axis_angle(axis, angle))
    return out


def from_euler_extrinsic(order: str, degrees: list[Column]) -> Column:
    return from_euler(order[::-1], degrees[::-1])


@bound
def to_euler_extrinsic_xyz(q: Column) -> Column:
    """Turns about the fixed x, y and z axes in degrees; the middle one is within 90."""
    x, y, z, w = (q[n] for n in "xyzw")
    sine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (w * y - z * x)))
    return vec(F.degrees(F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))), F.degrees(F.asin(sine)), F.degrees(F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))))


@bound
def rotate(q: Column, v: Column) -> Column:
    """v turned by the unit quaternion q."""
    cx, cy, cz = (2 * (q[a] * v[b] - q[b] * v[a]) for a, b in (("y", "z"), ("z", "x"), ("x", "y")))
    return vec(
        v["x"] + q["w"] * cx + q["y"] * cz - q["z"] * cy,
        v["y"] + q["w"] * cy + q["z"] * cx - q["x"] * cz,
        v["z"] + q["w"] * cz + q["x"] * cy - q["y"] * cx,
    )


def rotate_back(q: Column, v: Column) -> Column:
    return rotate(conjugate(q), v)


def transform(p: Column, q: Column) -> Column:
    return F.struct(p.alias("p"), q.alias("q"))


@bound
def compose(a: Column, b: Column) -> Column:
    """a after b."""
    turned = rotate(a["q"], b["p"])
    return transform(each(lambda m, n: m + n, turned, a["p"], names="xyz"), product(a["q"], b["q"]))


@bound
def inverse(t: Column) -> Column:
    back = conjugate(t["q"])
    return transform(each(lambda c: -c, rotate(back, t["p"]), names="xyz"), back)


def lerp(a: Column, b: Column, u: Column, names: str = "xyz") -> Column:
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), u))
    return each(lambda m, n: m + (n - m) * t, a, b, names=names)


@bound
def slerp(a: Column, b: Column, u: Column) -> Column:
    """The shorter arc from a to b; nearly equal ends are mixed linearly and normalised."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), u))
    d = dot(a, b)
    s = F.when(d < 0, -1.0).otherwise(1.0)
    theta = F.acos(F.least(F.lit(1.0), F.abs(d)))
    near = F.abs(d) > 0.9995
    wa = F.when(near, 1 - t).otherwise(F.sin((1 - t) * theta) / F.greatest(F.sin(theta), F.lit(1e-12)))
    wb = F.when(near, t).otherwise(F.sin(t * theta) / F.greatest(F.sin(theta), F.lit(1e-12))) * s
    return normalised(each(lambda m, n: m * wa + n * wb, a, b))


@bound
def twist(q: Column, axis: Column) -> Column:
    """The part of q that turns about a unit axis."""
    p = dot(q, axis, "xyz")
    return normalised(quat(axis["x"] * p, axis["y"] * p, axis["z"] * p, q["w"]))


@bound
def onto_plane(point: Column, normal: Column) -> Column:
    d = dot(point, normal, "xyz")
    return each(lambda c, n: c - n * d, point, normal, names="xyz")


@bound
def same_rotation(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(dot(a, b)) >= 1 - tolerance


@bound
def same_position(a: Column, b: Column, tolerance: float) -> Column:
    diff = each(lambda m, n: m - n, a, b, names="xyz")
    return F.sqrt(dot(diff, diff, "xyz")) <= tolerance


#: Constant turns into other tools' spaces; a quarter turn about x, and about y and z.
_HALF = 0.5**0.5
SPACES = {"mujoco": (_HALF, 0.0, 0.0, _HALF), "maya": (0.5, 0.5, 0.5, 0.5)}


def to_space(space: str, v: Column, back: bool = False) -> Column:
    q = quat(*map(F.lit, SPACES[space]))
    return rotate_back(q, v) if back else rotate(q, v)


def heading(q: Column) -> Column:
    """The turn about z of a pose whose forward axis is -y."""
    forward = rotate(q, vec(F.lit(0.0), F.lit(-1.0), F.lit(0.0)))
    return axis_angle("z", F.degrees(F.atan2(forward["x"], -forward["y"])))


@bound
def floor_root(hip: Column) -> Column:
    """The pose on the floor below a hip (position and heading) and the hip's pose relative to it."""
    root = transform(vec(hip["p"]["x"], hip["p"]["y"], F.lit(0.0)), heading(hip["q"]))
    return F.struct(root.alias("root"), compose(inverse(root), hip).alias("rest"))


@bound
def two_bone_bend(upper: Column, lower: Column, reach: Column) -> Column:
    """Inner angle in degrees of a limb of two bones whose ends are ``reach`` apart (cosine rule, clamped to what the bones allow)."""
    d = F.greatest(F.abs(upper - lower) + 1e-6, F.least(upper + lower - 1e-6, reach))
    cosine = (upper * upper + lower * lower - d * d) / (2 * upper * lower)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def cross(a: Column, b: Column) -> Column:
    return vec(*[a[m] * b[n] - a[n] * b[m] for m, n in (("y", "z"), ("z", "x"), ("x", "y"))])


def length(v: Column) -> Column:
    return F.sqrt(dot(v, v, "xyz"))


@bound
def unit(v: Column, least: float = 1e-12) -> Column:
    n = F.greatest(length(v), F.lit(least))
    return each(lambda c: c / n, v, names="xyz")


@bound
def about(axis: Column, radians: Column) -> Column:
    """The turn about a unit axis."""
    s = F.sin(radians / 2)
    return quat(axis["x"] * s, axis["y"] * s, axis["z"] * s, F.cos(radians / 2))


@bound
def between(a: Column, b: Column) -> Column:
    """The shortest turn that brings the direction of a to that of b; none if one has no length."""
    axis, scale = cross(a, b), length(a) * length(b)
    q = quat(axis["x"], axis["y"], axis["z"], dot(a, b, "xyz") + scale)
    return F.when(scale > 1e-12, normalised(q)).otherwise(quat(*map(F.lit, (0.0, 0.0, 0.0, 1.0))))


@bound
def _corner(at: Column, one: Column, other: Column) -> Column:
    """The angle at a point between two others, in radians."""
    minus = lambda p: unit(each(lambda m, n: m - n, p, at, names="xyz"))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(minus(one), minus(other), "xyz"))))


@bound
def _opposite(side: Column, one: Column, other: Column) -> Column:
    """The angle opposite a side by the cosine rule, clamped, in radians."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (one * one + other * other - side * side) / (2 * one * other))))


@bound
def two_bone_pose(a: Column, b: Column, c: Column, target: Column, weight: Column, hint: Column, least: float = 1e-6) -> Column:
    """Transforms ``root``, ``mid`` and ``tip`` of a limb of two bones (from a by b to c) that reaches for the target, ``weight`` of the way.

    Root and middle turn about the limb's plane (through ``hint`` where it is not null) until the corner angles are those of the
    cosine rule, then the root swings the tip onto the line to the target. The tip's turn goes to the target's by the weight.
    """
    minus = lambda p, q: each(lambda m, n: m - n, p, q, names="xyz")
    ready = lambda t: transform(t["p"], normalised(t["q"]))
    only = lambda of, axis, bend: transform(vec(*map(F.lit, (0.0, 0.0, 0.0))), about(rotate_back(of["q"], axis), bend))

    def sized(goal: Column, along: Column, upper: Column, lower: Column) -> Column:
        reach = F.greatest(F.lit(least), F.least(length(minus(goal, a["p"])), upper + lower - least))
        plane = F.when(hint.isNotNull(), cross(along, minus(hint, a["p"]))).otherwise(cross(along, minus(b["p"], a["p"])))
        return let(lambda reach, axis: bent(goal, along, upper, lower, reach, axis), reach=reach, axis=unit(plane))

    def bent(goal: Column, along: Column, upper: Column, lower: Column, reach: Column, axis: Column) -> Column:
        bend_a = _opposite(lower, upper, reach) - _corner(a["p"], c["p"], b["p"])
        bend_b = _opposite(reach, upper, lower) - _corner(b["p"], a["p"], c["p"])
        turned = let(lambda t: swung(t, along, minus(goal, a["p"])), t=compose(a, only(a, axis, bend_a)))
        return let(lambda root, own: closed(root, own), root=turned, own=compose(compose(inverse(a), b), only(b, axis, bend_b)))

    def swung(t: Column, along: Column, wanted: Column) -> Column:
        return compose(t, transform(vec(*map(F.lit, (0.0, 0.0, 0.0))), between(rotate_back(t["q"], along), rotate_back(t["q"], wanted))))

    def closed(root: Column, own: Column) -> Column:
        def named(mid: Column) -> Column:
            end = lambda tip: F.struct(ready(root).alias("root"), ready(mid).alias("mid"), transform(tip["p"], slerp(tip["q"], target["q"], weight)).alias("tip"))
            return let(lambda tip: end(tip), tip=compose(mid, compose(inverse(b), c)))

        return let(lambda mid: named(mid), mid=compose(root, own))

    upper, lower = length(minus(b["p"], a["p"])), length(minus(b["p"], c["p"]))
    return let(sized, goal=lerp(c["p"], target["p"], weight), along=minus(c["p"], a["p"]), upper=upper, lower=lower)


def capsule_lowest(p: Column, axis: Column, radius: Column, half: Column) -> Column:
    """The lowest point of a capsule: the lower end of its centre line, a radius below."""
    sign = F.signum(axis["z"])
    end = each(lambda c, a: c - sign * half * a, p, axis, names="xyz")
    return vec(end["x"], end["y"], p["z"] - F.abs(axis["z"]) * half - radius)


def time_to_frame(seconds: Column, fps: float, frames: Column) -> Column:
    """Frame and blend to the next one at a time, clamped to the motion."""
    at = F.greatest(F.lit(0.0), F.least(seconds * fps, (frames - 1).cast("double")))
    frame = F.least(F.floor(at), F.greatest(frames - 2, F.lit(0)))
    return F.struct(frame.cast("long").alias("frame"), (at - frame).alias("blend"))


def geom_bottom(kind: Column, z: Column, axis_z: Column, size0: Column, size1: Column, size2: Column, extent_z: Column) -> Column:
    """The lowest z of a geom: capsules and cylinders by their axis, spheres by the radius, boxes by their turned half sizes."""
    return (
        F.when(kind.isin("capsule", "cylinder"), z - F.abs(axis_z) * size1 - size0)
        .when(kind == "sphere", z - size0).when(kind == "box", z - extent_z).otherwise(z)
    )


def geom_top(kind: Column, z: Column, axis_z: Column, size0: Column, size1: Column, size2: Column, extent_z: Column) -> Column:
    return -geom_bottom(kind, -z, axis_z, size0, size1, size2, extent_z)


@bound
def smooth_limit(q: Column, lo: Column, hi: Column, pad: float = 1.02, steep: float = 1.0, power: float = 6.5) -> Column:
    """0 within padded limits, rising to 1 outside as 1 - exp(-steep d^power), d relative to half the range."""
    half, middle = (hi - lo) / 2, (hi + lo) / 2
    d = F.abs(q - middle) / F.greatest(half * pad, F.lit(1e-9))
    return F.when(d <= 1, F.lit(0.0)).otherwise(1 - F.exp(-steep * F.pow(d, F.lit(power))))


def limit_violation(q: Column, lo: Column, hi: Column, unlimited: float = 9.9e5) -> Column:
    over = F.greatest(F.lit(0.0), q - hi) + F.greatest(F.lit(0.0), lo - q)
    return F.when(hi - lo > unlimited, F.lit(0.0)).otherwise(over)


def clamped(q: Column, lo: Column, hi: Column) -> Column:
    return F.least(hi, F.greatest(lo, q))


def cubic_hermite(u: Column, p0: Column, p1: Column, m0: Column, m1: Column) -> Column:
    """Between two values with slopes per unit of u."""
    return (2 * u**3 - 3 * u**2 + 1) * p0 + (u**3 - 2 * u**2 + u) * m0 + (3 * u**2 - 2 * u**3) * p1 + (u**3 - u**2) * m1


def quintic_hermite(u: Column, p0: Column, p1: Column, m0: Column, m1: Column, a0: Column, a1: Column) -> Column:
    """Also with second derivatives at both ends; the three high coefficients follow in closed form."""
    dp = p1 - p0 - m0 - a0 / 2
    dm, da = m1 - m0 - a0, a1 - a0
    c3, c4, c5 = 10 * dp - 4 * dm + da / 2, -15 * dp + 7 * dm - da, 6 * dp - 3 * dm + da / 2
    return p0 + m0 * u + a0 / 2 * u**2 + c3 * u**3 + c4 * u**4 + c5 * u**5


def stance_confidence(flat: Column, gap: Column, speed: Column, scales: tuple[float, float, float] = (0.05, 0.02, 0.2)) -> Column:
    return F.exp(-flat / scales[0]) * F.exp(-F.pow(gap / scales[1], F.lit(2.0))) * F.exp(-F.pow(speed / scales[2], F.lit(2.0)))
