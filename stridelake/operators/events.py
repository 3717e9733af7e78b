"""Jump detection, gap clustering and rule verdicts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelake.operators import series as S


@dataclass(frozen=True)
class JumpRules:
    """Limits of the jump detector, in degrees and frames."""

    candidate: float = 3.0
    normalised: float = 0.08
    normalised_least: float = 2.0
    strong: float = 5.0
    severe: float = 10.0
    radius: int = 3
    support_least: float = 2.0
    support_share: float = 0.45
    support_count: int = 2
    isolated_share: float = 0.25
    large_position: float = 0.20
    large_rotation: float = 30.0
    small_position: float = 0.03
    small_rotation: float = 8.0
    upgrade_acc: float = 50_000.0
    upgrade_dq: float = 8.0
    upgrade_severe: int = 2
    upgrade_strong: int = 3


@dataclass(frozen=True)
class ReclassRules:
    """Degrees of strong and severe jumps, and distinct joints of either that make a true switch."""

    strong: float = 5.0
    severe: float = 10.0
    least_strong: int = 2
    least_severe: int = 2


@dataclass(frozen=True)
class DatasetRules:
    """Degrees from which a step counts by chain, the norm over an arm's window that is an event, severe ones of both, and the gap of clusters."""

    limits: tuple[tuple[str, float], ...] = (("upper", 1.0), ("lower", 5.0), ("torso_head", 3.0))
    other: float = 5.0
    window: float = 45.0
    severe: float = 10.0
    severe_window: float = 67.5
    gap: int = 1


def severity(dq: Column, rules: JumpRules) -> Column:
    return F.when(dq >= rules.severe, "severe").when(dq >= rules.strong, "strong").otherwise("candidate")


def detect_jumps(df: DataFrame, keys: list[str], fps: float, rules: JumpRules = JumpRules(), value: str = "q", span: str | None = None, moved: str | None = None, turned: str | None = None) -> DataFrame:
    """Candidate steps of each series with their class and reason.

    ``span`` is a column with the joint's range, for the normalised test; ``moved`` and ``turned`` are optional changes of the body (metres,
    degrees). Rules in order: enough neighbours that move alike are dynamic motion, a large change of the body a
    discontinuity of the source, an isolated jump a probable branch switch, all else a possible one.
    """
    none = F.lit(None).cast("double")
    rows = S.motion_derivatives(S.wrapped_steps(df, keys, value), keys, fps)
    rows = S.neighbour_stats(rows, keys, rules.radius)
    rows = S.dynamic_support(rows, keys, rules.radius, rules.support_least, rules.support_share)
    size = F.abs("dq")
    normal = size / F.col(span) if span else none
    position, rotation = (F.col(c) if c else none for c in (moved, turned))
    candidate = (size >= rules.candidate) | ((normal >= rules.normalised) & (size >= rules.normalised_least))
    large = F.coalesce((position >= rules.large_position) | (rotation >= rules.large_rotation), F.lit(False))
    small = (position.isNull() | (position <= rules.small_position)) & (rotation.isNull() | (rotation <= rules.small_rotation))
    isolated = (size >= rules.strong) & (F.col("near_max") <= F.greatest(F.lit(rules.normalised_least), rules.isolated_share * size))
    dynamic = F.col("support") >= rules.support_count
    kind = (
        F.when(dynamic, "high_dynamic_motion").when(large, "source_or_retarget_discontinuity").when(isolated, "probable_branch_switch").otherwise("possible_branch_switch")
    )
    reason = (
        F.when(dynamic, "neighbouring frames move alike").when(large, "body moves with the joint")
        .when(isolated & small, "isolated jump, body hardly moves").when(isolated, "isolated jump").otherwise("large step")
    )
    found = rows.where(F.coalesce(candidate, F.lit(False)))
    return found.withColumns({"abs_dq": size, "severity": severity(size, rules), "kind": kind, "reason": reason})


def upgrade_frames(events: DataFrame, keys: list[str], frame: str = "frame0", rules: JumpRules = JumpRules()) -> DataFrame:
    """Jumps of several joints in one frame with a violent acceleration become probable branch switches; discontinuities of the source stay."""
    w = Window.partitionBy(*keys, frame)
    joint = (
        (F.max(F.abs("acc")).over(w) >= rules.upgrade_acc) & (F.max("abs_dq").over(w) >= rules.upgrade_dq)
        & ((F.sum((F.col("severity") == "severe").cast("int")).over(w) >= rules.upgrade_severe)
           | (F.sum((F.col("severity") != "candidate").cast("int")).over(w) >= rules.upgrade_strong))
    )
    return events.withColumn("kind", F.when(joint & (F.col("kind") != "source_or_retarget_discontinuity"), "probable_branch_switch").otherwise(F.col("kind")))


def motion_risk(kinds: Column, clean_allow_possible: bool = False) -> Column:
    """Risk of a motion from the array of its events' classes."""
    possible = F.lit("clean_or_dynamic") if clean_allow_possible else F.lit("possible_branch_switch")
    return (
        F.when(F.array_contains(kinds, "probable_branch_switch"), "probable_branch_switch")
        .when(F.array_contains(kinds, "possible_branch_switch"), possible).otherwise("clean_or_dynamic")
    )


def gap_clusters(events: DataFrame, keys: list[str], frame: str = "frame0", gap: int = 1, tie: str = "joint") -> DataFrame:
    """Adds ``cluster``, counted from 0: a new one begins where the frame is more than ``gap`` after the largest before it."""
    w = Window.partitionBy(*keys).orderBy(frame, tie)
    starts = F.coalesce((F.col(frame) - F.lag(frame).over(w) > gap).cast("long"), F.lit(0))
    return events.withColumn("__new", starts).withColumn("cluster", F.sum("__new").over(w)).drop("__new")


def cluster_summary(events: DataFrame, keys: list[str], frame: str = "frame0") -> DataFrame:
    """One row per cluster: frames, counts of events and of distinct joints and chains, sorted names, largest step."""
    return events.groupBy(*keys, "cluster").agg(
        F.min(frame).alias("start_frame"), F.max(frame).alias("end_frame"), F.count("*").alias("event_count"),
        F.array_sort(F.collect_set("joint")).alias("joints"), F.array_sort(F.collect_set("chain")).alias("chains"),
        F.max("abs_dq").alias("max_abs_dq"), F.max_by("frame0", F.struct("abs_dq", -F.col("frame0"))).alias("peak_frame"),
        F.count_if(F.col("abs_dq") >= 10).alias("severe_count"),
    )


def transient_verdict(joints: Column, chains: Column) -> Column:
    """One chain and one or two joints can be repaired, all else is hard."""
    return F.when((F.size(chains) == 1) & F.size(joints).between(1, 2), "repairable_transient_spike").otherwise("hard_transient_multijoint_or_multichain")


def transient_motions(steps: DataFrame, motion: str, limit: float, gap: int = 1) -> tuple[DataFrame, DataFrame]:
    """Clusters of the steps larger than ``limit`` and one row per motion with its risk, from ``steps(motion, joint, chain, frame0, dq)`` of all motions."""
    hits = steps.withColumn("abs_dq", F.abs("dq")).where(F.col("abs_dq") > limit)
    found = cluster_summary(gap_clusters(hits, [motion], gap=gap), [motion])
    found = found.withColumn("risk", transient_verdict(F.col("joints"), F.col("chains")))
    counts = found.groupBy(motion).agg(F.sum("event_count").alias("events"), F.count_if(F.startswith("risk", F.lit("hard"))).alias("hard"), F.count("*").alias("clusters"))
    every = steps.groupBy(motion).agg(F.max(F.abs("dq")).alias("max_abs_dq")).join(counts, motion, "left").fillna(0, ["events", "hard", "clusters"])
    risk = F.when(F.col("hard") > 0, "hard_transient_multijoint_or_multichain").when(F.col("clusters") > 0, "repairable_transient_spike").otherwise("clean")
    return found, every.withColumn("risk", risk)


def chain_threshold(chain: Column, limits: dict[str, float], other: float) -> Column:
    """The threshold of a joint's chain."""
    out = F.lit(other)
    for name, limit in limits.items():
        out = F.when(chain == name, F.lit(limit)).otherwise(out)
    return out


def dataset_verdict(chains: Column, has_window: Column, upper_joints: Column, severe_joints: Column) -> Column:
    """Legs alone are dynamic; an arm window, two upper joints or two severe joints are hard; the rest is a single joint to repair."""
    return (
        F.when((F.size(chains) == 1) & (chains[0] == "lower"), "lower_high_dynamic")
        .when(has_window | (upper_joints >= 2) | (severe_joints >= 2), "hard_ik_branch_switch").otherwise("repairable_single_joint_jump")
    )


def dataset_events(steps: DataFrame, windows: DataFrame, keys: list[str], rules: DatasetRules = DatasetRules()) -> DataFrame:
    """Clustered events of ``steps(keys, frame0, joint, chain, dq)`` beyond their chain's limit, and of ``windows(keys, frame0, side, norm)``, an arm's joints over a window.

    A window's event has the joint ``<side>_upper_chain_window`` in the upper chain and is marked ``windowed``.
    """
    hits = steps.withColumn("abs_dq", F.abs("dq")).where(F.col("abs_dq") >= chain_threshold(F.col("chain"), dict(rules.limits), rules.other))
    hits = hits.select(*keys, "frame0", "joint", "chain", "abs_dq", F.lit(False).alias("windowed"), (F.col("abs_dq") >= rules.severe).alias("severe"))
    large = windows.where(F.col("norm") >= rules.window)
    large = large.select(*keys, "frame0", F.concat("side", F.lit("_upper_chain_window")).alias("joint"), F.lit("upper").alias("chain"), F.col("norm").alias("abs_dq"), F.lit(True).alias("windowed"), (F.col("norm") >= max(rules.severe, rules.severe_window)).alias("severe"))
    return gap_clusters(hits.unionByName(large), keys, gap=rules.gap)


def dataset_clusters(events: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, cluster, events, risk)`` of :func:`dataset_events`."""
    distinct = lambda c: F.count_distinct(F.when(c, F.col("joint")))
    found = events.groupBy(*keys, "cluster").agg(
        F.count("*").alias("events"), F.collect_set("chain").alias("chains"), F.max("windowed").alias("windowed"), distinct((F.col("chain") == "upper") & ~F.col("windowed")).alias("uppers"), distinct(F.col("severe")).alias("severes")
    )
    return found.select(*keys, "cluster", "events", dataset_verdict(F.col("chains"), F.col("windowed"), F.col("uppers"), F.col("severes")).alias("risk"))


def reclass_verdict(severe_joints: Column, strong_joints: Column, rules: ReclassRules = ReclassRules()) -> Column:
    """Enough severe or strong distinct joints are a true switch, one strong joint a conflict to smooth, none low."""
    true = (severe_joints >= rules.least_severe) | (strong_joints >= rules.least_strong)
    return F.when(true, "true_ik_branch_switch").when(strong_joints >= 1, "repairable_smooth_conflict").otherwise("low_amplitude_possible")


def reclassified(events: DataFrame, keys: list[str], rules: ReclassRules = ReclassRules()) -> DataFrame:
    """``(keys, cluster, verdict)`` of clustered events."""
    joints = lambda limit: F.count_distinct(F.when(F.col("abs_dq") >= limit, F.col("joint")))
    found = events.groupBy(*keys, "cluster").agg(joints(rules.severe).alias("severe"), joints(rules.strong).alias("strong"))
    return found.select(*keys, "cluster", reclass_verdict(F.col("severe"), F.col("strong"), rules).alias("verdict"))


#: Verdicts by rising weight: a motion has the heaviest of its clusters.
RECLASS_ORDER = ("clean_or_dynamic", "low_amplitude_possible", "repairable_smooth_conflict", "true_ik_branch_switch")


def heaviest(verdict: Column, order: tuple[str, ...] = RECLASS_ORDER) -> Column:
    """Aggregate: the verdict that comes last in ``order``; the first for no rows."""
    names = F.array(*map(F.lit, order))
    return F.element_at(names, F.coalesce(F.max(F.array_position(names, verdict)), F.lit(1)).cast("int"))


def side_dominance(left: list[Column], right: list[Column], margin: float = 0.12) -> tuple[Column, Column]:
    """Mean of (l - r) / (l + r) over the pairs that have a positive sum, and left, right or balanced by the margin."""
    pairs = F.filter(F.array(*[F.struct(a.alias("l"), b.alias("r")) for a, b in zip(left, right)]), lambda p: p["l"] + p["r"] > 1e-12)
    total = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["l"] - p["r"]) / (p["l"] + p["r"]))
    score = F.when(F.size(pairs) > 0, total / F.size(pairs)).otherwise(F.lit(0.0))
    return score, F.when(score >= margin, "left").when(score <= -margin, "right").otherwise("balanced")
