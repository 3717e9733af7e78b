"""A curation stage: classify, repair what can be repaired, classify again, accept what is clean."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridelake.operators import events as E
from stridelake.operators import grouped as G
from stridelake.operators import series as S
from stridelake.storage import written


def repair_stage(frames: DataFrame, chain: Callable[[Column], Column], limit: float, gap: int = 1) -> tuple[DataFrame, DataFrame]:
    """``frames(motion, joint, frame, q)`` to a manifest and the accepted frames.

    Clean motions are taken as they are. Motions whose clusters all have one chain and one or two joints are repaired, joint by joint, and taken if no step is
    larger than ``limit`` afterwards, anywhere; all others are rejected. The manifest ``(motion, risk, decision, status, postcheck_risk, postcheck_events)`` has every
    motion. What is classified and repaired is written, so that neither runs twice and a lost executor repeats its part alone.
    """
    keys = ["motion", "joint"]
    steps = lambda df, q: S.wrapped_steps(df, keys, q).select(*keys, chain(F.col("joint")).alias("chain"), "frame0", "dq")
    clusters, motions = E.transient_motions(steps(frames, "q"), "motion", limit, gap)
    motions = frames.select("motion").distinct().join(motions.select("motion", "risk"), "motion", "left").fillna("clean", ["risk"])
    motions = written(motions)
    spikes = motions.where("risk = 'repairable_transient_spike'").select("motion")
    asked = clusters.join(spikes, "motion", "left_semi").select("motion", F.explode("joints").alias("joint"), F.col("start_frame").alias("start"), F.col("end_frame").alias("end"))
    told = written(asked)
    some = frames.join(spikes, "motion", "left_semi")
    still = some.join(told, keys, "left_anti").select(*keys, "frame", F.col("q").cast("double").alias("q"), F.col("q").cast("double").alias("repaired"))  # series without a cluster
    repaired = written(G.repair_clusters(some.join(told, keys, "left_semi"), told, limit).unionByName(still))
    _, after = E.transient_motions(steps(repaired, "repaired"), "motion", limit, gap)
    checked = motions.join(after.select("motion", F.col("risk").alias("postcheck_risk"), F.col("events").alias("postcheck_events")), "motion", "left")
    mended = F.col("risk") == "repairable_transient_spike"
    clean, good = F.col("risk") == "clean", mended & (F.col("postcheck_risk") == "clean")
    status = F.when(clean, "firstpass_clean").when(good, "repaired_postcheck_clean").when(mended, "repair_postcheck_not_clean").otherwise("firstpass_hard_manifest_only")
    manifest = written(checked.select("motion", "risk", F.when(clean | good, "accepted").otherwise("rejected").alias("decision"), status.alias("status"), "postcheck_risk", "postcheck_events"))
    whole = frames.join(manifest.where("status = 'firstpass_clean'"), "motion", "left_semi").select(*keys, "frame", "q")
    mended_frames = repaired.join(manifest.where("status = 'repaired_postcheck_clean'"), "motion", "left_semi").select(*keys, "frame", F.col("repaired").alias("q"))
    return manifest, whole.unionByName(mended_frames)


def stage_counts(manifest: DataFrame) -> DataFrame:
    """The counts of a stage's report as one row."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    return manifest.agg(
        F.count("*").alias("input_total"), is_("firstpass_clean").alias("firstpass_clean"), F.count_if(F.col("risk") == "repairable_transient_spike").alias("repairable_candidates"),
        is_("repaired_postcheck_clean").alias("repaired_postcheck_clean"), is_("repair_postcheck_not_clean").alias("repair_postcheck_rejected"), is_("firstpass_hard_manifest_only").alias("firstpass_hard_rejected"),
        F.count_if(F.col("decision") == "accepted").alias("accepted_total"), F.count_if(F.col("decision") == "rejected").alias("rejected_total"),
    )
