"""All diversity features against NumPy, motion by motion."""

import re

import numpy as np

from stridelake.operators import features as D
from stridelake.operators.grouped import spectral_peak
from stridelake.plans.diversity import JOINTS, tables

SF, FPS, SLOW = "/root/testdata/sf0.001", 30.0, 7.5


def wrapped(x):
    return (x + 180.0) % 360.0 - 180.0


def number(x):
    return float(x) if np.isfinite(x) else 0.0


def p95(x):
    return np.percentile(x, 95) if np.size(x) else 0.0


def mean(x):
    return np.mean(x) if np.size(x) else 0.0


def corr(a, b):
    return np.corrcoef(a, b)[0, 1] if len(a) >= 3 and a.std() > 1e-12 and b.std() > 1e-12 else 0.0


def expected(root, joints, bodies):
    """``root`` and the joints' and bodies' arrays by name; everything is written out from the definitions."""
    out = {}
    xyz, (roll, pitch, yaw) = root[:, :3], root[:, 3:].T
    step = np.hypot(*np.diff(xyz[:, :2], axis=0).T)
    speed, turn = step * FPS, wrapped(np.diff(yaw))
    whole = lambda a: np.r_[0.0, np.cumsum(wrapped(np.diff(a)))]
    net = np.linalg.norm(xyz[-1, :2] - xyz[0, :2])
    put = lambda g, **kw: out.update({f"{g}__{k}": number(v) for k, v in kw.items()})
    put("root_locomotion", duration_sec=(len(root) - 1) / FPS, path_xy_m=step.sum(), net_xy_m=net, net_over_path_xy=net / max(step.sum(), 1e-6), mean_xy_speed_m_s=mean(speed), max_xy_speed_m_s=speed.max(initial=0))
    put("root_locomotion", std_xy_speed_m_s=speed.std(), yaw_abs_change_deg=np.abs(turn).sum(), yaw_range_deg=np.ptp(whole(yaw)), mean_abs_yaw_rate_deg_s=mean(np.abs(turn)) * FPS, max_abs_yaw_rate_deg_s=np.abs(turn).max(initial=0) * FPS, vertical_path_m=np.abs(np.diff(xyz[:, 2])).sum())
    z = xyz[:, 2]
    put("height_posture", root_z_mean_m=z.mean(), root_z_min_m=z.min(), root_z_max_m=z.max(), root_z_range_m=np.ptp(z), root_z_std_m=z.std(), root_pitch_range_deg=np.ptp(whole(pitch)), root_roll_range_deg=np.ptp(whole(roll)))
    put("height_posture", root_pitch_rms_deg=np.sqrt(mean(pitch**2)), root_roll_rms_deg=np.sqrt(mean(roll**2)))
    vel = {j: wrapped(np.diff(q)) * FPS for j, q in joints.items()}
    acc, = ({j: np.diff(v) * FPS for j, v in vel.items()},)
    jerk = {j: np.diff(a) * FPS for j, a in acc.items()}
    ptp = {j: np.ptp(q) for j, q in joints.items()}
    arm, leg = ("shoulder", "elbow", "wrist"), ("hip", "knee", "ankle")
    pick = lambda side, words: [j for j in joints if j.startswith(side) and any(w in j for w in words)]
    rng = lambda names, f=np.mean: f([ptp[j] for j in names]) if names else 0.0
    fast = lambda names: mean(np.abs(np.concatenate([vel[j] for j in names]))) if names else 0.0
    ll, rl, la, ra = pick("left_", leg), pick("right_", leg), pick("left_", arm), pick("right_", arm)
    trunk = [j for j in joints if "waist" in j or "head" in j]
    both = lambda n: [j for j in (f"left_{n}", f"right_{n}") if j in joints]
    held = lambda names: mean(np.abs(np.concatenate([joints[j] for j in names])))
    put("height_posture", knee_mean_abs_deg=held(both("knee_joint")), knee_range_mean_deg=rng(both("knee_joint")), hip_pitch_mean_abs_deg=held(both("hip_pitch_joint")), hip_pitch_range_mean_deg=rng(both("hip_pitch_joint")), ankle_pitch_mean_abs_deg=held(both("ankle_pitch_joint")), waist_head_range_mean_deg=rng(trunk))
    lact, ract = (rng(x) + fast(x) / 120 for x in (ll, rl))
    hip, knee, elbow = ([joints[f"{s}_{n}"] for s in ("left", "right")] for n in ("hip_pitch_joint", "knee_joint", "elbow_roll_joint"))
    put("foot_gait_proxy", left_leg_range_mean_deg=rng(ll), right_leg_range_mean_deg=rng(rl), left_leg_range_max_deg=rng(ll, max), right_leg_range_max_deg=rng(rl, max), hip_pitch_lr_anti_corr=corr(hip[0], -hip[1]), knee_lr_corr=corr(*knee))
    put("foot_gait_proxy", lower_joint_vel_mean_abs_deg_s=fast(ll + rl), lower_joint_vel_p95_abs_deg_s=p95(np.abs(np.concatenate([vel[j] for j in ll + rl]))), leg_activity_asymmetry=abs(lact - ract), speed_to_leg_activity_ratio=mean(speed) / max(lact + ract, 1e-6))
    put("upper_body_workspace_proxy", left_arm_range_mean_deg=rng(la), right_arm_range_mean_deg=rng(ra), left_arm_range_max_deg=rng(la, max), right_arm_range_max_deg=rng(ra, max), arm_joint_vel_mean_abs_deg_s=fast(la + ra), elbow_lr_corr=corr(*elbow))
    put("upper_body_workspace_proxy", arm_activity_asymmetry=abs(rng(la) + fast(la) / 120 - rng(ra) - fast(ra) / 120), wrist_range_max_deg=rng([j for j in joints if "wrist" in j], max), **{f"{w}_range_mean_deg": rng([j for j in joints if w in j]) for w in arm})
    every = np.array(list(ptp.values()))
    put("joint_range_group", all_joint_range_mean_deg=every.mean(), all_joint_range_max_deg=every.max(), all_joint_range_std_deg=every.std(), all_joint_std_mean_deg=mean([q.std() for q in joints.values()]), active_joint_fraction_5deg=mean(every >= 5), active_joint_fraction_15deg=mean(every >= 15))
    put("joint_range_group", lower_upper_range_ratio=rng(ll + rl) / max(rng(la + ra), 1e-6), left_right_lower_range_asymmetry=abs(rng(ll) - rng(rl)), left_right_upper_range_asymmetry=abs(rng(la) - rng(ra)))
    put("periodicity_symmetry", leg_lr_range_symmetry=1 / (1 + abs(rng(ll) - rng(rl))), arm_lr_range_symmetry=1 / (1 + abs(rng(la) - rng(ra))))
    for name, unit, series in (("vel", "s", vel), ("acc", "s2", acc), ("jerk", "s3", jerk)):
        x = np.abs(np.concatenate(list(series.values())))
        put("dynamics_complexity", **{f"joint_{name}_mean_abs_deg_{unit}": mean(x), f"joint_{name}_p95_abs_deg_{unit}": p95(x), f"joint_{name}_max_abs_deg_{unit}": x.max(initial=0)})
    squares = [mean(np.concatenate(list(s.values())) ** 2) for s in (vel, acc)]
    xacc = np.abs(np.diff(speed)) * FPS
    put("dynamics_complexity", complexity_energy=squares[0] + 1e-4 * squares[1], root_xy_acc_mean_abs_m_s2=mean(xacc), root_xy_acc_max_abs_m_s2=xacc.max(initial=0))
    low, flat = {}, {}
    for b, v in bodies.items():
        d = np.diff(v[:, :3], axis=0)
        s, flat[b] = np.linalg.norm(d, axis=1) * SLOW, np.linalg.norm(d[:, :2], axis=1)
        low[b] = v[:, 2] <= np.percentile(v[:, 2], 10) + 0.025
        rel = {f"rel_{a}_{k}": f(v[:, 3 + i]) for i, a in enumerate("xyz") for k, f in (("mean", np.mean), ("range", np.ptp))}
        if b in ("pelvis", "torso", "head"):
            put("height_posture", **{f"fk_{b}_z_mean_m": v[:, 2].mean(), f"fk_{b}_z_range_m": np.ptp(v[:, 2])})
        if b == "head":
            put("height_posture", fk_head_rel_z_mean_m=rel["rel_z_mean"], fk_head_rel_z_range_m=rel["rel_z_range"])
        if b == "torso":
            put("height_posture", **{f"fk_torso_rel_{a}_range_m": rel[f"rel_{a}_range"] for a in "xyz"})
        if b not in ("pelvis", "torso"):
            put("dynamics_complexity", **{f"fk_{b}_speed_mean_m_s": mean(s), f"fk_{b}_speed_p95_m_s": p95(s), f"fk_{b}_acc_p95_m_s2": p95(np.abs(np.diff(s)) * SLOW)})
        side = b.split("_")[0]
        if b.endswith("foot"):
            put("foot_gait_proxy", **{f"fk_{b}_z_min_m": v[:, 2].min(), f"fk_{b}_z_range_m": np.ptp(v[:, 2]), f"fk_{b}_rel_z_range_m": rel["rel_z_range"], f"fk_{b}_xy_path_m": flat[b].sum(), f"fk_{b}_speed_p95_m_s": p95(s), f"fk_{side}_contact_proxy_ratio": mean(low[b]), f"fk_{side}_low_xy_speed_mean_m_s": mean(flat[b][low[b][1:]]) * SLOW})
        if b.endswith("wrist"):
            put("upper_body_workspace_proxy", **{f"fk_{b}_{k}_m": x for k, x in rel.items()}, **{f"fk_{b}_path_m": s.sum() / SLOW, f"fk_{b}_speed_p95_m_s": p95(s)})
    lf, rf, lw, rw = (bodies[n] for n in ("left_foot", "right_foot", "left_wrist", "right_wrist"))
    apart = lambda a, b: np.linalg.norm(a[:, 3:] - b[:, 3:], axis=1)
    for g, n, x in (("foot_gait_proxy", "fk_foot_separation", apart(lf, rf)), ("foot_gait_proxy", "fk_step_width", np.abs(lf[:, 4] - rf[:, 4])), ("foot_gait_proxy", "fk_step_length", np.abs(lf[:, 3] - rf[:, 3])), ("upper_body_workspace_proxy", "fk_wrist_separation", apart(lw, rw))):
        put(g, **{f"{n}_mean_m": mean(x), f"{n}_range_m": np.ptp(x)})
    put("foot_gait_proxy", fk_double_support_proxy_ratio=mean(low["left_foot"] & low["right_foot"]), fk_flight_proxy_ratio=mean(~low["left_foot"] & ~low["right_foot"]), fk_foot_height_lr_corr=corr(lf[:, 2], rf[:, 2]))
    put("upper_body_workspace_proxy", fk_wrist_lr_height_corr=corr(lw[:, 2], rw[:, 2]))
    put("periodicity_symmetry", fk_foot_height_lr_corr=corr(lf[:, 2], rf[:, 2]), fk_wrist_height_lr_corr=corr(lw[:, 2], rw[:, 2]))
    for n, x, fps in (("root_speed", speed, FPS), ("hip_pitch_diff", hip[0] - hip[1], FPS), ("knee_diff", knee[0] - knee[1], FPS), ("fk_left_foot_height", lf[:, 2], SLOW), ("fk_right_foot_height", rf[:, 2], SLOW), ("fk_foot_height_diff", lf[:, 2] - rf[:, 2], SLOW)):
        share, hertz = spectral_peak(x, fps)
        put("periodicity_symmetry", **{f"{n}_fft_peak_ratio": share, f"{n}_fft_peak_hz": hertz})
    return out


def test_every_feature_of_every_motion(spark):
    root, joints, bodies = (t.orderBy("motion", "frame").collect() for t in tables(spark, SF))
    got = {r.motion: r.asDict() for r in D.diversity_features(*tables(spark, SF), "motion", FPS).collect()}
    motions = {r.motion for r in root}
    assert set(got) == motions and {len(r) for r in got.values()} == {153 + 2}
    for m in sorted(motions)[:8]:
        own = np.array([(r.x, r.y, r.z, r.roll, r.pitch, r.yaw) for r in root if r.motion == m])
        if len(own) < 2:
            continue
        series = {j: np.array([r.q for r in joints if r.motion == m and r.joint == j]) for j in JOINTS}
        places = {b: np.array([(r.x, r.y, r.z, r.rx, r.ry, r.rz) for r in bodies if r.motion == m and r.body == b]) for b in D.BODIES}
        want = expected(own, series, places)
        assert len(want) == 153 and set(want) == {c for c in got[m] if "__" in c}
        wrong = {k: (v, got[m][k]) for k, v in want.items() if not np.isclose(v, got[m][k], rtol=1e-6, atol=1e-7)}
        assert not wrong, (m, wrong)


def test_only_series_with_clusters_are_repaired(spark, monkeypatch):
    """A repair in Python gets the joints that have a cluster; the motion's others come back as they were."""
    from stridelake.functions import names as N
    from stridelake.operators import stages as T
    from stridelake.plans.curation import stage_frames

    given, repair = [], T.G.repair_clusters
    monkeypatch.setattr(T.G, "repair_clusters", lambda frames, clusters, limit: given.append(frames) or repair(frames, clusters, limit))
    frames = stage_frames(spark, SF)
    manifest, accepted = T.repair_stage(frames, N.chain, 30.0)
    assert {r.joint for r in given[0].select("joint").distinct().collect()} == {"left_elbow"}
    assert accepted.count() == frames.join(manifest.where("decision = 'accepted'"), "motion", "left_semi").count()


def test_joints_and_bodies_are_sorted_once(spark):
    """Percentiles are windows in the order that the steps need, and partitions of multiplied rows aren't joined by the bytes of the events (diversity_features)."""
    _, joints, bodies = tables(spark, SF)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df, by in ((D.joint_features(joints, "motion", FPS), "joint"), (D.body_features(bodies, "motion", FPS)[0].select("motion", "dynamics_complexity__fk_head_acc_p95_m_s2", "foot_gait_proxy__fk_left_contact_proxy_ratio"), "body")):
        told = plan(df)
        assert len(re.findall(rf"Sort \[motion#\w+ ASC NULLS FIRST, {by}#", told)) == 1 and "ObjectHashAggregate" not in told and "SortMergeJoin" not in told
        assert "REPARTITION_BY_NUM" in told


def test_joints_without_steps(spark):
    """One frame has no step: means and percentiles of speeds are null there, those of two frames stand on one step, accelerations on none."""
    rows = spark.createDataFrame([("one", 0, "left_knee_joint", 5.0), ("two", 0, "left_knee_joint", 5.0), ("two", 1, "left_knee_joint", 8.0), ("two", 0, "waist_yaw_joint", 1.0), ("two", 1, "waist_yaw_joint", 2.0)], "motion string, frame int, joint string, q double")
    got = {r.motion: r for r in D.joint_features(rows, "motion", 10.0).collect()}
    of = lambda m, *names: [got[m][f"dynamics_complexity__{n}"] for n in names]
    assert of("one", "joint_vel_mean_abs_deg_s", "joint_vel_p95_abs_deg_s", "joint_acc_p95_abs_deg_s2", "complexity_energy") == [None] * 4
    assert np.allclose(of("two", "joint_vel_mean_abs_deg_s", "joint_vel_p95_abs_deg_s", "joint_vel_max_abs_deg_s", "complexity_energy"), [20, 29, 30, 500])
    assert of("two", "joint_acc_mean_abs_deg_s2", "joint_jerk_max_abs_deg_s3") == [None, None] and got["two"]["foot_gait_proxy__lower_joint_vel_p95_abs_deg_s"] == 30
