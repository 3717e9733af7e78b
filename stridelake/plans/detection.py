"""Queries over event detection, clustering and verdicts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stridelake.functions import names as N
from stridelake.operators import chains as C
from stridelake.operators import events as E
from stridelake.operators import series as S
from stridelake.plans.base import TRACE, WRAP, query, table, trace
from stridelake.plans.series import FPS, STEPS, SUPPORT, long_joints, r6

M = ["motion"]
CHAIN = "CASE WHEN joint IN ('click', 'view') THEN 'upper' WHEN joint IN ('purchase', 'signup') THEN 'lower' ELSE 'torso_head' END"
EVENTS = f"""{STEPS},
hits AS (SELECT motion, frame0, joint, {CHAIN} AS chain, abs(dq) AS abs_dq FROM steps WHERE abs(dq) > 90),
marked AS (SELECT *, CASE WHEN frame0 - lag(frame0) OVER w > 1 THEN 1 ELSE 0 END AS fresh FROM hits WINDOW w AS (PARTITION BY motion ORDER BY frame0, joint)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY motion ORDER BY frame0, joint) AS cluster FROM marked),
clusters AS (SELECT motion, cluster::BIGINT AS cluster, min(frame0) AS start_frame, max(frame0) AS end_frame, count(*) AS event_count, list_sort(list(DISTINCT joint)) AS joint_list,
  count(DISTINCT joint) AS joint_count, count(DISTINCT chain) AS chain_count, min(chain) AS chain, max(abs_dq) AS max_abs_dq FROM numbered GROUP BY motion, cluster),
risks AS (SELECT *, CASE WHEN chain_count = 1 AND joint_count <= 2 THEN 'repairable_transient_spike' ELSE 'hard_transient_multijoint_or_multichain' END AS risk FROM clusters)"""


def event_chain(joint):
    return F.when(joint.isin("click", "view"), "upper").when(joint.isin("purchase", "signup"), "lower").otherwise("torso_head")


def transient(spark, sf_dir):
    """Steps of more than 90 degrees with their cluster."""
    steps = S.wrapped_steps(trace(spark, sf_dir), M)
    hits = steps.withColumns({"abs_dq": F.abs("dq"), "chain": event_chain(F.col("joint"))}).where("abs_dq > 90")
    return E.gap_clusters(hits, M)


def clusters(spark, sf_dir):
    found = E.cluster_summary(transient(spark, sf_dir), M)
    return found.withColumn("risk", E.transient_verdict(F.col("joints"), F.col("chains")))


@query("transient_events", f"WITH {EVENTS} SELECT motion, frame0, joint, chain, round(abs_dq, 6) AS abs_dq, cluster::BIGINT AS cluster FROM numbered")
def transient_events(spark, sf_dir):
    return transient(spark, sf_dir).select("motion", "frame0", "joint", "chain", r6(F.col("abs_dq"), "abs_dq"), "cluster")


@query("transient_clusters", f"""WITH {EVENTS} SELECT motion, cluster, start_frame, end_frame, event_count, joint_count, chain_count, array_to_string(joint_list, ';') AS joints, round(max_abs_dq, 6) AS max_abs_dq, risk FROM risks""")
def transient_clusters(spark, sf_dir):
    return clusters(spark, sf_dir).select(
        "motion", "cluster", "start_frame", "end_frame", "event_count", F.size("joints").cast("long").alias("joint_count"), F.size("chains").cast("long").alias("chain_count"),
        F.array_join("joints", ";").alias("joints"), r6(F.col("max_abs_dq"), "max_abs_dq"), "risk",
    )


SUMMARY = f"""{EVENTS}, summary AS (
  SELECT s.motion, s.frames, coalesce(c.clusters, 0) AS clusters, coalesce(c.hard, 0) AS hard, s.max_abs_dq,
    CASE WHEN coalesce(c.hard, 0) > 0 THEN 'hard_transient_multijoint_or_multichain' WHEN coalesce(c.clusters, 0) > 0 THEN 'repairable_transient_spike' ELSE 'clean' END AS risk
  FROM (SELECT motion, count(*) + 1 AS frames, max(abs(dq)) AS max_abs_dq FROM steps GROUP BY motion) s
  LEFT JOIN (SELECT motion, count(*) AS clusters, count(*) FILTER (WHERE risk = 'hard_transient_multijoint_or_multichain') AS hard FROM risks GROUP BY motion) c USING (motion))"""


def summary(spark, sf_dir):
    """Per motion: the largest step of all (not only of events), clusters and verdict."""
    steps = S.wrapped_steps(trace(spark, sf_dir), M).groupBy("motion").agg((F.count("*") + 1).alias("frames"), F.max(F.abs("dq")).alias("max_abs_dq"))
    found = clusters(spark, sf_dir).groupBy("motion").agg(F.count("*").alias("clusters"), F.count_if(F.col("risk") == "hard_transient_multijoint_or_multichain").alias("hard"))
    out = steps.join(found, "motion", "left").fillna(0, ["clusters", "hard"])
    risk = F.when(F.col("hard") > 0, "hard_transient_multijoint_or_multichain").when(F.col("clusters") > 0, "repairable_transient_spike").otherwise("clean")
    return out.withColumn("risk", risk)


@query("transient_motion_summary", f"WITH {SUMMARY} SELECT motion, frames, clusters, hard, round(max_abs_dq, 6) AS max_abs_dq, risk FROM summary")
def transient_motion_summary(spark, sf_dir):
    return summary(spark, sf_dir).withColumn("max_abs_dq", F.round("max_abs_dq", 6))


@query("risk_by_subset_all", f"""WITH {SUMMARY}, s AS (SELECT 'events' AS dataset, 'group' || (motion % 5) AS subset, risk FROM summary),
k AS (SELECT DISTINCT dataset, subset FROM s UNION ALL SELECT 'ALL', 'ALL'), r(risk) AS (VALUES ('clean'), ('repairable_transient_spike'), ('hard_transient_multijoint_or_multichain')),
c AS (SELECT dataset, subset, risk, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT 'ALL', 'ALL', risk, count(*) FROM s GROUP BY risk)
SELECT k.dataset, k.subset, r.risk, coalesce(c.n, 0) AS n FROM k CROSS JOIN r LEFT JOIN c ON c.dataset = k.dataset AND c.subset = k.subset AND c.risk = r.risk""")
def risk_by_subset_all(spark, sf_dir):
    """Counts by subset and verdict with rows for all together; verdicts that do not occur count 0."""
    rows = summary(spark, sf_dir).select(F.lit("events").alias("dataset"), F.concat(F.lit("group"), F.col("motion") % 5).alias("subset"), "risk")
    verdicts = ("clean", "repairable_transient_spike", "hard_transient_multijoint_or_multichain")
    counts = [F.count_if(F.col("risk") == v).alias(v) for v in verdicts]
    both = rows.groupingSets([["dataset", "subset"], []], "dataset", "subset").agg(*counts)
    named = both.select(F.coalesce("dataset", F.lit("ALL")).alias("dataset"), F.coalesce("subset", F.lit("ALL")).alias("subset"), *verdicts)
    return named.unpivot(["dataset", "subset"], list(verdicts), "risk", "n")


JUMPS = f"""{STEPS},
v AS (SELECT *, dq * 30 AS vel FROM steps), a AS (SELECT *, coalesce((vel - lag(vel) OVER w) * 30, 0) AS acc FROM v WINDOW w AS (PARTITION BY motion ORDER BY frame)),
n AS (SELECT *, coalesce(greatest(max(abs(dq)) OVER (PARTITION BY motion ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
    max(abs(dq)) OVER (PARTITION BY motion ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)), 0) AS near_max, {SUPPORT} AS support FROM a WINDOW w AS (PARTITION BY motion ORDER BY frame)),
jumps AS (SELECT motion, frame0, joint, acc, abs(dq) AS abs_dq, CASE WHEN abs(dq) >= 10 THEN 'severe' WHEN abs(dq) >= 5 THEN 'strong' ELSE 'candidate' END AS severity,
  CASE WHEN support >= 2 THEN 'high_dynamic_motion' WHEN abs(dq) >= 5 AND near_max <= greatest(2, 0.25 * abs(dq)) THEN 'probable_branch_switch' ELSE 'possible_branch_switch' END AS kind
  FROM n WHERE abs(dq) >= 3)"""


def jumps(spark, sf_dir):
    return E.detect_jumps(trace(spark, sf_dir), M, FPS)


@query("branch_switch_events", f"WITH {JUMPS} SELECT motion, frame0, joint, severity, kind, round(abs_dq, 6) AS abs_dq, round(acc, 4) AS acc FROM jumps")
def branch_switch_events(spark, sf_dir):
    return jumps(spark, sf_dir).select("motion", "frame0", "joint", "severity", "kind", r6(F.col("abs_dq"), "abs_dq"), F.round("acc", 4).alias("acc"))


@query("cluster_upgrade", f"""WITH {JUMPS}, g AS (SELECT *, (frame0 // 4) AS slot FROM jumps)
SELECT motion, frame0, severity, CASE WHEN max(abs(acc)) OVER w >= 50000 AND max(abs_dq) OVER w >= 8 AND (sum((severity = 'severe')::INT) OVER w >= 2 OR sum((severity <> 'candidate')::INT) OVER w >= 3)
  AND kind <> 'source_or_retarget_discontinuity' THEN 'probable_branch_switch' ELSE kind END AS kind FROM g WINDOW w AS (PARTITION BY motion, slot)""")
def cluster_upgrade(spark, sf_dir):
    """Jumps of one slot of four frames (several joints of one frame in motion data) upgrade each other."""
    slotted = jumps(spark, sf_dir).withColumn("slot", F.floor(F.col("frame0") / 4))
    return E.upgrade_frames(slotted, M, "slot").select("motion", "frame0", "severity", "kind")


@query("branch_motion_risk", f"""WITH {JUMPS} SELECT motion, count(*) AS events, count(*) FILTER (WHERE severity = 'severe') AS severe, count(DISTINCT frame0 // 10) AS slots,
 CASE WHEN bool_or(kind = 'probable_branch_switch') THEN 'probable_branch_switch' WHEN bool_or(kind = 'possible_branch_switch') THEN 'possible_branch_switch' ELSE 'clean_or_dynamic' END AS risk
FROM jumps GROUP BY motion""")
def branch_motion_risk(spark, sf_dir):
    found = jumps(spark, sf_dir).groupBy("motion").agg(
        F.count("*").alias("events"), F.count_if(F.col("severity") == "severe").alias("severe"), F.countDistinct(F.floor(F.col("frame0") / 10)).alias("slots"), F.collect_set("kind").alias("kinds")
    )
    return found.select("motion", "events", "severe", "slots", E.motion_risk(F.col("kinds")).alias("risk"))


DATASET = f"""{STEPS},
limits AS (SELECT motion, frame0, joint, {CHAIN} AS chain, abs(dq) AS abs_dq FROM steps),
hits AS (SELECT * FROM limits WHERE abs_dq >= CASE chain WHEN 'upper' THEN 100 WHEN 'lower' THEN 140 ELSE 120 END),
win AS (SELECT motion, frame AS frame0, sqrt({WRAP.format("lead(q, 24) OVER w - q")} ** 2 + {WRAP.format("lead(q, 25) OVER w - lead(q) OVER w")} ** 2) AS norm, lead(q, 25) OVER w AS nxt FROM trace WINDOW w AS (PARTITION BY motion ORDER BY frame)),
allhits AS (SELECT motion, frame0, joint, chain, abs_dq, false AS windowed FROM hits
  UNION ALL SELECT motion, frame0, 'left_upper_chain_window', 'upper', norm, true FROM win WHERE nxt IS NOT NULL AND norm >= 225),
marked AS (SELECT *, CASE WHEN frame0 - lag(frame0) OVER w > 1 THEN 1 ELSE 0 END AS fresh FROM allhits WINDOW w AS (PARTITION BY motion ORDER BY frame0, joint)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY motion ORDER BY frame0, joint)::BIGINT AS cluster FROM marked)"""


#: Limits for the fixture, whose values jump by hundreds of degrees.
DATASET_RULES = E.DatasetRules(limits=(("upper", 100.0), ("lower", 140.0)), other=120.0, window=225.0, severe=165.0, severe_window=165.0)


def dataset_hits(spark, sf_dir):
    """Steps of the fixture's one series, and windows of the left arm, whose joints are a frame's value and the next one's."""
    steps = S.wrapped_steps(trace(spark, sf_dir), M).withColumn("chain", event_chain(F.col("joint"))).select("motion", "frame0", "joint", "chain", "dq")
    arm = long_joints(spark, sf_dir).where("joint <> 'wrist'")
    windows = S.k_frame_delta(arm, ["motion", "joint"], 24).groupBy("motion", "frame").agg(F.sqrt(F.sum(F.col("delta") ** 2)).alias("norm"), F.count("*").alias("joints"))
    windows = windows.where("joints = 2").select("motion", F.col("frame").alias("frame0"), F.lit("left").alias("side"), "norm")
    return E.dataset_events(steps, windows, M, DATASET_RULES)


@query("ik_dataset_risk", f"""WITH {DATASET}, c AS (SELECT motion, cluster, count(*) AS events, count(DISTINCT chain) AS chains, min(chain) AS chain, bool_or(windowed) AS windowed,
  count(DISTINCT joint) FILTER (WHERE chain = 'upper' AND NOT windowed) AS uppers, count(DISTINCT joint) FILTER (WHERE abs_dq >= 165) AS severes FROM numbered GROUP BY motion, cluster)
SELECT motion, cluster, events, CASE WHEN chains = 1 AND chain = 'lower' THEN 'lower_high_dynamic' WHEN windowed OR uppers >= 2 OR severes >= 2 THEN 'hard_ik_branch_switch' ELSE 'repairable_single_joint_jump' END AS risk FROM c""")
def ik_dataset_risk(spark, sf_dir):
    return E.dataset_clusters(dataset_hits(spark, sf_dir), M)


RECLASS = f"""{EVENTS}, verdicts AS (SELECT motion, cluster::BIGINT AS cluster, CASE WHEN count(DISTINCT joint) FILTER (WHERE abs_dq >= 160) >= 2 OR count(DISTINCT joint) FILTER (WHERE abs_dq >= 120) >= 2 THEN 'true_ik_branch_switch'
  WHEN count(DISTINCT joint) FILTER (WHERE abs_dq >= 120) >= 1 THEN 'repairable_smooth_conflict' ELSE 'low_amplitude_possible' END AS verdict FROM numbered GROUP BY motion, cluster)"""


def reclassed(spark, sf_dir):
    return E.reclassified(transient(spark, sf_dir), M, E.ReclassRules(strong=120.0, severe=160.0))


@query("reclass", f"WITH {RECLASS} SELECT motion, cluster, verdict FROM verdicts")
def reclass(spark, sf_dir):
    return reclassed(spark, sf_dir)


@query("reclass_motion", f"""WITH {RECLASS}, m AS (SELECT DISTINCT motion FROM trace)
SELECT m.motion, CASE WHEN bool_or(verdict = 'true_ik_branch_switch') THEN 'true_ik_branch_switch' WHEN bool_or(verdict = 'repairable_smooth_conflict') THEN 'repairable_smooth_conflict'
 WHEN bool_or(verdict = 'low_amplitude_possible') THEN 'low_amplitude_possible' ELSE 'clean_or_dynamic' END AS risk FROM m LEFT JOIN verdicts v ON v.motion = m.motion GROUP BY m.motion""")
def reclass_motion(spark, sf_dir):
    """Every motion, also those without events, by its heaviest cluster."""
    motions = table(spark, sf_dir, "events").select(F.col("user_id").alias("motion")).distinct()
    return motions.join(reclassed(spark, sf_dir), "motion", "left").groupBy("motion").agg(E.heaviest(F.col("verdict")).alias("risk"))


@query("peak_frame", f"""WITH {EVENTS} SELECT motion, cluster::BIGINT AS cluster, (list(frame0 ORDER BY abs_dq DESC, frame0))[1] AS peak FROM numbered GROUP BY motion, cluster""")
def peak_frame(spark, sf_dir):
    """The frame of a cluster's largest step; the earliest of equals."""
    best = F.max_by("frame0", F.struct("abs_dq", -F.col("frame0")))
    return transient(spark, sf_dir).groupBy("motion", "cluster").agg(best.alias("peak"))


@query("session_clusters", f"WITH {EVENTS} SELECT motion, min(frame0) AS start_frame, count(*) AS events FROM numbered GROUP BY motion, cluster")
def session_clusters(spark, sf_dir):
    """Gap clusters as session windows: frames as seconds, sessions of one second merge if they touch."""
    steps = S.wrapped_steps(trace(spark, sf_dir), M).where(F.abs("dq") > 90).withColumn("at", F.timestamp_seconds("frame0"))
    found = steps.groupBy("motion", F.session_window("at", "1 second")).agg(F.min("frame0").alias("start_frame"), F.count("*").alias("events"))
    return found.select("motion", "start_frame", "events")


@query("side_dominance", """WITH p AS (SELECT c_custkey AS motion, greatest(c_acctbal, 0) AS l0, c_custkey % 97 AS r0, c_custkey % 31 AS l1, c_custkey % 29 AS r1 FROM customer),
s AS (SELECT motion, CASE WHEN l0 + r0 > 1e-12 THEN (l0 - r0) / (l0 + r0) END AS a, CASE WHEN l1 + r1 > 0 THEN (l1 - r1) / (l1 + r1)::DOUBLE END AS b FROM p),
m AS (SELECT motion, coalesce((coalesce(a, 0) + coalesce(b, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT, 0), 0) AS score FROM s)
SELECT motion, round(score, 6) AS score, CASE WHEN score >= 0.12 THEN 'left' WHEN score <= -0.12 THEN 'right' ELSE 'balanced' END AS side FROM m""")
def side_dominance(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    mod = lambda n: (F.col("c_custkey") % n).cast("double")
    score, dominant = E.side_dominance([F.greatest("c_acctbal", F.lit(0.0)), mod(31)], [mod(97), mod(29)])
    return c.select(F.col("c_custkey").alias("motion"), r6(score, "score"), dominant.alias("side"))


#: Bodies of the limbs: chain, kind, role, and the joint whose last value is the body's angle.
LIMBS = (
    ("right_arm", "arm", "middle", "click"), ("right_arm", "arm", "middle", "purchase"), ("right_arm", "arm", "end", "view"), ("right_arm", "arm", "end", "signup"),
    ("right_leg", "leg", "middle", "purchase"), ("right_leg", "leg", "end", "signup"), ("right_leg", "leg", "end", "view"),
)


def last_value(joint: str):
    """The last value of a joint so far, 0 before the first."""
    return F.coalesce(F.last(F.when(F.col("joint") == joint, F.col("q")), ignorenulls=True).over(S.over(M).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))


def limb_bodies(spark, sf_dir):
    """The bodies of all motions at every frame: turned about x by the last value of their joint, at the tip of a link of 0.3 m; errors lift the root by 1 mm a unit."""
    last, rows = last_value, trace(spark, sf_dir)
    bodies = [F.struct(*[F.lit(x).alias(n) for x, n in zip(limb[:3], ("chain", "kind", "role"))], F.lit(limb[3]).alias("body"), F.radians(last(limb[3])).alias("angle")) for limb in LIMBS]
    posed = rows.select("motion", "frame", (last("error") / 1000 + 0.9).alias("rz"), F.array(*bodies).alias("bodies"))
    flat = posed.select("motion", "frame", "rz", F.inline("bodies"))
    zero, half = F.lit(0.0), F.col("angle") / 2
    return flat.select(
        "motion", "chain", "kind", "role", "body", "frame", F.sin(half).alias("qx"), zero.alias("qy"), zero.alias("qz"), F.cos(half).alias("qw"),
        zero.alias("px"), (F.cos("angle") * 0.3).alias("py"), (F.sin("angle") * 0.3).alias("pz"), zero.alias("rx"), zero.alias("ry"), "rz",
    )


def _sql_turn(a: str, b: str) -> str:
    return f"degrees(2 * acos(least(1, abs({a[0]} * {b[0]} + {a[1]} * {b[1]}))))"


def _sql_last(joint: str) -> str:
    return f"coalesce(last_value(CASE WHEN joint = '{joint}' THEN q END IGNORE NULLS) OVER (PARTITION BY motion ORDER BY frame ROWS UNBOUNDED PRECEDING), 0)"


def _sql_ahead(k: int, scale: str = "") -> str:
    return _sql_turn((f"lead(x, {k}) OVER w", f"lead(w, {k}) OVER w"), ("x", "w")) + scale


_PEAKS = [(role, name) for role in ("middle", "end") for name in ("speed", "w24", "w48")]
_NEAR = {"v": ("speed", 3), "w24": ("w24", 48), "w48": ("w48", 72), "acc": ("acc", 6), "jerk": ("jerk", 6)}
_SERIES = f"""{TRACE}, limbs(chain, kind, role, body) AS (VALUES {", ".join(map(str, LIMBS))}),
posed AS (SELECT motion, frame AS i, {_sql_last("error")} / 1000 + 0.9 AS z, {", ".join(f"{_sql_last(j)} AS {j}" for j in ("click", "view", "purchase", "signup"))} FROM trace),
angled AS (SELECT motion, chain, kind, role, body, i, z, radians(CASE body WHEN 'click' THEN click WHEN 'view' THEN view WHEN 'purchase' THEN purchase ELSE signup END) AS a FROM posed, limbs),
placed AS (SELECT *, sin(a / 2) AS x, cos(a / 2) AS w, cos(a) * 0.3 AS py, sin(a) * 0.3 AS pz FROM angled),
moving AS (SELECT *, {_sql_ahead(1, " * 30")} AS speed, {_sql_ahead(24)} AS w24, {_sql_ahead(48)} AS w48, sqrt((lead(py) OVER w - py) ** 2 + (lead(pz) OVER w - pz) ** 2) AS step, abs(lead(z) OVER w - z) * 30 AS rise
  FROM placed WINDOW w AS (PARTITION BY motion, chain, role, body ORDER BY i)),
changing AS (SELECT *, (lead(speed) OVER w - speed) * 30 AS change FROM moving WINDOW w AS (PARTITION BY motion, chain, role, body ORDER BY i)),
series AS (SELECT *, abs(change) AS acc, abs(lead(change) OVER w - change) * 30 AS jerk FROM changing WINDOW w AS (PARTITION BY motion, chain, role, body ORDER BY i)),
own AS (SELECT motion, chain, role, body, count(*) AS n, coalesce(quantile_cont(speed, 0.99), 0) AS p99 FROM series GROUP BY ALL),
{", ".join(f"{r}_{c} AS (SELECT motion, chain, {c} AS value, body, i FROM series WHERE role = '{r}' AND {c} > 0 QUALIFY row_number() OVER (PARTITION BY motion, chain ORDER BY {c} DESC, body, i) = 1)" for r, c in _PEAKS)},
limb AS (SELECT motion, chain, kind, max(n) AS n FROM own JOIN (SELECT DISTINCT chain, kind FROM limbs) USING (chain) GROUP BY ALL),
peaks AS (SELECT l.*, {", ".join(f"coalesce({r}_{c}.value, 0) AS {r}_{c}, coalesce({r}_{c}.body, '') AS {r}_{c}_body, coalesce({r}_{c}.i, 0) AS {r}_{c}_i" for r, c in _PEAKS)}
  FROM limb l {" ".join(f"LEFT JOIN {r}_{c} ON {r}_{c}.motion = l.motion AND {r}_{c}.chain = l.chain" for r, c in _PEAKS)})"""
_ASKED = f"""asked AS (SELECT DISTINCT motion, chain, n, unnest(CASE WHEN kind = 'leg' THEN [least(middle_speed_i, end_speed_i)] ELSE [{", ".join(f"least({r}_{c}_i + {dict(speed=1, w24=12, w48=24)[c]}, n - 1)" for r, c in _PEAKS)}] END) AS c FROM peaks)"""
_NEAR = f"""near AS (SELECT s.*, n, c, greatest(0, c - 24) AS before, least(n - 1, c + 48) AS after FROM series s JOIN asked a ON a.motion = s.motion AND a.chain = s.chain AND s.i BETWEEN c - 120 AND c + 240),
turned AS (SELECT *, max(x) FILTER (WHERE i = before) OVER g AS x0, max(w) FILTER (WHERE i = before) OVER g AS w0 FROM near WINDOW g AS (PARTITION BY motion, chain, c, role, body)),
bodies AS (SELECT motion, chain, c, role, body, {", ".join(f"coalesce(max({name}) FILTER (WHERE abs(i - c) <= {r}), 0) AS {k}" for k, (name, r) in _NEAR.items())},
  coalesce(list_max(list_transform(string_split(array_to_string(list(CASE WHEN speed >= 500 THEN '1' ELSE '0' END ORDER BY i) FILTER (WHERE abs(i - c) <= 12 AND speed IS NOT NULL), ''), '0'), lambda t: length(t))), 0) AS run,
  coalesce(list_max(list_transform(string_split(array_to_string(list(CASE WHEN speed >= 300 THEN '1' ELSE '0' END ORDER BY i) FILTER (WHERE abs(i - c) <= 12 AND speed IS NOT NULL), ''), '0'), lambda t: length(t))), 0) AS slow_run,
  max({_sql_turn(("x", "w"), ("x0", "w0"))}) FILTER (WHERE i = least(n - 1, c + 96)) AS turned_late,
  coalesce(min({_sql_turn(("x", "w"), ("x0", "w0"))}) FILTER (WHERE i >= after AND i < greatest(after + 1, least(n, c + 240))), 0) AS stay, max({_sql_turn(("x", "w"), ("x0", "w0"))}) FILTER (WHERE i = after) AS turned,
  coalesce(sum(step) FILTER (WHERE i >= before AND i < after), 0) AS path, coalesce(max(step) FILTER (WHERE i >= before AND i < after), 0) AS step,
  sqrt((max(py) FILTER (WHERE i = after) - max(py) FILTER (WHERE i = before)) ** 2 + (max(pz) FILTER (WHERE i = after) - max(pz) FILTER (WHERE i = before)) ** 2) AS moved,
  max(z) FILTER (WHERE abs(i - c) <= 120) - min(z) FILTER (WHERE abs(i - c) <= 120) AS zr, coalesce(max(rise) FILTER (WHERE abs(i - c) <= 120 AND i < c + 120), 0) AS zv FROM turned GROUP BY ALL),
told AS (SELECT b.*, v / greatest(p99, 1e-6) AS outlier FROM bodies b JOIN own USING (motion, chain, role, body))"""
EVIDENCE = f"""{_SERIES}, {_ASKED}, {_NEAR},
{", ".join(f"{n} AS (SELECT * FROM told WHERE role = '{r}' AND {by} > 0 QUALIFY row_number() OVER (PARTITION BY motion, chain, c ORDER BY {by} DESC, body) = 1)" for n, r, by in (("fast", "end", "v"), ("far", "end", "w48"), ("mid", "middle", "w24"), ("midfast", "middle", "v")))},
roots AS (SELECT motion, chain, c, max(zr) AS zr, max(zv) AS zv, max(zr) >= 0.12 OR max(zv) >= 1 AS high FROM told GROUP BY ALL),
events AS (SELECT r.*, coalesce(far.w48, 0) AS w48, coalesce(far.path, fast.path, 0) AS path, coalesce(far.stay, fast.stay, 0) AS stay, coalesce(far.moved, fast.moved, 0) AS moved, coalesce(far.step, fast.step, 0) AS step, coalesce(fast.v, 0) AS v,
  coalesce(fast.outlier, 0) AS outlier, coalesce(midfast.body, mid.body) AS mid_body, coalesce(fast.body, far.body) AS end_body,
  coalesce(far.w48, 0) >= 95 AND coalesce(far.w24, fast.w24, 0) >= 65 AND coalesce(mid.w24, 0) >= 30 AS core, coalesce(mid.turned, 0) >= 25 AS inter,
  (coalesce(fast.v, 0) >= 650)::INT + (coalesce(midfast.v, 0) >= 350)::INT + (coalesce(fast.acc, 0) >= 30000)::INT + (coalesce(fast.jerk, 0) >= 3000000)::INT + (coalesce(fast.run, 0) >= 3)::INT AS t
  FROM roots r {" ".join(f"LEFT JOIN {n} ON {n}.motion = r.motion AND {n}.chain = r.chain AND {n}.c = r.c" for n in ("fast", "far", "mid", "midfast"))}),
judged AS (SELECT *, core::INT + (stay >= 80)::INT + inter::INT AS p, core AND stay >= 80 AND inter AND ((path <= 0.45 AND step <= 0.012) OR w48 / greatest(path, 1e-6) >= 900) AND NOT high AS drift, (t >= 4 OR outlier >= 5) AND NOT high AS snap FROM events),
ranked AS (SELECT *, CASE WHEN drift OR snap THEN 3 WHEN p >= 2 OR t >= 3 THEN 2 ELSE 1 END AS rank FROM judged),
best AS (SELECT *, CASE WHEN drift THEN 'upper_persistent_branch_drift' WHEN snap THEN 'upper_transient_snap' WHEN rank = 2 THEN 'upper_borderline_same_chain' ELSE 'none' END AS why FROM ranked
  QUALIFY row_number() OVER (PARTITION BY motion, chain ORDER BY rank DESC, p + t DESC, w48 DESC, v DESC, c) = 1),
full_rows AS (SELECT k.*, b.* EXCLUDE (motion, chain), kind = 'arm' AS arm, end_speed >= 360 OR end_w24 >= 45 AS review, CASE WHEN end_speed >= 360 THEN end_speed_i ELSE end_w24_i END AS review_i,
  middle_speed / greatest(coalesce(m.p99, 0), 1e-6) AS mr, end_speed / greatest(coalesce(e.p99, 0), 1e-6) AS er, (middle_speed >= 500 AND end_speed >= 650) OR (middle_w24 >= 55 AND end_w24 >= 80) AS both_move
  FROM peaks k JOIN best b ON b.motion = k.motion AND b.chain = k.chain LEFT JOIN own m ON m.motion = k.motion AND m.chain = k.chain AND m.role = 'middle' AND m.body = middle_speed_body
  LEFT JOIN own e ON e.motion = k.motion AND e.chain = k.chain AND e.role = 'end' AND e.body = end_speed_body),
decided AS (SELECT *, both_move AND mr >= 3 AND er >= 5 AND NOT high AS hard_leg, arm AND rank = 1 AND review AS looked FROM full_rows),
evidence AS (SELECT *, CASE WHEN arm THEN CASE WHEN rank = 3 THEN 'hard_ik_branch_switch' WHEN rank = 2 OR looked THEN 'review_or_repairable_dynamic' ELSE 'clean' END
    ELSE CASE WHEN hard_leg THEN 'hard_ik_branch_switch' WHEN both_move OR review THEN 'review_or_repairable_dynamic' ELSE 'clean' END END AS risk,
  CASE WHEN looked THEN 'upper_distal_review' WHEN arm THEN why WHEN hard_leg THEN 'lower_same_chain_intermediate_distal' WHEN both_move THEN 'lower_same_chain_dynamic_review' WHEN review THEN 'lower_distal_review' ELSE 'none' END AS reason,
  (CASE WHEN looked THEN review_i WHEN arm THEN c WHEN both_move THEN least(middle_speed_i, end_speed_i, middle_w24_i, end_w24_i) WHEN review THEN review_i ELSE middle_speed_i END)::BIGINT AS frame,
  CASE WHEN arm THEN mid_body END AS chosen_middle, CASE WHEN arm THEN end_body END AS chosen_end,
  greatest(middle_speed, end_speed, middle_w24 * 30 / 24, end_w24 * 30 / 24) AS top FROM decided)"""


def evidence(spark, sf_dir):
    return C.chain_evidence(limb_bodies(spark, sf_dir), "motion", FPS)


@query("chain_evidence", f"""WITH {EVIDENCE} SELECT motion, chain, risk, reason, frame, CASE WHEN arm THEN p ELSE 0 END AS persistent_score, CASE WHEN arm THEN t ELSE 0 END AS transient_score, high AS high_root_dynamic,
  round(zr, 6) AS root_z_range, round(zv, 4) AS root_speed, {", ".join(f"round({r}_{c}, 3) AS {r}_{c}" for r, c in _PEAKS)}, round(CASE WHEN arm THEN stay ELSE 0 END, 3) AS stay, round(CASE WHEN arm THEN outlier ELSE er END, 4) AS outlier_ratio,
  round(CASE WHEN arm THEN moved ELSE 0 END, 6) AS moved, round(CASE WHEN arm THEN path ELSE 0 END, 6) AS path, coalesce(chosen_middle, nullif(middle_speed_body, ''), middle_w24_body) AS middle_body, coalesce(chosen_end, nullif(end_speed_body, ''), end_w24_body) AS end_body FROM evidence""")
def chain_evidence(spark, sf_dir):
    """Branch-switch evidence of both limbs of every motion."""
    return evidence_rows(evidence(spark, sf_dir))


def evidence_rows(found):
    """Evidence as the queries show it."""
    digits = {"root_z_range": 6, "root_speed": 4, "stay": 3, "outlier_ratio": 4, "moved": 6, "path": 6} | {f"{r}_{c}": 3 for r, c in _PEAKS}
    out = found.drop("kind", "largest_step", "turn_per_path")
    return out.select(*[F.round(c, digits[c]).alias(c) if c in digits else c for c in out.columns])


@query("chain_motion_verdict", f"""WITH {EVIDENCE}, firsts AS (SELECT motion, chain AS top_chain, reason AS top_reason, round(top, 3) AS top_speed FROM evidence QUALIFY row_number() OVER (PARTITION BY motion ORDER BY top DESC, chain) = 1),
counted AS (SELECT motion, count(*) FILTER (WHERE risk = 'hard_ik_branch_switch') AS hard_chains, count(*) FILTER (WHERE risk = 'review_or_repairable_dynamic') AS review_chains,
  coalesce(string_agg(chain, ';' ORDER BY chain) FILTER (WHERE risk = 'hard_ik_branch_switch'), '') AS chains_hard, coalesce(string_agg(chain, ';' ORDER BY chain) FILTER (WHERE risk = 'review_or_repairable_dynamic'), '') AS chains_review FROM evidence GROUP BY motion)
SELECT *, CASE WHEN hard_chains > 0 THEN 'hard_ik_branch_switch' WHEN review_chains > 0 THEN 'review_or_repairable_dynamic' ELSE 'clean' END AS risk FROM counted JOIN firsts USING (motion)""")
def chain_motion_verdict(spark, sf_dir):
    out = C.chain_motion_verdict(evidence(spark, sf_dir), "motion", FPS)
    speed = F.greatest("top_middle_speed", "top_end_speed", F.col("top_middle_w24") * FPS / 24, F.col("top_end_w24") * FPS / 24)
    return out.select("motion", "risk", "hard_chains", "review_chains", "chains_hard", "chains_review", "top_chain", "top_reason", F.round(speed, 3).alias("top_speed"))


CASES = "cases AS (SELECT DISTINCT motion, chain, 30 AS c, CASE WHEN motion % 2 = 0 THEN 'hard' ELSE 'clean' END AS label FROM peaks WHERE n > 30)"


def cases(spark, sf_dir):
    """Both limbs at frame 30 of every motion that is longer, labelled by its number."""
    n = trace(spark, sf_dir).groupBy("motion").agg(F.count("*").alias("n")).where("n > 30")
    chains = F.explode(F.array(F.lit("right_arm"), F.lit("right_leg"))).alias("chain")
    return n.select("motion", chains, F.lit(30).alias("c"), F.when(F.col("motion") % 2 == 0, "hard").otherwise("clean").alias("label"))


_OF = {
    "end_v": ("end", "speed", "v"), "middle_v": ("middle", "speed", "v"), "acc": ("end", "speed", "acc"), "jerk": ("end", "speed", "jerk"), "run": ("end", "speed", "run"), "middle_run": ("middle", "speed", "slow_run"), "outlier": ("end", "speed", "outlier"),
    "stay": ("end", "speed", "stay"), "end_turned": ("end", "speed", "turned"), "end_turned_late": ("end", "speed", "turned_late"), "middle_turned": ("middle", "speed", "turned"), "end_w24": ("end", "w24", "w24"), "end_w48": ("end", "w48", "w48"), "middle_w24": ("middle", "w24", "w24"),
}


@query("labelled_cases", f"""WITH {_SERIES}, {CASES}, asked AS (SELECT k.motion, k.chain, p.n, k.c FROM cases k JOIN peaks p ON p.motion = k.motion AND p.chain = k.chain), {_NEAR},
f AS (SELECT b.motion, b.chain, b.c, {", ".join(f"coalesce(max({v}) FILTER (WHERE role = '{r}' AND body = {r}_{s}_body), 0)::DOUBLE AS {k}" for k, (r, s, v) in _OF.items())}, max(zr) >= 0.12 OR max(zv) >= 1 AS high FROM told b JOIN peaks p ON p.motion = b.motion AND p.chain = b.chain GROUP BY b.motion, b.chain, b.c),
g AS (SELECT *, (end_w48 >= 95 AND end_w24 >= 65 AND middle_w24 >= 30)::INT + (stay >= 80)::INT + (middle_turned >= 25)::INT AS p, (end_v >= 650)::INT + (middle_v >= 350)::INT + (acc >= 30000)::INT + (jerk >= 3000000)::INT + (run >= 3)::INT AS t FROM f)
SELECT g.motion, g.chain, g.c, label, p AS persistent_score, t AS transient_score, high AS high_root_dynamic, round(outlier, 4) AS outlier, round(stay, 3) AS stay, round(end_turned_late, 3) AS end_turned_late, run, middle_run,
 CASE WHEN p = 3 AND NOT high THEN 'hard_persistent' WHEN t >= 4 AND outlier >= 5 AND NOT high THEN 'hard_transient' WHEN high AND (p >= 3 OR t >= 3) THEN 'review_high_root_dynamic' WHEN p >= 3 OR t >= 3 THEN 'review_borderline' ELSE 'clean_or_dynamic' END AS pred
FROM g JOIN cases k ON k.motion = g.motion AND k.chain = g.chain AND k.c = g.c""")
def labelled_cases(spark, sf_dir):
    out = C.labelled_cases(limb_bodies(spark, sf_dir), cases(spark, sf_dir), "motion", FPS)
    digits = {"outlier": 4, "stay": 3, "end_turned_late": 3}
    return out.select("motion", "chain", "c", "label", "persistent_score", "transient_score", "high_root_dynamic", *[F.round(k, d).alias(k) for k, d in digits.items()], "run", "middle_run", "pred")


@query("case_morphology", f"""WITH {_SERIES}, {CASES}, y AS (SELECT *, {_sql_ahead(12)} AS w12 FROM series WINDOW w AS (PARTITION BY motion, chain, role, body ORDER BY i)),
l AS ({" UNION ALL ".join(f"SELECT motion, chain, role, body, i, '{s}' AS series, {s} AS value FROM y WHERE {s} IS NOT NULL" for s in ("speed", "w12", "w24", "w48"))}),
m AS (SELECT motion, chain, role, series, body FROM (SELECT motion, chain, role, series, body, max(value) AS v FROM l GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY motion, chain, role, series ORDER BY v DESC, body) = 1),
r AS (SELECT l.*, k.c FROM l JOIN m USING (motion, chain, role, series, body) JOIN cases k ON k.motion = l.motion AND k.chain = l.chain),
t(role, series, threshold) AS (VALUES {", ".join(f"('{r}', '{s}', {x}::DOUBLE)" for (r, s), xs in C.MORPHOLOGY.items() for x in xs)}), h AS (SELECT r.*, threshold, value >= threshold AS hit FROM r JOIN t USING (role, series)),
u AS (SELECT *, row_number() OVER w - sum(hit::INT) OVER w AS run FROM h WINDOW w AS (PARTITION BY motion, chain, c, role, series, threshold ORDER BY i)), z AS (SELECT motion, chain, c, role, series, threshold, run, count(*) FILTER (WHERE hit) AS k FROM u GROUP BY ALL),
a AS (SELECT motion, chain, c, role, series, body, max(value) AS largest, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, coalesce(max(value) FILTER (WHERE i = c), arg_max(value, i)) AS at_place FROM r GROUP BY ALL)
SELECT a.motion, a.chain, a.role, a.series, threshold, round(largest, 3) AS largest, round(p95, 4) AS p95, round(p99, 4) AS p99, round(at_place, 3) AS at_place, sum(k)::BIGINT AS frames, max(k) AS longest, round(max(k) / 30.0, 6)::DOUBLE AS seconds
FROM a JOIN z USING (motion, chain, c, role, series) GROUP BY ALL""")
def case_morphology(spark, sf_dir):
    out = C.case_morphology(limb_bodies(spark, sf_dir), cases(spark, sf_dir), "motion", FPS)
    return out.select("motion", "chain", "role", "series", "threshold", *[F.round(c, d).alias(c) for c, d in (("largest", 3), ("p95", 4), ("p99", 4), ("at_place", 3))], "frames", "longest", r6(F.col("seconds"), "seconds"))


@query("joint_names", """WITH j AS (SELECT p_partkey AS id, (CASE p_partkey % 3 WHEN 0 THEN 'left_' WHEN 1 THEN 'right_' ELSE '' END) || (CASE p_size % 8 WHEN 0 THEN 'shoulder_pitch' WHEN 1 THEN 'elbow' WHEN 2 THEN 'wrist_yaw' WHEN 3 THEN 'hip_roll'
  WHEN 4 THEN 'knee' WHEN 5 THEN 'ankle_pitch' WHEN 6 THEN 'waist_yaw' ELSE 'finger' END) AS joint FROM part),
s AS (SELECT *, regexp_extract(joint, '^(left|right)', 1) AS lr, regexp_extract(joint, '(ankle|knee|hip|wrist|elbow|shoulder)', 1) AS limb FROM j)
SELECT id, joint, CASE WHEN lr = '' THEN 'center' ELSE lr END AS side,
  CASE WHEN contains(joint, 'waist') THEN 'torso_head' ELSE (CASE WHEN lr = '' THEN 'center' ELSE lr END) || '_' || (CASE WHEN limb = '' THEN 'other' ELSE limb END) END AS side_group,
  CASE WHEN limb IN ('shoulder', 'elbow', 'wrist') THEN 'upper' WHEN limb <> '' THEN 'lower' WHEN contains(joint, 'waist') THEN 'torso_head' ELSE 'other' END AS chain,
  CASE WHEN limb <> '' AND lr <> '' THEN lr || (CASE WHEN limb IN ('shoulder', 'elbow', 'wrist') THEN '_arm' ELSE '_leg' END) WHEN contains(joint, 'waist') THEN 'torso_head' ELSE 'other' END AS limb FROM s""")
def joint_names(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("shoulder_pitch", "elbow", "wrist_yaw", "hip_roll", "knee", "ankle_pitch", "waist_yaw", "finger")))
    sides = F.array(F.lit("left_"), F.lit("right_"), F.lit(""))
    j = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.get(sides, (F.col("p_partkey") % 3).cast("int")), F.get(kinds, F.col("p_size") % 8)).alias("joint"))
    c = F.col("joint")
    return j.select("id", "joint", N.side(c).alias("side"), N.side_group(c).alias("side_group"), N.chain(c).alias("chain"), N.limb(c).alias("limb"))
