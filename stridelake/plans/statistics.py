"""Queries over aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridelake.operators import series as S
from stridelake.operators import stats as A
from stridelake.storage import written
from stridelake.plans.base import TRACE, query, table, trace
from stridelake.plans.series import FPS, WIDE, long_joints, r6

M = ["motion"]


def rounded(df, *same):
    return df.select(*[F.col(c) if c in same or t in ("string", "boolean", "bigint") else r6(F.col(c), c) for c, t in df.dtypes])


@query("finite_stats", """WITH v AS (SELECT l_returnflag AS flag, CASE WHEN l_linenumber = 7 THEN 'NaN'::DOUBLE ELSE l_extendedprice END AS x FROM lineitem), f AS (SELECT flag, CASE WHEN isfinite(x) THEN x END AS x FROM v)
SELECT flag, round(avg(x), 6) AS x_mean, round(stddev_pop(x), 6) AS x_std, max(x) AS x_max, min(x) AS x_min, round(max(x) - min(x), 6) AS x_range, round(quantile_cont(x, 0.05), 6) AS x_p05, round(quantile_cont(x, 0.5), 6) AS x_p50, round(quantile_cont(x, 0.95), 6) AS x_p95 FROM f GROUP BY flag""")
def finite_stats(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(F.col("l_extendedprice")).alias("x"))
    return rounded(A.finite_stats_of(v, ["flag"], "x", "x"))


@query("correlation", """SELECT l_returnflag AS flag, round(coalesce(corr(l_quantity, l_extendedprice), 0), 6) AS r, 0.0::DOUBLE AS constant FROM lineitem GROUP BY ALL""")
def correlation(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"))
    return rounded(v.agg(A.correlation(F.col("l_quantity"), F.col("l_extendedprice")).alias("r"), A.correlation(F.col("l_quantity"), F.lit(3.0)).alias("constant")))


@query("joint_group_stats", f"""WITH {WIDE}, s AS (SELECT motion, joint, max(q) - min(q) AS ptp, stddev_pop(q) AS std, max(q) AS top FROM long GROUP BY ALL),
v AS (SELECT motion, joint, avg(abs(d)) AS speed FROM (SELECT motion, joint, (q - lag(q) OVER (PARTITION BY motion, joint ORDER BY frame)) * 30 AS d FROM long) GROUP BY ALL)
SELECT motion, round(avg(ptp), 6) AS ptp, round(avg(std), 6) AS std, max(top) AS top, round(avg(speed), 6) AS speed FROM s JOIN v USING (motion, joint) GROUP BY motion""")
def joint_group_stats(spark, sf_dir):
    """Per joint first, then over the joints of a group."""
    rows = long_joints(spark, sf_dir)
    moved = rows.withColumn("d", (F.col("q") - F.lag("q").over(S.over(["motion", "joint"]))) * FPS)
    per = moved.groupBy("motion", "joint").agg((F.max("q") - F.min("q")).alias("ptp"), F.stddev_pop("q").alias("std"), F.max("q").alias("top"), F.avg(F.abs("d")).alias("speed"))
    return rounded(per.groupBy("motion").agg(F.avg("ptp").alias("ptp"), F.avg("std").alias("std"), F.max("top").alias("top"), F.avg("speed").alias("speed")))


@query("welford_ci", """SELECT l_returnflag AS flag, l_linestatus AS status, count(l_quantity) AS count, round(avg(l_quantity), 6) AS mean, round(coalesce(var_samp(l_quantity), 0), 6) AS var, min(l_quantity) AS min, max(l_quantity) AS max,
 round(avg(l_quantity) - 1.96 * coalesce(stddev_samp(l_quantity), 0) / sqrt(count(l_quantity)), 6) AS c95_low, round(avg(l_quantity) + 1.96 * coalesce(stddev_samp(l_quantity), 0) / sqrt(count(l_quantity)), 6) AS c95_high,
 round(avg(l_quantity) - 2.576 * coalesce(stddev_samp(l_quantity), 0) / sqrt(count(l_quantity)), 6) AS c99_low, round(avg(l_quantity) + 2.576 * coalesce(stddev_samp(l_quantity), 0) / sqrt(count(l_quantity)), 6) AS c99_high FROM lineitem GROUP BY ALL""")
def welford_ci(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    return rounded(rows.agg(*A.welford(F.col("l_quantity"))))


@query("metric_bank", """WITH l AS (SELECT 'quantity' AS metric, l_quantity AS x FROM lineitem UNION ALL SELECT 'discount', l_discount FROM lineitem UNION ALL SELECT 'tax', l_tax FROM lineitem)
SELECT metric, count(*) AS count, round(avg(x), 6) AS mean, min(x) AS min, max(x) AS max FROM l GROUP BY metric""")
def metric_bank(spark, sf_dir):
    """One accumulator per metric name."""
    wide = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    long = wide.unpivot([], ["quantity", "discount", "tax"], "metric", "x")
    return rounded(long.groupBy("metric").agg(F.count("*").alias("count"), F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max")))


@query("hist_quantiles", """WITH b AS (SELECT l_returnflag AS flag, least(359, floor(greatest(l_quantity, 0) / 0.25))::BIGINT AS bin, count(*) AS c FROM lineitem GROUP BY ALL),
s AS (SELECT *, sum(c) OVER (PARTITION BY flag ORDER BY bin) AS cum, sum(c) OVER (PARTITION BY flag) AS n FROM b)
SELECT flag, max(n)::BIGINT AS n, min(CASE WHEN cum > 0.5 * (n - 1) THEN (bin + 0.5) * 0.25 END)::DOUBLE AS p50, min(CASE WHEN cum > 0.95 * (n - 1) THEN (bin + 0.5) * 0.25 END)::DOUBLE AS p95 FROM s GROUP BY flag""")
def hist_quantiles(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_quantity")
    return A.histogram_quantiles(rows, ["flag"], "l_quantity", 0.25, 360, {"p50": 0.5, "p95": 0.95})


@query("group_scope_stats", """SELECT coalesce(c_mktsegment, 'ALL') AS scope, count(*) AS n, round(avg(c_acctbal), 6) AS mean, max(c_acctbal) AS max FROM customer GROUP BY GROUPING SETS ((), (c_mktsegment))""")
def group_scope_stats(spark, sf_dir):
    """All rows and each category in one pass."""
    rows = table(spark, sf_dir, "customer").groupingSets([[], ["c_mktsegment"]], "c_mktsegment")
    return rounded(rows.agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("mean"), F.max("c_acctbal").alias("max")).withColumnRenamed("c_mktsegment", "scope").fillna("ALL", ["scope"]))


@query("grouped_weighted_stats", """SELECT l_returnflag AS config, l_linestatus AS robot, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS weighted_mean, count(DISTINCT l_suppkey) AS clips,
 round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, max(l_extendedprice) AS max FROM lineitem GROUP BY ALL""")
def grouped_weighted_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_returnflag": "config", "l_linestatus": "robot"})
    found = rows.groupBy("config", "robot").agg(
        F.round(A.weighted_mean(F.col("l_extendedprice"), F.col("l_quantity")), 4).alias("weighted_mean"), F.count_distinct("l_suppkey").alias("clips"), F.max("l_extendedprice").alias("max")
    )
    q = A.exact_quantiles(rows, ["config", "robot"], "l_extendedprice", [0.5, 0.9, 0.95], "q")
    return rounded(found.join(q, ["config", "robot"]).select("*", *[F.col("q")[i].alias(n) for i, n in enumerate(("p50", "p90", "p95"))]).drop("q"))


@query("pivot_status", """SELECT o_orderpriority AS priority, max(CASE WHEN o_orderstatus = 'F' THEN n END) AS F, max(CASE WHEN o_orderstatus = 'O' THEN n END) AS O, max(CASE WHEN o_orderstatus = 'P' THEN n END) AS P
FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_orderpriority""")
def pivot_status(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority"), "o_orderstatus").agg(F.count("*").alias("n"))
    return counts.groupBy("priority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.first("n"))


@query("status_rates", """SELECT o_orderpriority AS priority, count(*) AS n, count(DISTINCT o_custkey) AS customers, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed, round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 6) AS rate FROM orders GROUP BY ALL""")
def status_rates(spark, sf_dir):
    failed = F.count_if(F.col("o_orderstatus") == "F")
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority"))
    return rounded(rows.agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), failed.alias("failed"), (failed / F.count("*")).alias("rate")))


@query("motion_hours", f"""WITH {TRACE}, m AS (SELECT motion, count(*) AS n FROM trace GROUP BY motion) SELECT motion % 10 AS category, count(*) AS motions, round(sum((n - 1) / 30.0) / 3600, 6)::DOUBLE AS hours, round(sum(n / 30.0) / 3600, 6)::DOUBLE AS padded_hours,
 round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.95), 6) AS p95 FROM m GROUP BY 1""")
def motion_hours(spark, sf_dir):
    """Durations by both rules: frames less one, and all frames, over the rate."""
    per = trace(spark, sf_dir).groupBy("motion").agg(F.count("*").alias("n"))
    p = lambda q: F.percentile("n", F.lit(q))
    found = per.groupBy((F.col("motion") % 10).alias("category")).agg(
        F.count("*").alias("motions"), (F.sum((F.col("n") - 1) / FPS) / 3600).alias("hours"), (F.sum(F.col("n") / FPS) / 3600).alias("padded_hours"), p(0.5).alias("p50"), p(0.95).alias("p95")
    )
    return rounded(found)


@query("selection_summary", """SELECT coalesce(n_name, 'ALL') AS subset, count(*) AS motions, count(*) FILTER (WHERE s_acctbal >= 3000) AS selected, round(avg(s_acctbal), 6) AS mean FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ROLLUP (n_name)""")
def selection_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    found = rows.rollup(F.col("n_name").alias("subset")).agg(F.count("*").alias("motions"), F.count_if(F.col("s_acctbal") >= 3000).alias("selected"), F.avg("s_acctbal").alias("mean"))
    return rounded(found.fillna("ALL", ["subset"]))


@query("most_common", "SELECT p_type AS reason, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, reason LIMIT 20")
def most_common(spark, sf_dir):
    """The twenty commonest reasons: a report."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(20)


@query("merged_sketches", "SELECT l_returnflag AS flag, count(*) AS n, true AS within FROM lineitem GROUP BY l_returnflag")
def merged_sketches(spark, sf_dir):
    """Sketches of two runs, stored and merged; the quantiles they give err by a hundredth of the ranks at most, by a count of all rows."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("x"), (F.col("l_orderkey") % 2).alias("run"))
    runs = [written(A.sketches(rows.where(F.col("run") == i), ["flag"], "x")) for i in (0, 1)]
    qs = [0.1, 0.5, 0.9]
    found = A.sketched(A.merged_sketches(runs, ["flag"]), ["flag"], qs, "q")
    below = lambda i, f: F.sum(f(F.col("x"), F.col("q")[i]).cast("long")) / F.first("n")
    near = [(below(i, lambda x, q: x < q) - 0.01 <= q) & (below(i, lambda x, q: x <= q) + 0.01 >= q) for i, q in enumerate(qs)]
    return rows.join(found, "flag").groupBy("flag").agg(F.first("n").alias("n"), (near[0] & near[1] & near[2]).alias("within"))


@query("weighted_quantile", """WITH v AS (SELECT l_returnflag AS flag, l_extendedprice AS x, sum(CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_quantity END) AS w, count(*) AS c FROM lineitem GROUP BY ALL),
s AS (SELECT *, sum(w) OVER (PARTITION BY flag ORDER BY x) AS cum, sum(w) OVER (PARTITION BY flag) AS tot FROM v)
SELECT s.flag, CASE WHEN max(tot) > 0 THEN min(CASE WHEN cum >= 0.95 * tot - 1e-12 THEN x END) ELSE max(p.q) END AS p95 FROM s JOIN (SELECT l_returnflag AS flag, quantile_cont(l_extendedprice, 0.95) AS q FROM lineitem GROUP BY 1) p ON p.flag = s.flag GROUP BY s.flag""")
def weighted_quantile(spark, sf_dir):
    weight = F.when(F.col("l_returnflag") == "N", F.lit(0.0)).otherwise(F.col("l_quantity"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("x"), weight.alias("w"))
    return A.weighted_quantile(rows, ["flag"], "x", "w", 0.95, "p95")


@query("weighted_mean", "SELECT l_shipdate::DATE::VARCHAR AS day, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")
def weighted_mean(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").cast("string").alias("day"))
    return rounded(rows.agg(A.weighted_mean(F.col("l_discount"), F.col("l_quantity")).alias("mean")))


PHYSICS = f"""{TRACE}, j AS (SELECT motion, frame, unnest(['a', 'b']) AS joint, unnest([q, (frame % 9) * 10]) / 100.0 AS q FROM trace),
v AS (SELECT *, coalesce((q - lag(q) OVER w) * 30, 0) AS vel FROM j WINDOW w AS (PARTITION BY motion, joint ORDER BY frame)), c AS (SELECT *, coalesce((vel - lag(vel) OVER w) * 30, 0) AS acc FROM v WINDOW w AS (PARTITION BY motion, joint ORDER BY frame)),
k AS (SELECT *, coalesce((acc - lag(acc) OVER w) * 30, 0) AS jerk FROM c WINDOW w AS (PARTITION BY motion, joint ORDER BY frame)), pf AS (SELECT motion, frame, sqrt(sum(jerk * jerk)) AS norm FROM k GROUP BY ALL),
mv AS (SELECT motion, avg(greatest(0, abs(vel) - radians(3000))) AS velocity_violation, degrees(max(abs(vel))) AS fastest FROM k GROUP BY motion), jk AS (SELECT motion, 0.01 * avg(norm) AS jerk FROM pf GROUP BY motion),
f AS (SELECT motion, frame, (q - 30) / 400 AS bottom, q / 300 AS speed, CASE WHEN joint = 'click' THEN (q - 30) / 500 END AS floor_dist, CASE WHEN joint = 'view' AND q < 60 THEN 1 ELSE 0 END AS touching FROM trace),
g AS (SELECT *, CASE WHEN bottom < 0.05 THEN greatest(0, speed - 0.1) * 5 ELSE 0 END AS slide, coalesce(CASE WHEN floor_dist IS NOT NULL THEN greatest(0, -floor_dist - 0.01) END, 0) AS deep, (coalesce(floor_dist, bottom) > 0.05)::INT AS floats FROM f),
st AS (SELECT motion, count(*) AS num_frames, avg(slide) AS foot_sliding, avg(least(touching, 10)) AS self_collision, avg(deep) AS penetration, min(bottom) AS lowest FROM g GROUP BY motion),
fl AS (SELECT motion, avg(CASE WHEN n >= 30 THEN (held >= 29.9)::INT ELSE floats END) AS floating FROM (SELECT *, sum(floats) OVER (PARTITION BY motion ORDER BY frame ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) AS held, count(*) OVER (PARTITION BY motion) AS n FROM g) GROUP BY motion),
m AS (SELECT *, num_frames < 5 OR num_frames / 30.0 < 0.5 AS short FROM st JOIN mv USING (motion) JOIN jk USING (motion) JOIN fl USING (motion)),
d AS (SELECT *, CASE WHEN short THEN 100 ELSE foot_sliding END + 0.5 * CASE WHEN short THEN 100 ELSE velocity_violation END + 100 * CASE WHEN short THEN 100 ELSE self_collision END + 0.001 * CASE WHEN short THEN 100 ELSE jerk END + 10 * CASE WHEN short THEN 100 ELSE penetration END + 200 * CASE WHEN short THEN 1 ELSE floating END AS total FROM m)"""
#: Weights and limit for the fixture, whose values jump: with the defaults every motion would score 0.
RULES = A.PhysicsRules(speed_limit=3000.0, passing=40.0, weights=(("foot_sliding", 1.0), ("velocity_violation", 0.5), ("self_collision", 100.0), ("jerk", 0.001), ("penetration", 10.0), ("floating_frames_ratio", 200.0)))


def physics(spark, sf_dir):
    rows = trace(spark, sf_dir)
    q = F.col("q")
    joint = lambda n, x: F.struct(F.lit(n).alias("joint"), (x / 100.0).alias("q"))
    joints = rows.select("motion", "frame", F.inline(F.array(joint("a", q), joint("b", (F.col("frame") % 9) * 10))))
    feet = rows.select("motion", "frame", ((q - 30) / 400).alias("bottom"), (q / 300).alias("speed"))
    contacts = rows.where(F.col("joint").isin("click", "view")).select("motion", "frame", (F.col("joint") == "click").alias("floor"), F.when(F.col("joint") == "click", (q - 30) / 500).otherwise((q - 60) / 10).alias("dist"))
    return A.quality_score(A.physics_metrics(joints, feet, contacts, "motion", FPS, RULES), FPS, RULES)


@query("quality_score", f"""WITH {PHYSICS} SELECT motion, num_frames, short AS is_too_short, round(CASE WHEN short THEN 100 ELSE foot_sliding END, 5)::DOUBLE AS foot_sliding, round(CASE WHEN short THEN 100 ELSE velocity_violation END, 5)::DOUBLE AS velocity_violation,
 round(CASE WHEN short THEN 100 ELSE penetration END, 6)::DOUBLE AS penetration, round(CASE WHEN short THEN 1 ELSE floating END, 6)::DOUBLE AS floating, round(CASE WHEN short THEN 100 ELSE jerk END, 3)::DOUBLE AS jerk, round(fastest, 3) AS fastest, round(lowest, 6) AS lowest,
 round(greatest(0, 100 - total), 4)::DOUBLE AS score, NOT short AND greatest(0, 100 - total) >= 40 AS passed FROM d""")
def quality_score(spark, sf_dir):
    """Physics metrics from joints, feet and contacts, deductions, score and verdict."""
    shown = {"foot_sliding": ("foot_sliding", 5), "velocity_violation": ("velocity_violation", 5), "penetration": ("penetration", 6), "floating_frames_ratio": ("floating", 6), "jerk": ("jerk", 3), "max_joint_velocity": ("fastest", 3), "min_foot_bottom": ("lowest", 6), "score": ("score", 4)}
    return physics(spark, sf_dir).select("motion", "num_frames", "is_too_short", "passed", *[F.round(c, d).alias(n) for c, (n, d) in shown.items()])


@query("stage_retention", """WITH b AS (SELECT source AS key, count(*) AS before FROM documents GROUP BY 1), a AS (SELECT source AS key, count(*) AS after FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 1)
SELECT coalesce(b.key, a.key) AS key, coalesce(before, 0) AS before, coalesce(after, 0) AS after, coalesce(before, 0) - coalesce(after, 0) AS dropped, round(coalesce(after, 0) / nullif(before, 0), 6) AS retention FROM b FULL JOIN a ON a.key = b.key""")
def stage_retention(spark, sf_dir):
    """Counts by key before and after a stage, also of keys that one side lacks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("key"))
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    before = docs.groupBy("key").agg(F.count("*").alias("before"))
    after = docs.join(good, "doc_id", "left_semi").groupBy("key").agg(F.count("*").alias("after"))
    both = before.join(after, "key", "full").fillna(0, ["before", "after"])
    return rounded(both.select("key", "before", "after", (F.col("before") - F.col("after")).alias("dropped"), F.try_divide("after", "before").alias("retention")))


_POINTS = {"min": 0.0, "low": 0.01, "p05": 0.05, "p50": 0.5, "p95": 0.95, "high": 0.99, "max": 1.0}
_AFTER = "f = 'R' AND x > 0.01"
RANGES = f"""WITH b AS (SELECT 'quantity' AS feature, l_quantity AS x, l_returnflag AS f FROM lineitem UNION ALL SELECT 'price', l_extendedprice, l_returnflag FROM lineitem UNION ALL SELECT 'discount', l_discount, l_returnflag FROM lineitem),
s AS (SELECT feature, avg(x) AS mean_before, avg(x) FILTER (WHERE {_AFTER}) AS mean_after, {", ".join(f"quantile_cont(x, {q}) AS {n}_before, quantile_cont(x, {q}) FILTER (WHERE {_AFTER}) AS {n}_after" for n, q in _POINTS.items())} FROM b GROUP BY feature),
t AS (SELECT *, (max_after - min_after) / (max_before - min_before) AS retention, (high_after - low_after) / (high_before - low_before) AS robust_retention, (p95_after - p05_after) / (p95_before - p05_before) AS middle_retention, mean_after - mean_before AS mean_delta,
 greatest(0, low_after - low_before) / (high_before - low_before) AS low_loss, greatest(0, high_before - high_after) / (high_before - low_before) AS high_loss FROM s)"""
_RANGE_COLUMNS = [f"{n}_{w}" for w in ("before", "after") for n in ("mean", *_POINTS)] + ["retention", "robust_retention", "middle_retention", "mean_delta", "low_loss", "high_loss"]


@query("range_retention", f"{RANGES} SELECT feature, {', '.join(f'round({c}, 5)::DOUBLE AS {c}' for c in _RANGE_COLUMNS)} FROM t")
def range_retention(spark, sf_dir):
    return ranges(spark, sf_dir).select("feature", *[(F.round(c, 5) + 0.0).alias(c) for c in _RANGE_COLUMNS])


def ranges(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"))
    features = ["quantity", "price", "discount"]
    after = v.where("l_returnflag = 'R'").select(*[F.when(F.col(c) > 0.01, F.col(c)).alias(c) for c in features])
    return A.range_retention(v, after, features)


@query("retention_summary", f"""{RANGES}, r AS (SELECT greatest(retention, 1e-12) AS r FROM t)
SELECT round(exp(avg(ln(r))), 6) AS geomean, round(avg(r), 6) AS mean, round(quantile_cont(r, 0.5), 6) AS median, round(quantile_cont(r, 0.05), 6) AS p05, round(min(r), 6) AS least FROM r""")
def retention_summary(spark, sf_dir):
    return rounded(ranges(spark, sf_dir).agg(*A.retention_summary(F.col("retention"))))


@query("geometric_mean", "SELECT p_brand AS brand, round(pow(10, avg(log10(greatest(p_retailprice, 1e-12)))), 4) AS geomean FROM part GROUP BY p_brand")
def geometric_mean(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand"))
    return rows.agg(F.round(A.geometric_mean(F.col("p_retailprice")), 4).alias("geomean"))
