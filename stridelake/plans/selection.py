"""Queries over scaling, neighbours and selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stridelake.operators import neighbours as K
from stridelake.operators import selection as L
from stridelake.operators import stats as A
from stridelake.plans.base import query, table
from stridelake.plans.series import r6
from stridelake.storage import written

GROUPS = ("gait", "height", "upper", "range")
FEATURES = [f"{GROUPS[i % 4]}__f{i}" for i in range(64)]
WEIGHTS = K.group_weights(FEATURES, {"gait": 0.4, "height": 0.3, "upper": 0.2, "range": 0.1})


def features(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("category"), *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(FEATURES)])


def scaled(spark, sf_dir):
    return K.robust_scaled(features(spark, sf_dir), FEATURES)


SCALED = f"""long AS (SELECT vec_id AS id, label AS category, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
q AS (SELECT i, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM long GROUP BY i),
s AS (SELECT id, category, long.i, CASE WHEN hi - lo > 1e-12 THEN least(1, greatest(0, (x - lo) / (hi - lo))) ELSE 0.5 END AS x, ([0.4, 0.3, 0.2, 0.1])[(long.i % 4) + 1]::DOUBLE / 16 AS w FROM long JOIN q ON q.i = long.i)"""
NEAREST = f"""{SCALED}, d AS (SELECT a.id, b.id AS neighbor, sum(abs(a.x - b.x) * a.w) AS distance FROM s a JOIN s b ON a.i = b.i AND a.id <> b.id GROUP BY ALL),
knn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(distance, 12), neighbor)::INTEGER AS rank FROM d QUALIFY rank <= 5)"""


def knn(spark, sf_dir):
    return written(K.nearest(scaled(spark, sf_dir), "id", FEATURES, WEIGHTS, 5))


@query("robust_normalize", f"WITH {SCALED} SELECT id, i::BIGINT AS i, round(x, 6) AS x FROM s")
def robust_normalize(spark, sf_dir):
    wide = scaled(spark, sf_dir).select("id", F.posexplode(F.array(*FEATURES)).alias("i", "x"))
    return wide.select("id", F.col("i").cast("long").alias("i"), r6(F.col("x"), "x"))


@query("knn_l1", f"WITH {NEAREST} SELECT id, rank, neighbor, round(distance, 6) AS distance FROM knn")
def knn_l1(spark, sf_dir):
    return knn(spark, sf_dir).select("id", "rank", "neighbor", r6(F.col("distance"), "distance"))


@query("knn_group_breakdown", f"""WITH {NEAREST} SELECT k.id, k.neighbor, {", ".join(f"round(sum(abs(a.x - b.x) * a.w) FILTER (WHERE a.i % 4 = {i}), 6) AS group_weighted_{g}" for i, g in enumerate(GROUPS))}
FROM knn k JOIN s a ON a.id = k.id JOIN s b ON b.id = k.neighbor AND b.i = a.i GROUP BY ALL""")
def knn_group_breakdown(spark, sf_dir):
    rows = written(scaled(spark, sf_dir))  # searched and joined twice
    out = K.group_breakdown(written(K.nearest(rows, "id", FEATURES, WEIGHTS, 5)), rows, "id", FEATURES, WEIGHTS)
    return out.select("id", "neighbor", *[r6(F.col(f"group_weighted_{g}"), f"group_weighted_{g}") for g in GROUPS])


@query("nn_summary", f"""WITH {NEAREST}, r AS (SELECT k.distance, e.label AS category FROM knn k JOIN embeddings e ON e.vec_id = k.id WHERE rank = 1)
SELECT category, count(*) AS n, round(quantile_cont(distance, 0.05), 6) AS p05, round(quantile_cont(distance, 0.5), 6) AS p50, round(quantile_cont(distance, 0.95), 6) AS p95, round(avg(distance), 6) AS mean FROM r GROUP BY category""")
def nn_summary(spark, sf_dir):
    first = knn(spark, sf_dir).where("rank = 1").join(features(spark, sf_dir).select("id", "category"), "id")
    p = lambda q: F.percentile("distance", F.lit(q))
    return first.groupBy("category").agg(F.count("*").alias("n"), r6(p(0.05), "p05"), r6(p(0.5), "p50"), r6(p(0.95), "p95"), r6(F.avg("distance"), "mean"))


@query("redundant_pairs", f"""WITH {NEAREST}, r AS (SELECT * FROM knn WHERE rank = 1), cut AS (SELECT quantile_cont(distance, 0.05) AS most FROM r)
SELECT least(id, neighbor) AS lo, greatest(id, neighbor) AS hi, round(min(distance), 6) AS distance FROM r, cut WHERE distance <= most GROUP BY ALL""")
def redundant_pairs(spark, sf_dir):
    """Nearest pairs within the lowest twentieth of nearest distances, each once."""
    first = knn(spark, sf_dir).where("rank = 1")
    limit = A.exact_quantiles(first, [], "distance", [0.05], "q").select(F.col("q")[0].alias("q")).withColumn("one", F.lit(1))
    near = first.withColumn("one", F.lit(1)).join(F.broadcast(limit), "one").where("distance <= q")
    return near.groupBy(F.least("id", "neighbor").alias("lo"), F.greatest("id", "neighbor").alias("hi")).agg(r6(F.min("distance"), "distance"))


@query("isolated", f"WITH {NEAREST} SELECT id, round(distance, 6) AS distance FROM knn WHERE rank = 1 ORDER BY round(distance, 12) DESC, id LIMIT 20")
def isolated(spark, sf_dir):
    """The twenty motions farthest from any other: a report."""
    return knn(spark, sf_dir).where("rank = 1").orderBy(F.desc(F.round("distance", 12)), "id").limit(20).select("id", r6(F.col("distance"), "distance"))


SELECT_ROWS = """r AS (SELECT 'sub' || (p_partkey % 5) AS subset, p_type || '/' || (p_partkey % 700) AS relative_path, CASE WHEN p_partkey % 11 = 0 THEN 'abc' WHEN p_partkey % 13 = 0 THEN '' ELSE (p_size * 2)::VARCHAR END AS score, p_brand AS score_csv, p_partkey AS row FROM part),
t AS (SELECT *, CASE subset WHEN 'sub1' THEN 50.0 WHEN 'sub2' THEN 20.0 ELSE 90.0 END AS threshold, coalesce(try_cast(score AS DOUBLE), '-inf'::DOUBLE) AS num FROM r),
n AS (SELECT *, num >= threshold AS ok, row_number() OVER (PARTITION BY relative_path, num >= threshold ORDER BY score_csv, row) AS n FROM t),
decided AS (SELECT row, subset, threshold::DOUBLE AS threshold, CASE WHEN NOT ok THEN 'score_below_threshold' WHEN n > 1 THEN 'duplicate_relative_path' WHEN NOT contains(relative_path, 'O') THEN 'missing_source' ELSE '' END AS reason FROM n)"""


def decisions(spark, sf_dir):
    c = F.col
    score = F.when(c("p_partkey") % 11 == 0, "abc").when(c("p_partkey") % 13 == 0, "").otherwise((c("p_size") * 2).cast("string"))
    rows = table(spark, sf_dir, "part").select(
        F.concat(F.lit("sub"), c("p_partkey") % 5).alias("subset"), F.concat_ws("/", "p_type", (c("p_partkey") % 700).cast("string")).alias("relative_path"),
        score.alias("score"), c("p_brand").alias("score_csv"), c("p_partkey").alias("row"),
    )
    thresholds = spark.createDataFrame([("sub1", 50.0), ("sub2", 20.0)], "subset string, threshold double")
    return L.threshold_select(rows, thresholds, rows.where(F.contains("relative_path", F.lit("O"))), 90.0)


@query("gqs_select", f"""WITH {SELECT_ROWS} SELECT row, subset, threshold, reason, CASE reason WHEN '' THEN 'selected' WHEN 'missing_source' THEN 'missing' ELSE 'rejected' END AS decision FROM decided""")
def gqs_select(spark, sf_dir):
    return decisions(spark, sf_dir).select("row", "subset", "threshold", "reason", "decision")


@query("density_priority", f"""WITH {NEAREST}, r AS (SELECT id, neighbor, distance FROM knn WHERE rank = 1), p AS (SELECT quantile_cont(distance, 0.2) AS p20, quantile_cont(distance, 0.5) AS p50, min(distance) AS lo FROM r),
c AS (SELECT id, (row_number() OVER (ORDER BY id % 17, id) - 1) / (count(*) OVER () - 1)::DOUBLE AS rank01 FROM r),
x AS (SELECT r.id, distance, p50, lo, rank01, CASE WHEN (id + neighbor) % 2 = 0 AND distance <= p20 THEN 'mirror_dense_pair' WHEN id % 3 = 0 AND distance <= p50 THEN 'low_dynamic_dense_family' WHEN distance <= p50 THEN 'general_dense_neighbor' ELSE 'fallback_low_priority' END AS reason FROM r JOIN c USING (id), p)
SELECT id, reason, round(CASE reason WHEN 'mirror_dense_pair' THEN 5 WHEN 'low_dynamic_dense_family' THEN 3 WHEN 'general_dense_neighbor' THEN 1.5 ELSE 0 END + 2 * greatest(0, least(1, (p50 - distance) / greatest(p50 - lo, 1e-9))) + 1.25 * (1 - rank01) + 0.5 * (1 - (id % 10) / 10.0), 5)::DOUBLE AS priority FROM x""")
def density_priority(spark, sf_dir):
    return priorities(knn(spark, sf_dir)).select("id", "reason", F.round("priority", 5).alias("priority"))


def priorities(near):
    """Why and how early each row of ``near``, the edges to its nearest, would be removed."""
    from stridelake.operators.series import rank01

    first = near.where("rank = 1").select("id", "neighbor", "distance")
    cuts = A.exact_quantiles(first, [], "distance", [0.2, 0.5, 0.0], "q")
    limits = cuts.select(*[F.col("q")[i].alias(n) for i, n in enumerate(("p20", "p50", "lo"))], F.lit(1).alias("one"))
    ranked = rank01(first.withColumn("m", F.col("id") % 17), [F.col("m"), F.col("id")]).withColumn("one", F.lit(1)).join(F.broadcast(limits), "one")
    c = F.col
    reason = L.removal_reason(c("distance"), c("p20"), c("p50"), (c("id") + c("neighbor")) % 2 == 0, c("id") % 3 == 0)
    return ranked.withColumn("reason", reason).withColumn("priority", L.density_priority(c("reason"), c("distance"), c("p50"), c("lo"), c("rank01"), (c("id") % 10) / 10.0))


@query("density_select")
def density_select(spark, sf_dir):
    """Two thirds of all motions stay. Sequential by its definition: tested against a plain version."""
    side = F.element_at(F.array(F.lit("left"), F.lit("right"), F.lit("balanced")), (F.col("id") % 3 + 1).cast("int"))
    near = knn(spark, sf_dir)
    nodes = written(priorities(near)).select("id", "priority", side.alias("side"), (F.col("id") % 5 != 0).alias("removable"))
    edges = near.select(F.col("id").alias("a"), F.col("neighbor").alias("b"), "distance", "rank")
    return L.density_select(nodes, edges, nodes.count() * 2 // 3)


@query("argmax_per_group", "SELECT l_suppkey, l_extendedprice AS best FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey) AS r FROM lineitem) WHERE r = 1")
def argmax_per_group(spark, sf_dir):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey")
    return table(spark, sf_dir, "lineitem").withColumn("r", F.row_number().over(w)).where("r = 1").select("l_suppkey", F.col("l_extendedprice").alias("best"))


@query("best_few", "SELECT l_suppkey, l_orderkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_partkey, l_linenumber) AS r FROM lineitem) WHERE r <= 3")
def best_few(spark, sf_dir):
    """The three best rows of each group."""
    w = Window.partitionBy("l_suppkey").orderBy("l_extendedprice", "l_orderkey", "l_partkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").withColumn("r", F.row_number().over(w)).where("r <= 3").select("l_suppkey", "l_orderkey", "l_extendedprice")
