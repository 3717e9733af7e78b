"""Queries over joins of intervals and over series that are one whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridelake.functions import rotations as R
from stridelake.operators import intervals as I
from stridelake.operators import scans as N
from stridelake.plans.base import TRACE, WRAP, query, table, trace
from stridelake.plans.series import r6

CLIPS = f"""{TRACE}, clips AS (SELECT motion, frame AS clip, frame - 2 AS a, frame + 3 + CASE WHEN frame % 50 = 0 THEN 400 ELSE frame % 5 END AS b FROM trace WHERE joint = 'click'),
spans AS (SELECT motion, frame AS span, frame AS c, frame + CASE WHEN q < 20 THEN 0 ELSE 1 + floor(q)::BIGINT % 40 END AS d FROM trace WHERE joint = 'purchase')"""


@query("overlapping_spans", f"{CLIPS} SELECT clips.motion, clip, span, least(b, d) - greatest(a, c) AS frames FROM clips JOIN spans ON clips.motion = spans.motion AND a < d AND c < b AND a < b AND c < d".replace(TRACE, f"WITH {TRACE}", 1))
def overlapping_spans(spark, sf_dir):
    """Clips of several lengths, some very long, and spans of events in the same motion: how many frames they share."""
    rows, f = trace(spark, sf_dir), F.col("frame")
    clips = rows.where("joint = 'click'").select("motion", f.alias("clip"), (f - 2).alias("a"), (f + 3 + F.when(f % 50 == 0, 400).otherwise(f % 5)).alias("b"))
    spans = rows.where("joint = 'purchase'").select("motion", f.alias("span"), f.alias("c"), (f + F.when(F.col("q") < 20, 0).otherwise(1 + F.floor("q") % 40)).alias("d"))
    met = I.overlap_join(clips, spans, ["motion"], ("a", "c"), ("b", "d"), 8)
    return met.select("motion", "clip", "span", (F.least("b", "d") - F.greatest("a", "c")).alias("frames"))


WHOLE = "rows AS (SELECT event_id AS i, value AS q, epoch_us(ts) // 1000000 AS t, event_type FROM events)"


def whole(spark, sf_dir):
    """All events as one series."""
    return table(spark, sf_dir, "events").select(F.lit(0).alias("series"), F.col("event_id").alias("i"), F.col("value").alias("q"), "event_type")


@query("unwrap_whole", f"WITH {WHOLE}, s AS (SELECT i, coalesce({WRAP.format('q - lag(q) OVER (ORDER BY i)')}, 0) AS d, first_value(q) OVER (ORDER BY i) AS q0 FROM rows) SELECT i, round(q0 + sum(d) OVER (ORDER BY i), 4) AS u FROM s")
def unwrap_whole(spark, sf_dir):
    """Angles of one series as long as the table, in ranges of 1000 rows."""
    found = N.unwrapped(whole(spark, sf_dir), ["series"], "i", "q", "u", 1000)
    return found.select("i", F.round("u", 4).alias("u"))


@query("clusters_whole", f"WITH {WHOLE}, k AS (SELECT i FROM rows WHERE event_type IN ('error', 'signup')), s AS (SELECT i, coalesce((i - lag(i) OVER (ORDER BY i) > 4)::INT, 0) AS fresh FROM k), c AS (SELECT i, sum(fresh) OVER (ORDER BY i) AS cluster FROM s) SELECT cluster::BIGINT AS cluster, min(i) AS first, count(*) AS n FROM c GROUP BY cluster")
def clusters_whole(spark, sf_dir):
    """Clusters of events no more than four ids apart."""
    rows = whole(spark, sf_dir).where(F.col("event_type").isin("error", "signup"))
    return N.gap_clusters(rows, ["series"], "i", 4, "cluster", 500).groupBy("cluster").agg(F.min("i").alias("first"), F.count("*").alias("n"))


@query("runs_whole", f"WITH {WHOLE}, m AS (SELECT least AS least, i, q >= least AS on_ FROM rows, (VALUES (0), (20), (100)) v(least)), g AS (SELECT least, on_, i, i - row_number() OVER (PARTITION BY least, on_ ORDER BY i) AS island FROM m), r AS (SELECT least, island, count(*) AS n FROM g WHERE on_ GROUP BY ALL) SELECT v.least, coalesce(max(n), 0)::BIGINT AS longest FROM (VALUES (0), (20), (100)) v(least) LEFT JOIN r ON r.least = v.least GROUP BY v.least")
def runs_whole(spark, sf_dir):
    """The longest run of values at or above three limits; of one the run is the table."""
    rows = whole(spark, sf_dir).withColumn("least", F.explode(F.array(F.lit(0), F.lit(20), F.lit(100))))
    return N.longest_runs(rows, ["least"], "i", F.col("q") >= F.col("least"), "longest", 300)


@query("signs_whole", f"WITH e AS (SELECT vec_id AS i, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS w FROM embeddings), d AS (SELECT i, coalesce((x * lag(x) OVER o + y * lag(y) OVER o + z * lag(z) OVER o + w * lag(w) OVER o < 0)::INT, 0) AS f FROM e WINDOW o AS (ORDER BY i)) SELECT i, CASE WHEN sum(f) OVER (ORDER BY i) % 2 = 0 THEN 1 ELSE -1 END AS sign FROM d")
def signs_whole(spark, sf_dir):
    """Signs of all quaternions as one series."""
    q = R.quat(*[F.col("embedding")[i] for i in range(4)])
    rows = table(spark, sf_dir, "embeddings").select(F.lit(0).alias("series"), F.col("vec_id").alias("i"), q.alias("quat"))
    return N.sign_flips(rows, ["series"], "i", "quat", "sign", 64).select("i", "sign")
