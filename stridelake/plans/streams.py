"""Streaming queries, run to the end of what is there; their results equal batch SQL over closed windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridelake.plans.base import WRAP, query, table
from stridelake.storage import shared_dir
from stridelake.streaming import online as O
from stridelake.streaming import stateful as W

LAST = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


def micros(c):
    return F.unix_micros(c)


@query("stream_tumbling", f"""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL)
SELECT epoch_us(s) AS start, event_type, n, total FROM w WHERE s + INTERVAL 1 HOUR <= {LAST}""")
def stream_tumbling(spark, sf_dir):
    found = O.run_to_end(O.tumbling(O.event_stream(spark, sf_dir), "1 hour", "10 minutes"))
    return found.select(micros("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_sliding", f"""WITH e AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k AS s, value FROM events, range(0, 2) r(k)), w AS (SELECT s, count(*) AS n, max(value) AS largest FROM e GROUP BY s)
SELECT epoch_us(s) AS start, n, largest FROM w WHERE s + INTERVAL 1 HOUR <= {LAST}""")
def stream_sliding(spark, sf_dir):
    found = O.run_to_end(O.sliding(O.event_stream(spark, sf_dir), "1 hour", "30 minutes", "10 minutes"))
    return found.select(micros("start").alias("start"), "n", "largest")


@query("stream_session", f"""WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m), x AS (SELECT user_id, s, min(ts) AS a, max(ts) + INTERVAL 30 MINUTE AS b, count(*) AS n FROM g GROUP BY user_id, s)
SELECT user_id, epoch_us(a) AS start, epoch_us(b) AS "end", n FROM x WHERE b <= {LAST}""")
def stream_session(spark, sf_dir):
    found = O.run_to_end(O.sessions(O.event_stream(spark, sf_dir), "30 minutes", "10 minutes"))
    return found.select("user_id", micros("start").alias("start"), micros("end").alias("end"), "n")


MIDDLE = "(SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)"


def deliveries(spark, sf_dir) -> str:
    """Three files, a batch each: the first half of all events, each delivered twice, then the others, then every tenth of the first half once more, most of them too late."""
    e = table(spark, sf_dir, "events")
    ends = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    middle = F.lit(ends["a"] + (ends["b"] - ends["a"]) / 2).cast("timestamp_ntz")
    early, folder = e.where(F.col("ts") <= middle), shared_dir(spark)
    early.unionByName(early).coalesce(1).write.parquet(folder)
    for batch in (e.where(F.col("ts") > middle), early.where("event_id % 10 = 0")):
        batch.coalesce(1).write.mode("append").parquet(folder)
    return folder


@query("stream_late", f"""WITH m AS (SELECT max(ts) AS seen FROM events WHERE ts <= {MIDDLE}), b AS (SELECT ts, value, 2 AS times FROM events WHERE ts <= {MIDDLE} UNION ALL SELECT ts, value, 1 FROM events WHERE ts > {MIDDLE}
  UNION ALL SELECT ts, value, 1 FROM events, m WHERE ts <= {MIDDLE} AND event_id % 10 = 0 AND time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR > seen - INTERVAL 10 MINUTE),
w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, sum(times)::BIGINT AS n FROM b GROUP BY s) SELECT epoch_us(s) AS start, n FROM w WHERE s + INTERVAL 1 HOUR <= {LAST}""")
def stream_late(spark, sf_dir):
    """Rows of windows that the watermark of the batch before had passed are dropped, those of open windows count."""
    rows = O.event_stream(spark, deliveries(spark, sf_dir), "*.parquet", per_batch=1)
    return O.run_to_end(O.counts(rows, "1 hour", "10 minutes")).select(micros("start").alias("start"), "n")


@query("stream_dedup", "SELECT event_id, user_id FROM events")
def stream_dedup(spark, sf_dir):
    """Half of the events are delivered twice, some of them a third time in another batch."""
    rows = O.event_stream(spark, deliveries(spark, sf_dir), "*.parquet", per_batch=1)
    return O.run_to_end(O.first_per_key(rows, ["event_id"], "10 minutes").select("event_id", "user_id"))


def shuffled_deliveries(spark, sf_dir) -> str:
    """Three batches: up to the middle of the time, but for every seventh event of the last five minutes before it; these and a part of the rest; the rest."""
    e = table(spark, sf_dir, "events")
    ends = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    middle, later = (F.lit(ends["a"] + (ends["b"] - ends["a"]) * k).cast("timestamp_ntz") for k in (0.5, 0.8))
    held = (F.col("event_id") % 7 == 0) & (F.col("ts") > middle - F.expr("interval 5 minutes"))
    first, third = (F.col("ts") <= middle) & ~held, F.col("ts") > later
    folder = shared_dir(spark)
    e.where(first).coalesce(1).write.parquet(folder)
    e.where(~first & ~third).coalesce(1).write.mode("append").parquet(folder)
    e.where(third).coalesce(1).write.mode("append").parquet(folder)
    return folder


@query("stream_clusters", f"""WITH m AS (SELECT *, ts - lag(ts) OVER w > INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL AS fresh, {WRAP.format("value - lag(value) OVER w")} AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS c FROM m)
SELECT user_id AS key, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS last, count(*) AS n, round(coalesce(sum(step) FILTER (WHERE NOT fresh), 0), 4) + 0.0 AS turned, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM g GROUP BY user_id, c HAVING max(ts) + INTERVAL 30 MINUTE < {LAST}""")
def stream_clusters(spark, sf_dir):
    """Gap clusters of users with steps and moments of their values, from late and unordered deliveries, closed by the watermark."""
    rows = O.event_stream(spark, shuffled_deliveries(spark, sf_dir), "*.parquet", per_batch=1)
    found = O.run_to_end(W.online_clusters(rows, "user_id", "ts", "event_id", "value", "10 minutes", 1800))
    return found.select("key", "start", "last", "n", *[(F.round(c, 4) + 0.0).alias(c) for c in ("turned", "mean", "std")])


SETTLED = "(SELECT least(max(ts) FILTER (WHERE event_type = 'click'), max(ts) FILTER (WHERE event_type = 'purchase')) - INTERVAL 60 MINUTE FROM events)"


@query("stream_following", f"""WITH c AS (SELECT event_id AS click, user_id, ts FROM events WHERE event_type = 'click'), p AS (SELECT event_id AS purchase, user_id, ts FROM events WHERE event_type = 'purchase')
SELECT click, c.user_id, purchase FROM c LEFT JOIN p ON p.user_id = c.user_id AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 20 MINUTE WHERE c.ts < {SETTLED}""")
def stream_following(spark, sf_dir):
    """Two streams: clicks with the purchases of the user within 20 minutes, null where none came; clicks of the last hour before the end of either stream are left out."""
    folder = shuffled_deliveries(spark, sf_dir)
    rows = lambda kind: O.event_stream(spark, folder, "*.parquet", per_batch=1).where(F.col("event_type") == kind)
    clicks = rows("click").select(F.col("event_id").alias("click"), "user_id", F.col("ts").alias("clicked"))
    purchases = rows("purchase").select(F.col("event_id").alias("purchase"), "user_id", F.col("ts").alias("bought"))
    found = O.run_to_end(W.following(clicks, purchases, "user_id", ("clicked", "bought"), "10 minutes", "20 minutes", outer=True))
    end = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts"))).cast("timestamp")
    last = table(spark, sf_dir, "events").agg((F.least(end("click"), end("purchase")) - F.expr("interval 60 minutes")).alias("settled"))
    return found.join(F.broadcast(last), F.col("clicked") < F.col("settled")).select("click", "user_id", "purchase")


@query("stream_reports", "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, min(value) AS least, max(value) AS most, count(*) FILTER (WHERE value > 100) AS large FROM events GROUP BY event_type")
def stream_reports(spark, sf_dir):
    """Two report tables in three batches, one of moments, which are merged, one of large values."""
    reports = W.Reports(spark, shared_dir(spark), {"moments": lambda rows: W.moment_state(rows, ["event_type"], "value"), "large": lambda rows: rows.where("value > 100").select("event_type", "event_id")})
    reports.run(O.event_stream(spark, shuffled_deliveries(spark, sf_dir), "*.parquet", per_batch=1))
    large = reports.table("large").groupBy("event_type").agg(F.count("*").alias("large"))
    found = W.merged_moments(reports.table("moments"), ["event_type"]).join(large, "event_type", "left")
    return found.select("event_type", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "least", "most", F.coalesce("large", F.lit(0)).alias("large"))
