"""Queries over joins, set operations, sampling and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridelake.functions import rotations as R
from stridelake.operators import relations as J
from stridelake.plans.base import query, table
from stridelake.plans.series import r6


@query("pair_match", """WITH l AS (SELECT l_orderkey AS key, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) AS r FROM lineitem)
SELECT l.key, l_partkey, l_extendedprice, o_custkey FROM l JOIN orders ON o_orderkey = key WHERE r = 1""")
def pair_match(spark, sf_dir):
    left = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_partkey", "l_extendedprice", "l_suppkey")
    right = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey")
    return J.pair_best(left, right, "key", [-F.col("l_extendedprice"), F.col("l_partkey"), F.col("l_suppkey")], [F.col("o_custkey")]).drop("l_suppkey")


@query("semi_required", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_required(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return J.split_by(table(spark, sf_dir, "orders"), wanted, ["o_custkey"])[0].select("o_orderkey", "o_orderstatus")


@query("first_unreviewed", "SELECT coalesce(min(doc_id), 0) AS first FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def first_unreviewed(spark, sf_dir):
    _, rest = J.split_by(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), ["doc_id"])
    return rest.agg(F.coalesce(F.min("doc_id"), F.lit(0)).alias("first"))


@query("score_left_join", "SELECT d.doc_id, d.source, coalesce(l.quality::VARCHAR, '') AS score FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def score_left_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    scores = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(scores, "doc_id", "left").select("doc_id", "source", F.coalesce(F.col("quality").cast("string"), F.lit("")).alias("score"))


@query("events_per_motion", "SELECT c_custkey AS motion, count(o_orderkey) AS events, array_to_string(list_sort(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderpriority IS NOT NULL)), ';') AS kinds FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def events_per_motion(spark, sf_dir):
    """Motions without events have an empty list."""
    motions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("motion"))
    events = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("motion"), "o_orderkey", "o_orderpriority")
    found = motions.join(events, "motion", "left").groupBy("motion").agg(F.count("o_orderkey").alias("events"), F.array_sort(F.collect_set("o_orderpriority")).alias("k"))
    return found.select("motion", "events", F.when(F.size("k") > 0, F.array_join("k", ";")).alias("kinds"))


@query("postcheck_status", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing_postcheck' WHEN l.quality = 1 THEN 'accepted' ELSE 'rejected' END AS status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def postcheck_status(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    checks = table(spark, sf_dir, "labels").select("doc_id", "quality")
    status = F.when(F.col("quality").isNull(), "missing_postcheck").when(F.col("quality") == 1, "accepted").otherwise("rejected")
    return docs.join(checks, "doc_id", "left").select("doc_id", status.alias("status"))


@query("config_delta", """WITH m AS (SELECT l_suppkey AS clip, avg(l_discount) FILTER (WHERE l_returnflag = 'A') AS a, avg(l_discount) FILTER (WHERE l_returnflag = 'R') AS b FROM lineitem GROUP BY 1)
SELECT clip, round(b - a, 6) AS delta, round(CASE WHEN abs(a) > 1e-12 THEN (b - a) / a * 100 END, 4) AS delta_pct FROM m WHERE a IS NOT NULL AND b IS NOT NULL""")
def config_delta(spark, sf_dir):
    """Two configurations of each clip side by side, by one conditional aggregation in place of a self join."""
    mean = lambda flag: F.avg(F.when(F.col("l_returnflag") == flag, F.col("l_discount")))
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("clip")).agg(mean("A").alias("a"), mean("R").alias("b"))
    both = m.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    pct = F.when(F.abs("a") > 1e-12, (F.col("b") - F.col("a")) / F.col("a") * 100)
    return both.select("clip", r6(F.col("b") - F.col("a"), "delta"), F.round(pct, 4).alias("delta_pct"))


@query("edge_endpoints", """WITH e AS (SELECT l_suppkey AS a, l_partkey % 50 AS b, l_quantity AS d FROM lineitem), k AS (SELECT e.* FROM e JOIN supplier x ON x.s_suppkey = a JOIN supplier y ON y.s_suppkey = b WHERE a <> b)
SELECT least(a, b) AS lo, greatest(a, b) AS hi, min(d) AS d FROM k GROUP BY ALL""")
def edge_endpoints(spark, sf_dir):
    """Edges with two known ends, one row per undirected pair, the shortest kept."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 50).alias("b"), F.col("l_quantity").alias("d"))
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    for end in "ab":
        edges = edges.join(known.withColumnRenamed("k", end), end, "left_semi")
    return J.undirected(edges, "a", "b", [F.col("d")])


@query("schema_equality", "SELECT n_nationkey::BIGINT AS joint, n_name AS source, n_regionkey::BIGINT AS target FROM nation")
def schema_equality(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("joint", F.col("n_nationkey").cast("long"))
    return J.require_same_keys(n.select("joint", F.col("n_name").alias("source")), n.select("joint", F.col("n_regionkey").cast("long").alias("target")), "joint")


@query("pose_observations", "SELECT r_name AS pose, n_name AS joint, (n_nationkey * 10 + r_regionkey)::BIGINT AS value FROM region CROSS JOIN nation WHERE n_regionkey <> 2")
def pose_observations(spark, sf_dir):
    """Every pose with every mapped joint: the small joint map travels as one array, so there is no join over pairs."""
    joints = table(spark, sf_dir, "nation").where("n_regionkey <> 2").select(F.struct("n_nationkey", "n_name").alias("j"))
    held = joints.agg(F.collect_list("j").alias("js"))
    poses = table(spark, sf_dir, "region").withColumn("one", F.lit(1)).join(F.broadcast(held.withColumn("one", F.lit(1))), "one")
    out = poses.select("r_name", "r_regionkey", F.explode("js").alias("j"))
    return out.select(F.col("r_name").alias("pose"), F.col("j.n_name").alias("joint"), (F.col("j.n_nationkey") * 10 + F.col("r_regionkey")).cast("long").alias("value"))


@query("conform_skeleton", """WITH f AS (SELECT DISTINCT l_returnflag AS motion FROM lineitem), q AS (SELECT l_returnflag AS motion, l_linenumber AS joint, max(l_quantity) AS q FROM lineitem WHERE l_linenumber <> 3 GROUP BY ALL)
SELECT f.motion, s.joint::INTEGER AS joint, coalesce(q.q, s.joint * 1.5)::DOUBLE AS q FROM f CROSS JOIN range(1, 9) s(joint) LEFT JOIN q ON q.motion = f.motion AND q.joint = s.joint""")
def conform_skeleton(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber <> 3").groupBy(F.col("l_returnflag").alias("motion"), F.col("l_linenumber").alias("joint")).agg(F.max("l_quantity").alias("q"))
    skeleton = spark.range(1, 9).select(F.col("id").cast("int").alias("joint"), (F.col("id") * 1.5).alias("ref"))
    return J.conformed(rows, skeleton, ["motion"])


TREE = "parents AS (SELECT n_nationkey::BIGINT AS joint, CASE WHEN n_nationkey = 0 THEN -1 ELSE (n_nationkey - 1) // 2 END::BIGINT AS parent FROM nation)"


def tree(spark, sf_dir):
    k = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(k.alias("joint"), F.when(k == 0, F.lit(-1)).otherwise(F.floor((k - 1) / 2)).cast("long").alias("parent"))


def poses(spark, sf_dir):
    turn = R.axis_angle("z", F.when(F.col("joint") % 2 == 0, F.lit(90.0)).otherwise(F.lit(-90.0)))
    place = R.vec(F.col("joint") + 1.0, F.lit(0.5), F.col("joint") * 0.1)
    return tree(spark, sf_dir).select(F.lit(0).alias("frame"), "joint", R.transform(place, turn).alias("t"))


@query("global_pose", f"""WITH RECURSIVE {TREE}, local AS (SELECT joint, parent, joint + 1.0 AS x, 0.5 AS y, joint * 0.1 AS z, CASE WHEN joint % 2 = 0 THEN 90 ELSE -90 END AS turn FROM parents),
g AS (SELECT joint, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z, turn::DOUBLE AS turn FROM local WHERE parent < 0
  UNION ALL SELECT l.joint, g.x + cos(radians(g.turn)) * l.x - sin(radians(g.turn)) * l.y, g.y + sin(radians(g.turn)) * l.x + cos(radians(g.turn)) * l.y, g.z + l.z, g.turn + l.turn FROM local l JOIN g ON l.parent = g.joint)
SELECT joint, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM g""")
def global_pose(spark, sf_dir):
    found = J.global_poses(poses(spark, sf_dir), tree(spark, sf_dir), ["frame"], 5)
    return found.select("joint", *[(F.round(F.col(f"t.p.{a}"), 6) + 0.0).alias(a) for a in "xyz"])


@query("local_pose", f"WITH {TREE} SELECT joint, round(joint + 1.0, 5)::DOUBLE AS x, 0.5::DOUBLE AS y FROM parents")
def local_pose(spark, sf_dir):
    """Poses in space back to relative ones."""
    whole = J.global_poses(poses(spark, sf_dir), tree(spark, sf_dir), ["frame"], 5)
    found = J.local_poses(whole, tree(spark, sf_dir), ["frame"])
    return found.select("joint", F.round("t.p.x", 5).alias("x"), F.round("t.p.y", 5).alias("y"))


@query("descendants", f"WITH RECURSIVE {TREE}, d AS (SELECT joint, 0 AS depth FROM parents WHERE joint = 2 UNION ALL SELECT p.joint, depth + 1 FROM parents p JOIN d ON p.parent = d.joint) SELECT joint, depth FROM d")
def descendants(spark, sf_dir):
    return spark.sql("WITH RECURSIVE d AS (SELECT joint, 0 AS depth FROM {tree} WHERE joint = 2 UNION ALL SELECT p.joint, depth + 1 FROM {tree} p JOIN d ON p.parent = d.joint) SELECT joint, depth FROM d", tree=tree(spark, sf_dir))


@query("joint_paths", f"WITH RECURSIVE {TREE}, d AS (SELECT joint, 'j' || joint AS path FROM parents WHERE parent < 0 UNION ALL SELECT p.joint, d.path || '/j' || p.joint FROM parents p JOIN d ON p.parent = d.joint) SELECT joint, path FROM d")
def joint_paths(spark, sf_dir):
    return spark.sql("WITH RECURSIVE d AS (SELECT joint, concat('j', joint) AS path FROM {tree} WHERE parent < 0 UNION ALL SELECT p.joint, concat(d.path, '/j', p.joint) FROM {tree} p JOIN d ON p.parent = d.joint) SELECT joint, path FROM d", tree=tree(spark, sf_dir))


@query("episode_tasks", "SELECT o_orderkey AS episode, c_mktsegment AS task, n_name AS place FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def episode_tasks(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey, "left").join(n, F.col("c_nationkey") == n.n_nationkey, "left")
    return joined.select(F.col("o_orderkey").alias("episode"), F.col("c_mktsegment").alias("task"), F.col("n_name").alias("place"))


@query("body_indices", "SELECT s_suppkey AS joint, n_name AS body FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name NOT IN (SELECT n_name FROM nation WHERE n_regionkey = 1)")
def body_indices(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    mapped = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == n.n_nationkey)
    return mapped.join(n.where("n_regionkey = 1").select("n_name"), "n_name", "left_anti").select(F.col("s_suppkey").alias("joint"), F.col("n_name").alias("body"))


@query("resume_split", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'existing' ELSE 'missing' END AS state FROM documents")
def resume_split(spark, sf_dir):
    existing, missing = J.split_by(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), ["doc_id"])
    return existing.withColumn("state", F.lit("existing")).unionByName(missing.withColumn("state", F.lit("missing")))


@query("key_union", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer")
def key_union(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return J.key_union([s, c])


@query("key_difference", "(SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier) UNION ALL (SELECT r_regionkey + 100 FROM region INTERSECT SELECT n_regionkey + 100 FROM nation)")
def key_difference(spark, sf_dir):
    n, s, r = (table(spark, sf_dir, t) for t in ("nation", "supplier", "region"))
    lost = n.select("n_nationkey").exceptAll(s.select("s_nationkey").distinct())
    both = r.select((F.col("r_regionkey") + 100).alias("n_nationkey")).intersect(n.select(F.col("n_regionkey") + 100))
    return lost.unionByName(both)


@query("dedupe_first", "SELECT l_orderkey AS motion, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1")
def dedupe_first(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("motion"), "l_linenumber", "l_partkey", "l_suppkey")
    return J.best_row(rows, ["motion", "l_linenumber"], [F.col("l_partkey"), F.col("l_suppkey")])


@query("latest_label", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS r FROM conversations) WHERE r = 1")
def latest_label(spark, sf_dir):
    return J.latest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], [F.col("turn"), F.col("role")])


@query("seeded_sample", "SELECT page_id, url FROM pages ORDER BY md5(url || ':7'), page_id LIMIT 25")
def seeded_sample(spark, sf_dir):
    """A sample by hash order: the same at any partitioning (25 rows by its definition)."""
    return table(spark, sf_dir, "pages").select("page_id", "url").orderBy(F.md5(F.concat("url", F.lit(":7"))), "page_id").limit(25)


@query("top_events", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 30")
def top_events(spark, sf_dir):
    """The thirty largest steps: a report."""
    return table(spark, sf_dir, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(30)


@query("frame_by_index", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS f, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id FROM n WHERE f = n - 2""")
def frame_by_index(spark, sf_dir):
    """One frame of each motion; negative indices count from the end (here -2)."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    rows = table(spark, sf_dir, "events").withColumns({"f": F.row_number().over(w.orderBy("ts", "event_id")) - 1, "n": F.count("*").over(w)})
    return rows.where(F.col("f") == F.col("n") + F.lit(-2)).select("user_id", "event_id")


@query("joint_permutation", "SELECT vec_id, list_transform([4, 1, 3, 2, 8], lambda i: round(degrees(embedding[i]::DOUBLE), 6)) AS q FROM embeddings")
def joint_permutation(spark, sf_dir):
    """Joints reordered by an index list, radians to degrees."""
    order = F.array(*map(F.lit, (4, 1, 3, 2, 8)))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(order, lambda i: F.round(F.degrees(F.element_at("embedding", i).cast("double")), 6)).alias("q"))


@query("union_of_runs", "SELECT 'a' AS run, r_name AS name, r_regionkey AS size FROM region UNION ALL SELECT 'b', n_name, n_regionkey FROM nation UNION ALL SELECT 'c', p_name, p_size FROM part")
def union_of_runs(spark, sf_dir):
    """Tables of several runs as one, each row with its run."""
    t = lambda n, *c: table(spark, sf_dir, n).select(*[F.col(x).alias(a) for x, a in zip(c, ("name", "size"))])
    runs = {"a": t("region", "r_name", "r_regionkey"), "b": t("nation", "n_name", "n_regionkey"), "c": t("part", "p_name", "p_size")}
    return J.key_union([df.select(F.lit(k).alias("run"), *df.columns) for k, df in runs.items()])


@query("kept_and_removed", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'remove' ELSE 'keep' END AS decision FROM documents")
def kept_and_removed(spark, sf_dir):
    """Every row is in one of two parts."""
    gone, kept = J.split_by(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").where("quality = 0").select("doc_id"), ["doc_id"])
    return gone.withColumn("decision", F.lit("remove")).unionByName(kept.withColumn("decision", F.lit("keep")))


@query("clusters_of_motions", "SELECT o_custkey AS motion, c_mktsegment AS kind, count(*) AS clusters, array_to_string(list_sort(list(o_orderkey)), ';') AS keys FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY ALL")
def clusters_of_motions(spark, sf_dir):
    """The clusters of each motion of some kinds, looked up by its key."""
    motions = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.col("c_custkey").alias("motion"), F.col("c_mktsegment").alias("kind"))
    found = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("motion"), "o_orderkey").join(motions, "motion")
    return found.groupBy("motion", "kind").agg(F.count("*").alias("clusters"), F.array_join(F.array_sort(F.collect_list("o_orderkey")), ";").alias("keys"))


@query("tolerant_clusters", """WITH e AS (SELECT user_id AS motion, event_id // 3 AS frame0 FROM events WHERE event_id % 4 <> 0), m AS (SELECT *, CASE WHEN frame0 - lag(frame0) OVER w > 100 THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY motion ORDER BY frame0)),
c AS (SELECT motion, frame0, sum(fresh) OVER (PARTITION BY motion ORDER BY frame0) AS cluster FROM m) SELECT motion, cluster::BIGINT AS cluster, min(frame0) AS start_frame, count(*) AS events FROM c GROUP BY motion, cluster""")
def tolerant_clusters(spark, sf_dir):
    """Clusters of frames given as text: whole numbers with a fraction are taken, what is no number is passed over."""
    from stridelake.functions.angles import number_or
    from stridelake.operators import events as E

    frame = F.floor(F.col("event_id") / 3)
    text = F.when(F.col("event_id") % 8 == 0, "").when(F.col("event_id") % 4 == 0, "none").otherwise(F.concat(frame.cast("string"), F.lit(".0")))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("motion"), number_or(text, -1.0).cast("long").alias("frame0")).where("frame0 >= 0").withColumn("joint", F.lit(""))
    return E.gap_clusters(rows, ["motion"], gap=100).groupBy("motion", "cluster").agg(F.min("frame0").alias("start_frame"), F.count("*").alias("events"))


@query("sorted_report", "SELECT row_number() OVER (ORDER BY s_nationkey, s_acctbal DESC, s_name) - 1 AS place, s_name FROM supplier")
def sorted_report(spark, sf_dir):
    """A report in the order of several keys, as its one file has it."""
    from stridelake.storage import shared_dir

    path = shared_dir(spark)
    table(spark, sf_dir, "supplier").orderBy("s_nationkey", F.desc("s_acctbal"), "s_name").select("s_name").coalesce(1).write.csv(path)
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value"), "\n")).alias("place", "s_name"))
    return lines.where("s_name <> ''").select(F.col("place").cast("long").alias("place"), "s_name")
