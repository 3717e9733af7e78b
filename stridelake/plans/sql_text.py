"""Queries that are Spark SQL text over the registered functions; what they read comes in by name."""

from __future__ import annotations

from stridelake.functions import sql as Q
from stridelake.plans.base import ORACLE_SQL, TRACE, WRAP, query, table, trace
from stridelake.plans.files import skeleton_files


@query("sql_rotations", f"""WITH p AS ({ORACLE_SQL["quat_product"]}), r AS ({ORACLE_SQL["rotate_vector"]}), a AS ({ORACLE_SQL["quat_angles"]})
SELECT p.id, p.x, p.y, p.z, p.w, r.x AS vx, r.y AS vy, r.z AS vz, r.bx, a.between_ AS angle FROM p JOIN r USING (id) JOIN a USING (id)""")
def sql_rotations(spark, sf_dir):
    """Products, turned vectors and angles by SQL functions."""
    Q.register(spark)
    text = """
    WITH e AS (SELECT vec_id AS id, transform(embedding, x -> double(x)) AS e FROM {vectors}),
    u AS (SELECT id, quat_unit(quat(e[0], e[1], e[2], e[3])) AS a, quat_unit(quat(e[4], e[5], e[6], e[7])) AS b, named_struct('x', e[8], 'y', e[9], 'z', e[10]) AS v FROM e),
    r AS (SELECT id, quat_product(a, b) AS p, quat_rotate(a, v) AS v, quat_rotate(quat_inverse(a), v) AS back, quat_angle(a, b) AS angle FROM u)
    SELECT id, round(p.x, 6) AS x, round(p.y, 6) AS y, round(p.z, 6) AS z, round(p.w, 6) AS w, round(v.x, 6) AS vx, round(v.y, 6) AS vy, round(v.z, 6) AS vz, round(back.x, 6) AS bx, round(angle, 5) AS angle FROM r"""
    return spark.sql(text, vectors=table(spark, sf_dir, "embeddings"))


@query("sql_motion_jumps", f"""WITH {TRACE}, s AS (SELECT motion, frame, lag(frame) OVER w AS frame0, abs({WRAP.format("q - lag(q) OVER w")}) AS jump FROM trace WINDOW w AS (PARTITION BY motion ORDER BY frame))
SELECT motion, 'event' AS kind, frame0, frame, round(jump, 6) AS jump, NULL::BIGINT AS count FROM s WHERE jump > 90
UNION ALL SELECT motion, 'summary', NULL, count(*), round(coalesce(max(jump), 0), 6), count(*) FILTER (WHERE jump > 90) FROM s GROUP BY motion""")
def sql_motion_jumps(spark, sf_dir):
    """One table in, events and summaries out, by a table function."""
    Q.register(spark)
    return spark.sql("SELECT motion, kind, frame0, frame, round(jump, 6) AS jump, count FROM motion_jumps(TABLE(SELECT motion, frame, q FROM {trace}), 90.0D)", trace=trace(spark, sf_dir))


@query("sql_skeleton_rows", ORACLE_SQL["bvh_channels"])
def sql_skeleton_rows(spark, sf_dir):
    """Skeleton files as rows by a table function joined to the files' texts."""
    Q.register(spark)
    files = spark.read.parquet(skeleton_files(spark, sf_dir)).selectExpr("bigint(regexp_extract(path, 'motion=([0-9]+)', 1)) AS motion", "value")
    return spark.sql("SELECT motion, frame, joint, channel, place, round(s.value, 6) AS value FROM {files} f, LATERAL skeleton_rows(f.value) s WHERE channel IS NOT NULL", files=files)
