"""Registration of queries, and the fixture tables seen as motion data.

A user's events in time order are a motion: ``frame`` counts them from 0, the event type is the joint, the value its angle in degrees.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TRACE = """trace AS (
  SELECT user_id AS motion, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, event_type AS joint, value AS q FROM events)"""
#: The wrapped difference a - b in [-180, 180) as DuckDB text.
WRAP = "(({0}) + 180 - 360 * floor((({0}) + 180) / 360) - 180)"


def query(name: str, sql: str | None = None):
    """Registers a (spark, sf_dir) -> DataFrame function, with its DuckDB twin where SQL can express it."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trace(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """``(motion, frame, joint, q)``; one exchange on the motion, which the window operators after it reuse.

    ``spread`` keeps all ``spark.sql.shuffle.partitions`` of it, for rows that are multiplied afterwards: adaptive execution would join partitions by the bytes of the events alone.
    """
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events")
    if spread:
        events = events.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "user_id")
    numbered = events.withColumn("frame", (F.row_number().over(order) - 1).cast("long"))
    return numbered.select(F.col("user_id").alias("motion"), "frame", F.col("event_type").alias("joint"), F.col("value").alias("q"))
