"""The same operators on streams: windows with watermarks, sessions, repeated deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stridelake.storage import shared_dir

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def event_stream(spark: SparkSession, folder: str, files: str = "events.parquet", per_batch: int | None = None) -> DataFrame:
    """Files of a folder as a stream, ``per_batch`` of them in a batch; times without zone are UTC, as watermarks need instants."""
    reader = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", files)
    stream = (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Processes what is there, writes it to a table in the shared folder, and returns that table."""
    spark, out, state = stream.sparkSession, shared_dir(stream.sparkSession), shared_dir(stream.sparkSession)
    running = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).format("parquet").start(out)
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def tumbling(events: DataFrame, width: str, delay: str) -> DataFrame:
    """Counts and sums per window and type; a window is returned once the watermark has passed its end."""
    windows = events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type")
    found = windows.agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def counts(events: DataFrame, width: str, delay: str) -> DataFrame:
    """Rows per window; what comes after the watermark has passed its window is dropped."""
    found = events.withWatermark("ts", delay).groupBy(F.window("ts", width)).agg(F.count("*").alias("n"))
    return found.select(F.col("window.start").alias("start"), "n")


def sliding(events: DataFrame, width: str, slide: str, delay: str) -> DataFrame:
    found = events.withWatermark("ts", delay).groupBy(F.window("ts", width, slide)).agg(F.count("*").alias("n"), F.max("value").alias("largest"))
    return found.select(F.col("window.start").alias("start"), "n", "largest")


def sessions(events: DataFrame, gap: str, delay: str) -> DataFrame:
    """Gap clusters online: events of a user no farther apart than the gap."""
    found = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_per_key(events: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """Repeated deliveries within the watermark are dropped."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)

