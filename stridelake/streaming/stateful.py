"""Streams with state of their own: gap clusters with the values' steps and moments, joins of two streams by time, reports that are written once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stridelake.storage import shared_dir

_STATE = "waiting array<struct<at: long, id: long, value: double>>, start long, last long, value double, n long, turned double, mean double, squares double"
_CLUSTER = "key long, start long, last long, n long, turned double, mean double, std double"


def _wrapped(difference: float) -> float:
    return (difference + 180.0) % 360.0 - 180.0


class OpenCluster:
    """A cluster that may still grow: its ends in microseconds, the sum of wrapped steps of its values, and their running mean and squares."""

    def __init__(self, start: int, last: int, value: float, n: int, turned: float, mean: float, squares: float):
        self.start, self.last, self.value, self.n, self.turned, self.mean, self.squares = start, last, value, n, turned, mean, squares

    @classmethod
    def of(cls, at: int, value: float) -> OpenCluster:
        return cls(at, at, value, 1, 0.0, value, 0.0)

    def add(self, at: int, value: float) -> None:
        self.turned += _wrapped(value - self.value)
        self.last, self.value, self.n = at, value, self.n + 1
        away = value - self.mean
        self.mean += away / self.n
        self.squares += away * (value - self.mean)

    def row(self, key: int) -> tuple:
        return key, self.start, self.last, self.n, self.turned, self.mean, (self.squares / self.n) ** 0.5


def online_clusters(events: DataFrame, key: str, time: str, order: str, value: str, delay: str, gap: float) -> DataFrame:
    """``(key, start, last, n, turned, mean, std)``: clusters of a key's events no more than ``gap`` seconds apart, each returned once the watermark is that far beyond it.

    ``turned`` is the sum of the wrapped steps between successive values, ``mean`` and ``std`` are their moments, ends are microseconds. A key's state is its open cluster and the events that the
    watermark hasn't reached, which are taken in the order of time and ``order``, however they come in; what comes later than ``delay`` is dropped. A timer at the end of the gap
    closes a cluster without further events; a key without open cluster and waiting events has no state.
    """
    reach = int(gap * 1_000_000)

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, cluster = [], None
        if state.exists:
            held = state.get
            waiting = [tuple(w) for w in held[0] or []]
            cluster = OpenCluster(*held[1:]) if held[1] is not None else None
        for rows in batches:
            waiting += list(zip(rows["at"].tolist(), rows["id"].tolist(), rows["value"].tolist()))
        mark = state.getCurrentWatermarkMs() * 1000
        due, out = sorted(w for w in waiting if w[0] < mark), []
        waiting = [w for w in waiting if w[0] >= mark]
        for at, _, x in due:
            if cluster is not None and at - cluster.last <= reach:
                cluster.add(at, x)
            else:
                if cluster is not None:
                    out.append(cluster.row(keys[0]))
                cluster = OpenCluster.of(at, x)
        if cluster is not None and mark > cluster.last + reach:
            out.append(cluster.row(keys[0]))
            cluster = None
        if cluster is None and not waiting:
            if state.exists:
                state.remove()
        else:
            own = (cluster.start, cluster.last, cluster.value, cluster.n, cluster.turned, cluster.mean, cluster.squares) if cluster is not None else (None,) * 7
            state.update((waiting, *own))
            ends = [w[0] for w in waiting] + ([cluster.last + reach] if cluster is not None else [])
            state.setTimeoutTimestamp(max(min(ends) // 1000, mark // 1000) + 1)
        if out:
            yield pd.DataFrame(out, columns=["key", "start", "last", "n", "turned", "mean", "std"])

    rows = events.withWatermark(time, delay).where(F.col(value).isNotNull()).select(F.col(key).cast("long").alias("key"), time, F.unix_micros(time).alias("at"), F.col(order).cast("long").alias("id"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(step, _CLUSTER, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def following(left: DataFrame, right: DataFrame, key: str, times: tuple[str, str], delay: str, within: str, outer: bool = False) -> DataFrame:
    """Rows of two streams with equal keys where the right one comes at most ``within`` after the left one; with ``outer`` also left rows without one, once the watermarks of both rule it out.

    Other columns than the key must have different names. The time range lets either side's state go with the watermark.
    """
    a, b = left.withWatermark(times[0], delay), right.withWatermark(times[1], delay).withColumnRenamed(key, "__key")
    near = (F.col(key) == F.col("__key")) & (F.col(times[1]) >= F.col(times[0])) & (F.col(times[1]) <= F.col(times[0]) + F.expr(f"interval {within}"))
    return a.join(b, near, "left_outer" if outer else "inner").drop("__key")


class Reports:
    """Report tables of a stream, each batch in them once whatever is run again.

    A batch's rows of a table are a folder named by its number, which a repeated batch replaces; the ledger has a file for each batch all of whose tables are written. Readers see batches of the
    ledger alone, so a batch that failed half-way is not seen until it has been run again.
    """

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, Callable[[DataFrame], DataFrame]]):
        self.spark, self.folder, self.tables = spark, folder, tables

    def done(self) -> list[int]:
        ledger = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_ledger")
        system = ledger.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(int(f.getPath().getName()) for f in system.listStatus(ledger)) if system.exists(ledger) else []

    def write(self, batch: DataFrame, number: int) -> None:
        if number in self.done():
            return
        held = batch.persist()
        try:
            for name, make in self.tables.items():
                make(held).write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={number}")
        finally:
            held.unpersist()
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_ledger/{number}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True).close()

    def table(self, name: str) -> DataFrame:
        """All finished batches of a table, with the column ``batch``."""
        done = self.done()
        rows = self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(*[f"{self.folder}/{name}/batch={n}" for n in done])
        return rows.withColumn("batch", F.col("batch").cast("int"))

    def run(self, stream: DataFrame, checkpoint: str | None = None) -> None:
        """Runs the stream to the end of what is there; the checkpoint tells where to go on after a failure."""
        where = checkpoint or f"{shared_dir(self.spark)}/state"
        stream.writeStream.foreachBatch(self.write).option("checkpointLocation", where).trigger(availableNow=True).start().awaitTermination()


def moment_state(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, sum, sum of squares about the batch's own mean and extremes per key: states of batches, to be merged."""
    x = F.col(value)
    return rows.where(x.isNotNull()).groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var"), F.min(x).alias("least"), F.max(x).alias("most"))


def merged_moments(states: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, n, mean, std, least, most)`` of all rows behind the states."""
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    second = F.sum(F.col("n") * (F.col("var") + F.col("mean") * F.col("mean"))) / n - mean * mean
    return states.groupBy(*keys).agg(n.alias("n"), mean.alias("mean"), F.sqrt(F.greatest(second, F.lit(0.0))).alias("std"), F.min("least").alias("least"), F.max("most").alias("most"))
