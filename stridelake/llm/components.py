"""Connected components of a distributed link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.common import written


def _towards_least(links: DataFrame, both_ways: bool) -> DataFrame:
    """Each node's neighbours that are not below it (large star) or all its lower ones (small star) are linked to its least neighbour."""
    seen = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both_ways else links
    least = seen.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = seen.join(least, "a")
    if both_ways:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links(a, b)`` of comparable ids to ``(a, root)``: for every linked node the least node that it reaches.

    Every round is two pre-aggregated minima and two equi-joins over the links, and its result is a written table in the
    shared folder; the number of rounds grows with the logarithm of the number of nodes. No link or label is collected: the
    driver sees a count and a checksum. Self links and repeated links are harmless, null ends are ignored, ties can't be, as ids are compared, an empty table
    gives an empty table.
    """
    state = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        state = written(_towards_least(_towards_least(state, True), False))
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return state.select("a", F.col("b").alias("root"))
