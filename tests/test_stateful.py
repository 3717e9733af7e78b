"""Streams that are stopped, go on, and end."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stridelake.streaming import stateful as W

T0 = pd.Timestamp("2024-01-01", tz="UTC")


def files(spark, folder, batches):
    for rows in batches:
        df = spark.createDataFrame([(u, (T0 + pd.Timedelta(seconds=s)).to_pydatetime(), i, v) for u, s, i, v in rows], "user long, ts timestamp, id long, value double")
        df.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("user long, ts timestamp, id long, value double").option("maxFilesPerTrigger", 1).parquet(folder)


def test_clusters_grow_over_batches_and_their_state_goes(spark, tmp_path):
    """A late row of the first batch's time joins its cluster, steps are wrapped, a too late row is dropped, and after the end no key but the last one has state."""
    batches = [[(1, 0, 0, 170.0), (1, 10, 1, -170.0), (2, 5, 2, 1.0)], [(1, 6, 3, 175.0), (1, 30, 4, 0.0), (1, 500, 5, 9.0)], [(3, 5000, 7, 0.0)], [(2, 1, 6, 7.0), (3, 9000, 8, 2.0)]]
    stream = W.online_clusters(files(spark, str(tmp_path / "in"), batches), "user", "ts", "id", "value", "20 seconds", 60)
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    zero = int(T0.value // 1000)
    found = sorted((r.key, (r.start - zero) // 10**6, (r["last"] - zero) // 10**6, r.n, round(r.turned, 6)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert found == [(1, 0, 30, 4, 5.0 + 15.0 + 170.0), (1, 500, 500, 1, 0.0), (2, 5, 5, 1, 0.0), (3, 5000, 5000, 1, 0.0)]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_reports_of_a_stream_that_failed(spark, tmp_path):
    """The second table of the second batch fails once: after the restart both tables are those of one run."""
    stream = files(spark, str(tmp_path / "in"), [[(1, i, i, float(i)) for i in range(5)], [(1, i, i, float(i)) for i in range(5, 9)], [(2, 9, 9, 1.0)]])
    lost = {"left": 1}

    def large(rows):
        if lost["left"] and rows.where("value = 7").count():
            lost["left"] = 0
            raise RuntimeError("lost")
        return rows.where("value > 2").select("user", "id")

    reports = W.Reports(spark, str(tmp_path / "reports"), {"moments": lambda rows: W.moment_state(rows, ["user"], "value"), "large": large})
    with pytest.raises(Exception, match="lost"):
        reports.run(stream, str(tmp_path / "state"))
    assert reports.done() == [0] and reports.table("large").count() == 2
    reports.run(stream, str(tmp_path / "state"))
    assert reports.done() == [0, 1, 2]
    assert sorted(r.id for r in reports.table("large").collect()) == [3, 4, 5, 6, 7, 8]
    got = {r.user: r for r in W.merged_moments(reports.table("moments"), ["user"]).collect()}
    assert got[1].n == 9 and got[1].mean == pytest.approx(4.0) and got[1].std == pytest.approx((sum((i - 4) ** 2 for i in range(9)) / 9) ** 0.5)
    reports.write(spark.createDataFrame([(5, 5)], "user long, id long").withColumn("value", F.lit(9.0)), 1)  # delivered again
    assert reports.table("large").count() == 6
