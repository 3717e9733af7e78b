"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders made for a session, by application: what ``release`` deletes.
_MADE: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the shared folder the cluster names in ``spark.checkpoint.dir``.

    Where that setting is missing a temporary folder is set for the session, in local mode alone: on a cluster executors would not see it, so that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="stridelake-"))
    folder = f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"
    _MADE.setdefault(context.applicationId, []).append(folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives lost executors, is computed once.

    It runs at once, so operators and queries that use it run jobs while they are built; in local mode without ``spark.checkpoint.dir`` the folder is a temporary one of the machine.
    """
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes the folders made for this session so far, with those beside them whose names begin alike, once no result that reads them is needed any more; returns how many there were."""
    folders = _MADE.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        pattern = jvm.org.apache.hadoop.fs.Path(f"{folder}*")
        system = pattern.getFileSystem(conf)
        for found in system.globStatus(pattern) or ():
            system.delete(found.getPath(), True)
    return len(folders)
