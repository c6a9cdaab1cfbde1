"""Lineage cuts for iterative jobs, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-shared-")


def shared_folder(spark: SparkSession) -> str:
    """This application's part of ``spark.checkpoint.dir``; ``clear`` deletes it.

    Where that is unset, a session with a local master gets a local folder; a cluster's session fails.
    """
    application = spark.sparkContext.applicationId
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _local_folder(application)
    return f"{found.rstrip('/')}/strandtable-{application}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settle(df: DataFrame, tag: str = "settled") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    It cuts the lineage like a checkpoint, in Parquet's compact form and with a known size, so that
    later joins can be planned on it, and it survives the loss of any executor.
    """
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def drop_settled(df: DataFrame) -> None:
    """Delete what ``settle`` has written, once nothing reads it any more."""
    path = getattr(df, "_shared_path", None)
    if path:
        _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has left in the shared folder, once its results are written elsewhere."""
    _delete(spark, shared_folder(spark))
