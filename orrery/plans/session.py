"""Session settings that the engine relies on."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

#: Where a session on one machine names no checkpoint folder.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/orrery"


def prepared(spark: SparkSession) -> SparkSession:
    """UTC, and a folder for checkpoint(): the session's spark.checkpoint.dir. Where that is unset, a local master gets
    a local folder; on a cluster it is an error, as checkpoints would be lost with their executors."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or LOCAL_CHECKPOINTS)
    return spark


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return os.path.join(prepared(spark).sparkContext.getCheckpointDir(), f"{name}-{uuid.uuid4().hex}")


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
