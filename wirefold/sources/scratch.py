"""A folder for intermediate files that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir.

    Where that is unset, a session in one process uses a temporary folder of
    this machine; a cluster is an error, as its executors share no such folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        local = tempfile.mkdtemp(prefix="wirefold-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        return local
    folder = f"{base.rstrip('/')}/wirefold-{uuid.uuid4().hex[:12]}"
    atexit.register(_delete, spark, folder)
    return folder


def _delete(spark: SparkSession, folder: str) -> None:
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the JVM may be gone by now
        pass
