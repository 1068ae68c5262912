"""Folders that the driver and all executors share, for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_folders: set[tuple[str, str]] = set()


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, local mode gets a temporary folder of its own; on a
    cluster that is an error, as executors don't see the driver's disk.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(path)
        return path
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="nestql-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, what: str) -> str:
    """A path for one table, in a folder of this application that goes when its driver ends."""
    app = spark.sparkContext.applicationId
    root = f"{scratch_root(spark).rstrip('/')}/nestql-{app}"
    if (app, root) not in _folders:
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(root)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
        _folders.add((app, root))
    return f"{root}/{what}-{uuid.uuid4().hex[:12]}"


def removed(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
