"""Folders for intermediate output, in the shared storage of the session."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"
_made: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Where it names none, one below the warehouse is set, which driver and executors share.
    """
    shared = spark.conf.get(SETTING, None)
    if not shared:
        shared = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
        spark.conf.set(SETTING, shared)
    return shared.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """New path in the shared folder, below a folder of the application that goes when it ends."""
    own = f"{shared_folder(spark)}/synthmill-{spark.sparkContext.applicationId}"
    if own not in _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _made.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system, as the driver sees it: the same place for every executor."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return found.replace("file:/", "file:///", 1) if found.startswith("file:/") and not found.startswith("file://") else found
