"""Folders that the driver and all executors share, by Hadoop's file systems."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _at(spark, path)
    return fs.exists(target)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no folder."""
    fs, target = _at(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(target)) if fs.exists(target) else []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, if it is there."""
    fs, target = _at(spark, path)
    fs.delete(target, True)


def is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def shared_base(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of this machine serves a local session, as in tests; a cluster has no such
    folder, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        base = f"file://{tempfile.gettempdir()}/rillstone-shared"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"
