"""Folders for files that a query writes and reads again, in the store that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def lasting(spark: SparkSession) -> str:
    """A new folder that stays: below spark.checkpoint.dir, or where a local session names none, a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="pairloom-")
    return f"{root.rstrip('/')}/pairloom/{uuid.uuid4().hex}"


def scratch(spark: SparkSession) -> str:
    """A new folder that goes when the driver's JVM ends."""
    path = lasting(spark)
    file_system, where = _open(spark, path)
    file_system.deleteOnExit(where)
    return path


def _open(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one small file."""
    file_system, where = _open(spark, path)
    out = file_system.create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def exists(spark: SparkSession, path: str) -> bool:
    file_system, where = _open(spark, path)
    return file_system.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    file_system, where = _open(spark, path)
    file_system.delete(where, True)
