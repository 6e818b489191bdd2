"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path for a fresh folder in spark.checkpoint.dir, removed when the program ends. Only in local mode may that be unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="foliant-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/foliant-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it takes it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


@atexit.register
def _remove_all() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):  # the session may be gone
            remove(spark, path)
