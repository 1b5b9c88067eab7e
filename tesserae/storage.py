"""Where intermediate tables go: the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; only on one machine a temporary folder is made and set where it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tesserae-"))
    return sc.getCheckpointDir()


_made: list[tuple[SparkSession, str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what lies there goes when the Python process ends."""
    if not _made:
        atexit.register(_release)
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    _made.append((spark, path))
    return path


def release(spark: SparkSession, *paths: str) -> None:
    """Deletes paths of fresh_path() that nothing will read again."""
    context = spark.sparkContext
    for path in paths:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
        _made[:] = [m for m in _made if m[1] != path]


def _release() -> None:
    try:
        while _made:
            release(_made[-1][0], _made[-1][1])
    except Exception:  # the JVM may be gone; then the folder is the cluster's to clean
        _made.clear()


#: Spark's own setting: a finished query's shuffle files go at once. What it wrote is all that later steps read.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again, so that loops don't grow a lineage and lost executors cost nothing."""
    return stored_at(df, fresh_path(df.sparkSession, name))


def stored_at(df: DataFrame, path: str) -> DataFrame:
    """stored() at a path of fresh_path(), which release() may delete before the end."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Steps:
    """Tables of a loop's steps; what a step has replaced is deleted."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name, self.held = spark, name, {}

    def keep(self, slot: str, df: DataFrame) -> DataFrame:
        """df stored in place of what the slot held, which df may still read while it is written."""
        path = fresh_path(self.spark, self.name)
        out = stored_at(df, path)
        if slot in self.held:
            release(self.spark, self.held[slot])
        self.held[slot] = path
        return out

    def drop(self, *slots: str) -> None:
        release(self.spark, *[self.held.pop(s) for s in slots if s in self.held])
