"""Shared helpers of the training-data operators: shared storage, sizes, graph components."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word-based operator: blank and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir as the session has it.

    Only on one machine (tests) is a temporary folder made and set where it is unset; a cluster must name one.
    """
    sc = spark.sparkContext
    at = sc.getCheckpointDir()
    if at is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tesserae-"))
        at = sc.getCheckpointDir()
    return at


_made: list[tuple[SparkSession, str]] = []
_tables: dict[str, str] = {}


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what lies there goes when the Python process ends, or by release() before."""
    if not _made:
        atexit.register(_release_all)
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    _made.append((spark, path))
    return path


def release(spark: SparkSession, *paths: str) -> None:
    """Deletes paths that nothing will read again."""
    context = spark.sparkContext
    for path in paths:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        if path in _tables:
            spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
        _made[:] = [m for m in _made if m[1] != path]


def _release_all() -> None:
    try:
        while _made:
            release(*_made[-1])
    except Exception:  # the JVM may be gone; then its folder is the cluster's to clean
        _made.clear()


#: Spark's own setting: a finished query's shuffle files go at once. What it wrote is all that later steps read.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Spark's own setting: rows of an Arrow batch that goes to Python.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage is cut and survives lost executors.

    Arrow batches have at most batch rows, where rows become much more than their text on the way to Python.
    """
    with _set(df.sparkSession, {} if batch is None else {BATCH: str(min(batch, int(df.sparkSession.conf.get(BATCH))))}):
        return stored_at(df, fresh_path(df.sparkSession, name))


@contextmanager
def _set(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Queries run within leave no shuffle files; for writes, whose results are read from what they wrote."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored_at(df: DataFrame, path: str) -> DataFrame:
    """stored() at a path of fresh_path(), which release() may delete before the end."""
    with cleaned(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """df stored like stored() in as many buckets of key as there are shuffle partitions, so that meeting others by key doesn't shuffle it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    table = os.path.basename(path).replace("-", "_")
    with cleaned(spark):
        df.write.option("compression", "zstd").option("path", path).bucketBy(partitions(spark), key).saveAsTable(table)
    found = spark.table(table)
    _tables[path] = table
    return found


def unused(df: DataFrame, name: str) -> str:
    """name, or with underscores what df has no column of."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge; isolated nodes don't appear.

    Alternating large-star and small-star rounds over long keys. Each half is one join of the edges with
    the per-node minima; both sides are stored first, so that adaptive execution can split a hot centre, and deleted when the
    next round has its own. The rounds end, whatever their number, when no node that has a smaller neighbour has another
    neighbour, too: then each component is a star around its smallest node. That test is exact, and the star rounds
    always come there.
    Null ends and self-loops are ignored; an empty edge table gives an empty result.
    """
    spark, used = edges.sparkSession, []

    def keep(df: DataFrame) -> DataFrame:
        used.append(fresh_path(spark, "cc"))
        return stored_at(df, used[-1])

    e = keep(edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).where("a > b").distinct())
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        mins = keep(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        if mins.where("m < u and n > 1").isEmpty():
            break
        # large star: neighbours above u go to the least of u and its neighbours
        large = keep(both.where("v > u").join(mins.select("u", "m"), "u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct())
        # small star: u and its smaller neighbours go to the least of them
        least = keep(large.groupBy("a").agg(F.min("b").alias("m")))
        star = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
        e = keep(star.union(least.select("a", F.col("m").alias("b"))).distinct())
        release(spark, *used[:-1])
        del used[:-1]
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
