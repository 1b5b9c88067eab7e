"""Adjacency of edges as stored tables: the edges of a node lie in one bucket of either side, in order, so a lookup reads little.

A side's table is partitioned by a hash of the end's id and sorted by that id within a file. A lookup's bucket is a constant, so Spark lists that
partition alone, and Parquet's least and greatest id of each row group skip the rest of it. Unresolved ends are in no bucket of their side.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.schema import EDGES, KEY
from tesserae.storage import stored

#: Edges of a bucket.
BUCKET = 1_000_000
_SIDES = {"out": "src", "in": "dst"}


@dataclass(frozen=True)
class Adjacency:
    """Both sides' tables at path, in so many buckets."""

    spark: SparkSession
    path: str
    buckets: int
    schema: str = EDGES

    def _side(self, side: str) -> DataFrame:
        return self.spark.read.schema(self.schema + ", bucket int").parquet(f"{self.path}/{side}")

    def _of(self, id_: Column) -> Column:
        return F.pmod(F.xxhash64(id_), F.lit(self.buckets)).cast("int")

    def edges_from(self, id_: str) -> DataFrame:
        return self._side("out").where((F.col("bucket") == self._of(F.lit(id_))) & (F.col("src_id") == id_)).drop("bucket")

    def edges_to(self, id_: str) -> DataFrame:
        return self._side("in").where((F.col("bucket") == self._of(F.lit(id_))) & (F.col("dst_id") == id_)).drop("bucket")

    def edges_of(self, ids: DataFrame, side: str = "out", id_col: str = "id") -> DataFrame:
        """The edges of many nodes, by a join on bucket and id; ids has the graph's key, too. Buckets that no id falls into aren't read where ids are few."""
        wanted = ids.select(*KEY, F.col(id_col).alias(f"{_SIDES[side]}_id"), self._of(F.col(id_col)).alias("bucket")).distinct()
        return self._side(side).join(wanted, [*KEY, "bucket", f"{_SIDES[side]}_id"]).drop("bucket").select(self._side(side).drop("bucket").columns)

    def degrees(self, side: str = "out") -> DataFrame:
        """(key, id, edges) of every node with edges on that side, from the id column alone."""
        return self._side(side).groupBy(*KEY, F.col(f"{_SIDES[side]}_id").alias("id")).agg(F.count("*").alias("edges"))


def stored_adjacency(edges: DataFrame, path: str, buckets: int | None = None, sides: Sequence[str] = tuple(_SIDES)) -> Adjacency:
    """Writes both sides of edges, a checked table or some of its columns, at path; or only the sides that are asked for."""
    edges = stored(edges, "edges")  # the ranges are sampled first, which would make the edges once more
    n = buckets or max(1, -(-edges.count() // BUCKET))
    for side in sides:
        end = _SIDES[side]
        mine = edges.where(f"{end}_resolved").withColumn("bucket", F.pmod(F.xxhash64(f"{end}_id"), F.lit(n)).cast("int"))
        # a bucket is split over tasks by the id's range, so that a large one isn't one task's
        tasks = max(n, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        dealt = mine.repartitionByRange(tasks, "bucket", f"{end}_id").sortWithinPartitions("bucket", f"{end}_id")
        dealt.write.partitionBy("bucket").parquet(f"{path}/{side}")
    return Adjacency(edges.sparkSession, path, n, ", ".join(f"{c} {t}" for c, t in edges.dtypes))
