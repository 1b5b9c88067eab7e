"""Tables with keys over Parquet folders: rows replace those that they meet, references must exist, a batch counts once.

A table's rows lie in partitions that follow from the row alone. A batch is checked as a whole before anything is written: no key twice, no
null where none may be, every reference met (anti joins), no key of another partition. Then the partitions that it touches are put together,
stored, and written by Spark's dynamic partition overwrite, which leaves all others alone. A marker under _commits ends a
batch; one that has it is not written again, and one that died on the way is simply pushed again, as rows replace rows of the same key.
One writer at a time is assumed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.schema import not_blank, require
from tesserae.storage import stored

PART = "_part"


def columns_of(schema: str) -> dict[str, bool]:
    """Names of a declaration's columns, and whether they may be null."""
    parts = [c.strip() for c in re.split(r",(?![^<]*>)", schema)]
    return {c.split()[0]: not c.lower().endswith("not null") for c in parts}


@dataclass(frozen=True)
class KeyedTable:
    """A table at path with a declared schema and a key; part is the SQL expression, over columns of a row, of the partition it lies in.

    references are (column, table) pairs: the column's value must be a key of that table, or null where the schema allows it.
    """

    path: str
    schema: str
    key: str
    part: str
    references: tuple[tuple[str, KeyedTable], ...] = field(default=())

    def __post_init__(self) -> None:
        not_blank(self.path, "path")
        require({self.key, *(c for c, _ in self.references)} <= set(columns_of(self.schema)), "a key or reference is no column")

    def _there(self, spark: SparkSession, below: str = "") -> bool:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}{below}")
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _rows(self, spark: SparkSession) -> DataFrame:
        """All rows with their partition, as a string."""
        empty = spark.createDataFrame([], self.schema).withColumn(PART, F.lit("").cast("string"))
        return spark.read.schema(empty.schema).parquet(f"{self.path}/rows") if self._there(spark, "/rows") else empty

    def read(self, spark: SparkSession) -> DataFrame:
        return self._rows(spark).drop(PART)

    def committed(self, spark: SparkSession, batch: str) -> bool:
        return self._there(spark, f"/_commits/{batch}/_SUCCESS")

    def orphans(self, rows: DataFrame) -> DataFrame:
        """Rows of which a reference isn't met, with the column that has it."""
        spark, out = rows.sparkSession, []
        for column, table in self.references:
            keys = table.read(spark).select(F.col(table.key).alias("_met"))
            out.append(rows.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_met"), "left_anti").withColumn("broken", F.lit(column)))
        found = out[0] if out else rows.limit(0).withColumn("broken", F.lit(""))
        for o in out[1:]:
            found = found.unionByName(o)
        return found

    def _checked(self, rows: DataFrame) -> DataFrame:
        names = columns_of(self.schema)
        missing = [n for n in names if n not in rows.columns]
        require(not missing, f"the rows lack {missing}")
        rows = stored(rows.select(*[F.col(n) for n in names], F.expr(self.part).cast("string").alias(PART)), "keyed")
        refuse = lambda bad, why: require(not bad, f"{why}: {[r.asDict() for r in bad]}")
        for n in [n for n, nullable in names.items() if not nullable]:
            refuse(rows.where(F.col(n).isNull()).select(self.key).limit(3).collect(), f"{n} is null")
        refuse(rows.groupBy(self.key).agg(F.count("*").alias("n")).where("n > 1").limit(3).collect(), "a key comes twice")
        refuse(self.orphans(rows).select(self.key, "broken").limit(3).collect(), "a reference isn't met")
        elsewhere = self._rows(rows.sparkSession).select(self.key, F.col(PART).alias("_of")).join(rows.select(self.key, PART), self.key).where(f"_of <> {PART}")
        refuse(elsewhere.select(self.key).limit(3).collect(), "a key has moved to another partition")
        return rows

    def merge(self, rows: DataFrame, batch: str, replace: bool = True) -> bool:
        """Puts a batch of rows in by key; with replace false rows whose key is there already are left as they were. False if the batch was in already."""
        spark = rows.sparkSession
        require(bool(re.fullmatch(r"[\w.-]+", batch)), f"a batch's name is made of letters, digits, _, . and -: {batch}")
        if self.committed(spark, batch):
            return False
        rows = self._checked(rows)
        # dynamic pruning reads the touched partitions alone
        old = self._rows(spark).join(F.broadcast(rows.select(PART).distinct()) if rows.select(PART).distinct().count() < 10_000 else rows.select(PART).distinct(), PART, "left_semi").select(rows.columns)
        kept = old.join(rows.select(self.key), self.key, "left_anti").unionByName(rows) if replace else old.unionByName(rows.join(old.select(self.key), self.key, "left_anti"))
        self._write(stored(kept.select(rows.columns), "keyed"))
        spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("overwrite").json(f"{self.path}/_commits/{batch}")
        return True

    def _write(self, rows: DataFrame) -> None:
        # a task for each partition, large ones split by key
        rows.repartition(PART, F.pmod(F.xxhash64(self.key), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(f"{self.path}/rows")

    def delete(self, keys: DataFrame, cascade: tuple[KeyedTable, ...] = ()) -> None:
        """Rows with these keys go, and rows of the tables in cascade that refer to them; a partition left without rows keeps an empty folder."""
        spark = keys.sparkSession
        gone = stored(keys.select(F.col(self.key).alias("_gone")).distinct(), "keyed")
        for table in cascade:
            for column, other in table.references:
                if other.path == self.path:
                    mine = table.read(spark).join(gone, F.col(column) == F.col("_gone"), "left_semi")
                    table.delete(mine.select(table.key))
        self._drop(gone)

    def _drop(self, gone: DataFrame) -> None:
        spark = gone.sparkSession
        rows = self._rows(spark)
        touched = rows.join(gone, F.col(self.key) == F.col("_gone"), "left_semi").select(PART).distinct()
        kept = stored(rows.join(touched, PART, "left_semi").join(gone, F.col(self.key) == F.col("_gone"), "left_anti").select(rows.columns), "keyed")
        empty = stored(touched.join(kept.select(PART).distinct(), PART, "left_anti"), "keyed")
        if not kept.isEmpty():
            self._write(kept)
        for r in empty.toLocalIterator():
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows/{PART}={r[PART]}")
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

