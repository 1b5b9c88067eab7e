"""Scans as a stream: new files of scan rows are appended to the scans table, once each, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tesserae.sources import scans


def follow(spark: SparkSession, folder: str, schema: str, table: str, checkpoint: str) -> StreamingQuery:
    """Appends what arrives in folder (Parquet rows of scans, with project_id and scanned_at) and ends when all is in."""

    def batch(rows: DataFrame, _: int) -> None:
        scans.append(rows.dropDuplicates(["project_id", "scanned_at"]), table)

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
