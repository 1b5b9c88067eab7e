"""Drift and risk of every scan as it arrives, by state kept for each project.

A project's state holds its scans that are newer than the watermark, and the last one before it: all that a scan still to come can
be compared with or be the baseline of. A scan that arrives is compared at once with the one before it in time; one that arrives
between two others also gives the later one anew, with its new baseline. So results carry a number that ascends in a project; the
last one of a scan counts (settled()), and is what a batch over all scans gives, in whatever order they came.

A scan older than the watermark whose place in time can't be told any more is reported as late, without a baseline. A
scan that repeats a project's time is ignored, the first one stays. Scans without a project or a time are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tesserae.operators import calibration
from tesserae.operators.governance import GovernancePolicy
from tesserae.schema import DIMENSIONS

#: A scan as it arrives.
SCAN = "project_id string, scanned_at timestamp, fingerprint string, total_entropy double, " + ", ".join(f"{d} double" for d in DIMENSIONS)
_PAIR = [f"{d} double, base_{d} double" for d in DIMENSIONS]
#: A scan with its baseline.
COMPARED = "project_id string, number long, scanned_at timestamp, baseline_at timestamp, late boolean, fingerprint string, base_fingerprint string, total_entropy double, " + ", ".join(_PAIR)


def _value(x: object) -> object:
    return None if x is None or x != x else x


def _compared(key: tuple, pages: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    number, history = json.loads(state.get[0]) if state.exists else (0, [])
    mark = state.getCurrentWatermarkMs()
    out: list[tuple] = []

    def tell(scan: dict, base: dict | None, late: bool = False) -> None:
        nonlocal number
        number += 1
        at = lambda s: None if s is None else pd.Timestamp(s["at"], unit="us")
        of = base or {}
        out.append((key[0], number, at(scan), at(base), late, scan["fingerprint"], of.get("fingerprint"), scan["total_entropy"], *[v for d in DIMENSIONS for v in (scan[d], of.get(d))]))

    rows = pd.concat(list(pages), ignore_index=True)
    if key[0] is None:
        return
    for r in rows.sort_values("scanned_at", kind="stable").itertuples(index=False):
        if pd.isna(r.scanned_at):
            continue
        scan = {"at": int(pd.Timestamp(r.scanned_at).value // 1000), **{c: _value(getattr(r, c)) for c in ("fingerprint", "total_entropy", *DIMENSIONS)}}
        if any(h["at"] == scan["at"] for h in history):
            continue
        place = sum(h["at"] < scan["at"] for h in history)
        if place == 0 and scan["at"] < 1000 * mark and number:
            tell(scan, None, late=True)
            continue
        history.insert(place, scan)
        tell(scan, history[place - 1] if place else None)
        if place + 1 < len(history):
            tell(history[place + 1], scan)
    old = sum(h["at"] <= 1000 * mark for h in history)
    state.update((json.dumps((number, history[max(0, old - 1) :])),))
    if out:
        yield pd.DataFrame(out, columns=[c.split()[0] for c in COMPARED.split(", ")])


def compared(scans: DataFrame, delay: str) -> DataFrame:
    """COMPARED rows of a stream of SCAN rows; a scan may come as late as delay after a newer one of any project."""
    rows = scans.withWatermark("scanned_at", delay)
    return rows.groupBy("project_id").applyInPandasWithState(_compared, COMPARED, "scans string", "append", GroupStateTimeout.NoTimeout)


def with_risk(rows: DataFrame, policy: GovernancePolicy) -> DataFrame:
    """COMPARED rows, of a batch, with deltas (by dimension) and risk, by the same functions as any two snapshots."""
    name = F.concat_ws("/", "project_id", "number")
    wide = lambda base: rows.select(name.alias("subject_id"), F.lit("scan").alias("scan_id"), F.col(f"{base}fingerprint").alias("print"), *[F.col(f"{base}{d}").alias(d) for d in DIMENSIONS])
    tall = lambda df: calibration.snapshots(df, None).drop("governance_fingerprint").join(df.select("subject_id", F.col("print").alias("governance_fingerprint")), "subject_id")
    before, now = tall(wide("base_").where(rows["baseline_at"].isNotNull())), tall(wide(""))
    deltas = calibration.drift(before, now).groupBy("subject_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dimension", "delta")))).alias("deltas"))
    risk = calibration.risk(rows.select(name.alias("subject_id"), "total_entropy"), before, now, policy)
    risk = risk.select("subject_id", F.col("value").alias("risk"), "drift_term", "undefined_because")
    out = rows.withColumn("subject_id", name).join(deltas, "subject_id", "left").join(risk, "subject_id", "left")
    return out.select("project_id", "number", "scanned_at", "baseline_at", "late", "deltas", "risk", "drift_term", "undefined_because")


def follow(spark: SparkSession, folder: str, results: str, checkpoint: str, policy: GovernancePolicy, delay: str, files: int | None = None) -> StreamingQuery:
    """Reads SCAN rows as they arrive in folder (Parquet) and ends when all is in; results get a folder for each batch.

    A batch that is run again after a failure replaces what it wrote.
    """
    stream = spark.readStream.schema(SCAN)
    stream = (stream.option("maxFilesPerTrigger", files) if files else stream).parquet(folder)

    def batch(rows: DataFrame, number: int) -> None:
        rows.persist()
        try:
            if not rows.isEmpty():
                with_risk(rows, policy).write.mode("overwrite").parquet(f"{results}/batch={number}")
        finally:
            rows.unpersist()

    return compared(stream, delay).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settled(results: DataFrame) -> DataFrame:
    """The last result of each scan."""
    last = results.groupBy("project_id", "scanned_at").agg(F.max_by(F.struct(*[c for c in results.columns if c not in ("project_id", "scanned_at")]), "number").alias("r"))
    return last.select("project_id", "scanned_at", "r.*")
