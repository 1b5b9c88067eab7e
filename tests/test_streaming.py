"""Scans through the stream against pairs made in plain Python: out of order, repeated, late, and over a restart."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tesserae.plans import presets
from tesserae.streaming import drift

POLICY = presets.drifting()
DAY = dt.datetime(2026, 1, 1)


def scan(project, day, *values, print_=POLICY.fingerprint()):
    return (project, None if day is None else DAY + dt.timedelta(days=day), print_, 0.25, *values)


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, drift.SCAN).coalesce(1).write.mode("append").parquet(str(folder))


def results(spark, tmp_path, delay, **options):
    query = drift.follow(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), POLICY, delay, **options)
    query.awaitTermination()
    assert query.exception() is None
    return spark.read.parquet(str(tmp_path / "out/*"))


def plain(rows):
    """(project, day) -> (day of the baseline, delta of each dimension), over all scans in their order."""
    out = {}
    for p in {r[0] for r in rows}:
        mine = sorted({r[1]: r for r in reversed(rows) if r[0] == p}.values(), key=lambda r: r[1])
        for a, b in zip([None, *mine], mine):
            out[(p, b[1])] = (a and a[1], {} if a is None else {d: b[4 + i] - a[4 + i] for i, d in enumerate(("layer", "cycle", "persistence", "security")) if None not in (a[4 + i], b[4 + i])})
    return out


def test_any_order_and_a_restart(spark, tmp_path):
    lots = [
        [scan("a", 5, 0.5, 0.1, 0.2, None), scan("b", 1, 0.0, 0.0, 0.0, 0.0), scan(None, 1, 0.0, 0.0, 0.0, 0.0), scan("a", None, 0.0, 0.0, 0.0, 0.0)],
        [scan("a", 9, 0.25, 0.3, None, 0.5), scan("a", 2, 0.75, 0.0, 0.5, 0.5), scan("a", 5, 9.0, 9.0, 9.0, 9.0)],
        [scan("b", 3, 0.5, 0.5, 0.5, 0.5, print_="other"), scan("a", 7, 0.5, 0.0, 0.0, 0.0), scan("a", 3, 0.5, 0.0, 0.0, 0.0)],
    ]
    for lot in lots[:2]:
        arrive(spark, tmp_path / "in", lot)
    first = results(spark, tmp_path, "100 days", files=1)
    assert first.where("late").count() == 0 and first.groupBy("project_id", "number").count().where("count > 1").count() == 0
    arrive(spark, tmp_path / "in", lots[2])
    found = results(spark, tmp_path, "100 days", files=1)  # the state is where the first run left it
    got = {(r["project_id"], r["scanned_at"]): r for r in drift.settled(found).collect()}
    want = plain([r for lot in lots for r in lot if r[0] and r[1]])
    assert set(got) == set(want)
    for k, (base, deltas) in want.items():
        assert got[k]["baseline_at"] == base and (got[k]["deltas"] or {}) == pytest.approx(deltas)
    risky = got[("a", DAY + dt.timedelta(days=3))]
    assert risky["undefined_because"] == [] and risky["drift_term"] == 0.0 and risky["risk"] == 0.25
    assert got[("b", DAY + dt.timedelta(days=3))]["undefined_because"] == ["policy_differs"]
    assert got[("b", DAY + dt.timedelta(days=1))]["undefined_because"][0] == "policy_unrecorded"
    assert got[("a", DAY + dt.timedelta(days=9))]["undefined_because"] == ["not_comparable:persistence"]


def test_what_is_older_than_the_watermark_is_late(spark, tmp_path):
    one = (0.5, 0.5, 0.5, 0.5)
    for lot in ([scan("a", 50, *one), scan("a", 60, *one)], [scan("a", 61, *one), scan("b", 100, *one)], [scan("a", 102, *one)], [scan("a", 20, *one), scan("a", 99, *one)]):
        arrive(spark, tmp_path / "in", lot)
    found = results(spark, tmp_path, "10 days", files=1)
    late = found.where("late").select(F.datediff("scanned_at", F.lit(DAY)).alias("day"), "baseline_at").collect()
    assert [tuple(r) for r in late] == [(20, None)]
    got = {r["day"]: r["base"] for r in drift.settled(found).where("not late and project_id = 'a'").select(F.datediff("scanned_at", F.lit(DAY)).alias("day"), F.datediff("baseline_at", F.lit(DAY)).alias("base")).collect()}
    assert got == {50: None, 60: 50, 61: 60, 99: 61, 102: 99}
