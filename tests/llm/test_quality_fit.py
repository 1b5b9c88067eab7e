"""The classifier learns from every labelled row, whatever the partitions."""

import numpy as np
from pyspark.sql import functions as F

from tesserae.llm import quality_model as q


def rows(spark, n, seed=1):
    r = np.random.default_rng(seed)
    label = r.random(n) < 0.1
    x = r.normal(size=(n, len(q.FEATURES))) + 0.8 * label[:, None] * (np.arange(len(q.FEATURES)) < 3)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "doc_id long, " + ", ".join(f"{f} double" for f in q.FEATURES))
    return df, spark.createDataFrame([(i, int(not v)) for i, v in enumerate(label)], "doc_id long, quality int"), ~label


def test_every_labelled_row_is_paired(spark, monkeypatch):
    """25,000 rows, more than were learned from before; each row's own mark comes back in the differences."""
    monkeypatch.setattr(q, "PAIRS", 1)
    n = 25_000
    marks = spark.range(n).select(F.when(F.col("id") % 500 == 0, 0).otherwise(1).alias("label"), *[(F.when(F.col("id") % 500 == 0, 0).otherwise(F.col("id")) if i == 0 else F.when(F.col("id") % 500 == 0, -F.col("id") - 1).otherwise(0) if i == 1 else F.lit(0)).cast("double").alias(f) for i, f in enumerate(q.FEATURES)], F.lit(1).alias("weight"), F.xxhash64("id").alias("h"))
    found = [q.paired(marks.repartition(k), n // 500, n - n // 500).select(*q.FEATURES[:2]).collect() for k in (1, 7)]
    assert {int(r[0]) for r in found[0]} == {i for i in range(n) if i % 500} and {int(r[1]) - 1 for r in found[0]} == {i for i in range(n) if i % 500 == 0}
    assert sorted(map(tuple, found[0])) == sorted(map(tuple, found[1]))


def test_the_model_is_the_same_for_any_partitions_and_cuts_at_the_share(spark):
    df, y, good = rows(spark, 6000)
    a, b = (q.fit(df.repartition(k), y.repartition(k)) for k in (1, 5))
    assert np.allclose(a["weights"], b["weights"], rtol=1e-8, atol=1e-8) and abs(a["bias"] - b["bias"]) < 1e-6
    assert df.where(q.score(a) >= q.THRESHOLD).count() == good.sum()


def test_at_rank(spark):
    values = spark.range(3000).select((F.pmod("id", F.lit(7)) * F.pmod("id", F.lit(13)) / 3).alias("v"), (F.pmod("id", F.lit(3)) + 1).alias("w"))
    want = sorted(x for r in values.collect() for x in [r["v"]] * r["w"])
    for rank in (0, 17, 2999, len(want) - 1):
        assert q.at_rank(values, "v", "w", rank, near=5) == want[rank]
