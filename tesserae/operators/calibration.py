"""Aggregation over dimensions: total entropy, maturity, drift against a baseline, and risk. NULL poisons what it weighs on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.governance import CalibrationProfile, GovernancePolicy
from tesserae.schema import DIMENSIONS, KEY


def total_entropy(values: DataFrame, profile: CalibrationProfile, name: str = "total_entropy") -> DataFrame:
    """values (one column per dimension) with the weighted sum of calibrated dimensions.

    NULL where a dimension with a weight is NULL or missing; weight 0 exempts it. Summed in declared order.
    """
    total, defined = F.lit(0.0), F.lit(True)
    for d in profile.dimensions:
        if not d.weight:
            continue
        column = F.col(d.name) if d.name in values.columns else F.lit(None).cast("double")
        total = total + F.lit(float(d.weight)) * d.calibration.apply(column)
        defined = defined & column.isNotNull()
    return values.withColumn(name, F.when(defined, total))


def maturity(total: Column) -> Column:
    return F.lit(1.0) - total


def maturity_level(m: Column) -> Column:
    """The levels' bounds; 0.90 still belongs to the fourth."""
    level = F.when(m < 0.40, "L0_CHAOTIC").when(m < 0.60, "L1_REACTIVE").when(m < 0.75, "L2_STRUCTURED").when(m <= 0.90, "L3_CONTROLLED").otherwise("L4_OPTIMIZED")
    return F.when(m.isNotNull(), level)


def snapshots(values: DataFrame, fingerprint: str | None, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Wide to tall: (key, dimension, value, governance_fingerprint), in the dimensions' order."""
    rows = F.array(*[F.struct(F.lit(i).alias("dim_ord"), F.lit(d).alias("dimension"), F.col(d).cast("double").alias("value")) for i, d in enumerate(dimensions)])
    return values.select(*KEY, F.explode(rows).alias("d")).select(*KEY, "d.dim_ord", "d.dimension", "d.value", F.lit(fingerprint).cast("string").alias("governance_fingerprint"))


def drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(subject_id, dimension, baseline_value, current_value, delta) where both are defined; positive is worse."""
    b = baseline.where("value is not null").select("subject_id", "dimension", F.col("value").alias("baseline_value"))
    c = current.where("value is not null").select("subject_id", "dimension", F.col("value").alias("current_value"))
    return c.join(b, ["subject_id", "dimension"]).withColumn("delta", F.col("current_value") - F.col("baseline_value"))


def risk(totals: DataFrame, baseline: DataFrame, current: DataFrame, policy: GovernancePolicy) -> DataFrame:
    """(subject_id, value, entropy_term, drift_term, penalties, undefined_because).

    value = total + beta * sum of weight * max(0, delta). It is NULL, with reasons in a fixed order, where the
    policies can't be shown to be the same, nothing was declared, the total is NULL or a weighted dimension can't be
    compared; what penalties there are stay visible. totals has (subject_id, total_entropy).
    """
    one = lambda s, n: s.groupBy("subject_id").agg(F.max("governance_fingerprint").alias(n))
    deltas = drift(baseline, current).groupBy("subject_id").agg(F.map_from_entries(F.collect_list(F.struct("dimension", "delta"))).alias("deltas"))
    rows = totals.select("subject_id", "total_entropy").join(one(baseline, "fp_base"), "subject_id", "left").join(one(current, "fp_now"), "subject_id", "left").join(deltas, "subject_id", "left")
    delta = lambda d: F.try_element_at(F.col("deltas"), F.lit(d))
    reasons = [
        F.when(F.col("fp_base").isNull() | F.col("fp_now").isNull(), F.lit("policy_unrecorded")).when(F.col("fp_base") != F.col("fp_now"), F.lit("policy_differs")),
        F.lit("sensitivity_undeclared") if not policy.drift_weights else F.lit(None).cast("string"),
        F.when(F.col("total_entropy").isNull(), F.lit("total_entropy_undefined")),
    ]
    penalties, total = [], F.lit(0.0)
    for d, w in policy.drift_weights:
        if w:
            reasons.append(F.when(delta(d).isNull(), F.lit(f"not_comparable:{d}")))
        penalty = F.lit(float(w)) * F.greatest(F.lit(0.0), delta(d))
        penalties.append(F.when(delta(d).isNotNull(), F.struct(F.lit(d).alias("dimension"), F.lit(float(w)).alias("weight"), delta(d).alias("delta"), penalty.alias("penalty"))))
        total = total + F.coalesce(F.when(delta(d).isNotNull(), penalty), F.lit(0.0))
    why = F.filter(F.array(*reasons), lambda r: r.isNotNull())
    listed = F.filter(F.array(*penalties), lambda p: p.isNotNull()) if penalties else F.array().cast("array<struct<dimension:string,weight:double,delta:double,penalty:double>>")
    term = F.when(F.size("undefined_because") == 0, F.lit(float(policy.beta or 0.0)) * total)
    rows = rows.withColumn("undefined_because", why).withColumn("penalties", listed).withColumn("drift_term", term)
    return rows.select("subject_id", (F.col("total_entropy") + F.col("drift_term")).alias("value"), F.col("total_entropy").alias("entropy_term"), "drift_term", "penalties", "undefined_because")
