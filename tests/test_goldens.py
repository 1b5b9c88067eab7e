"""Published results of the example runs, on graphs made to have the same counts."""

import json

import pytest
from pyspark.sql import functions as F

from tesserae.operators import calibration, governance, metrics, roles
from tesserae.operators.governance import ApprovedException, CalibrationProfile, CustomCalibration, ExceptionTarget, GovernancePolicy, LayerPolicy, Subsystem, Subsystems, WeightedDimension
from tesserae.plans import analysis, documents, presets
from tesserae.schema import evidence, graph
from tesserae.sources import scans
from tests.test_graph import CONTROLLER, DATA, SERVICE, one

ORDER = ("PRESENTATION", "APPLICATION", "DOMAIN", "PERSISTENCE", "INFRASTRUCTURE")


def clinic(spark):
    """21 relevant edges, 14 of them from presentation to persistence, three of these in vet."""
    nodes = [(f"owner.C{i}", "COMPONENT", "UNKNOWN", [CONTROLLER]) for i in range(11)] + [(f"vet.C{i}", "COMPONENT", "UNKNOWN", [CONTROLLER]) for i in range(3)]
    nodes += [(f"repo.R{i}", "COMPONENT", "UNKNOWN", [DATA]) for i in range(14)] + [("svc.S", "COMPONENT", "UNKNOWN", [SERVICE])]
    edges = [(n[0], f"repo.R{i}", "CALL") for i, n in enumerate(nodes[:14])] + [(f"owner.C{i}", "svc.S", "CALL") for i in range(7)]
    return graph(spark, nodes, edges, "clinic", "1")


def declared(weights=(), subsystems=None, beta=None, drifts=(), exceptions=()):
    p = presets.illustrative()
    return GovernancePolicy(p.layer_policy, subsystems or Subsystems(), False, p.calibration, p.invariants, weights, beta, drifts, exceptions)


def test_published_entropies_weights_risk_and_exceptions(spark):
    target = ExceptionTarget(source_id="owner.C0", target_id="repo.R0", relation="CALL")
    weights = (("no_presentation_to_persistence", 1.0), ("entropy_budget", 4.0))
    policy = declared(weights, beta=2.0, drifts=(("layer", 1.0), ("cycle", 0.5), ("persistence", 1.0)), exceptions=(ApprovedException(target, "legacy", "board"),))
    a = analysis.analyse(*clinic(spark), policy)
    v = one(a.values)
    assert (v["layer"], v["persistence"], v["cycle"], v["level"]) == (14 / 21, 0.0, 0.0, "L3_CONTROLLED")
    assert v["total_entropy"] == 0.2222222222222222 and v["maturity"] == pytest.approx(0.7778, abs=5e-5)
    assert one(a.aggregate)["value"] == 1.0  # only the first is violated
    base = spark.createDataFrame([("clinic", "0", d, x, policy.fingerprint()) for d, x in (("layer", 0.4), ("cycle", 0.0), ("persistence", 0.1))], "subject_id string, scan_id string, dimension string, value double, governance_fingerprint string")
    r = one(calibration.risk(a.values, base, a.snapshots(), policy))
    assert r["value"] == pytest.approx(0.7555555555555554, rel=1e-12) and r["drift_term"] == pytest.approx(0.5333333333333332, rel=1e-12)
    found = analysis.findings(a).where("dimension = 'layer'")
    assert found.count() == 14 and analysis.unexcused(found).count() == 13
    relaxed = LayerPolicy(ORDER, {r: ORDER for r in ORDER})
    vet = analysis.analyse(*clinic(spark), declared(subsystems=Subsystems((Subsystem("vet", "vet.", relaxed),))))
    w = one(vet.values)
    assert w["layer"] == 11 / 21 and w["total_entropy"] == pytest.approx(0.175, abs=5e-4) and w["maturity"] == pytest.approx(0.825, abs=5e-4)


def test_catalogs_and_calibrations_of_ones_own(spark):
    square = CustomCalibration("square", lambda e: e * e)
    profile = CalibrationProfile((WeightedDimension("layer", 1.0, square),))
    p = declared()
    p = GovernancePolicy(p.layer_policy, p.subsystems, False, profile, (), (), None, (), ())
    none = analysis.DetectionCatalog((), (), ())
    assert one(analysis.analyse(*clinic(spark), p).values)["total_entropy"] == pytest.approx((14 / 21) ** 2)
    assert "layer=1.0:square" in p.canonical()
    bare = analysis.analyse(*clinic(spark), p, none)
    assert one(bare.values)["layer"] is None and {r["role"] for r in bare.nodes.select("role").distinct().collect()} == {"UNKNOWN"}
    with pytest.raises(ValueError):
        analysis.DetectionCatalog((roles.SEED_RULES[0], roles.SEED_RULES[0]), (), ())
    with pytest.raises(ValueError):
        analysis.DetectionCatalog((), ("rule",), ())
    with pytest.raises(ValueError):
        WeightedDimension("layer", 1.0, "linear")
    assert [r.name for r in metrics.SECURITY_RULES] == [r.name for r in analysis.ILLUSTRATIVE.security_rules] and governance.Calibration().name() == "linear"


def test_reports_become_scans(spark, tmp_path):
    a = analysis.analyse(*clinic(spark), declared())
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "good.json").write_text("".join(documents.report(a, "clinic", "1").text()))
    (tmp_path / "in" / "bad.json").write_text("{ not a report")
    (tmp_path / "in" / "other.json").write_text(json.dumps({"graph": {"nodes": []}}))
    reports = scans.read_reports(spark, str(tmp_path / "in"))
    at = str(tmp_path / "db")
    with pytest.raises(ValueError):
        scans.push(reports, "clinic", at)  # the project isn't known
    scans.put_project(spark, at, "clinic", "Clinic")
    gone = scans.push(reports, "clinic", at)
    scans.push(reports, "clinic", at)  # once more, which changes nothing
    assert sorted(r["path"].rsplit("/", 1)[1] for r in gone.collect()) == ["bad.json", "other.json"]
    table = scans.scan_table(at).read(spark)
    assert sorted(table.columns) == sorted(c.split()[0] for c in scans.SCANS.split(", "))
    row = one(table)
    assert (row["project_id"], row["node_count"], row["edge_count"], row["role_refinement_passes"], row["invariant_violation_count"], row["skipped_invariants"]) == ("clinic", 29, 21, 0, 1, [])
    assert row["total_entropy"] == 0.2222222222222222 and row["maturity_level"] == "L3_CONTROLLED" and row["security_entropy"] is None and row["confidence"] == 1.0
    assert [f.name for f in spark.createDataFrame([], scans.PROJECTS).schema] == ["id", "name", "repo_url", "created_at"]
    assert evidence("x", "y").location is None and table.where(F.col("report").contains("roleRefinementPasses")).count() == 1
