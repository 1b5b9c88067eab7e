"""Report documents: whole, in the fixed key order, streamed and written alike."""

import json

import pytest
from pyspark.sql import functions as F

from tesserae import __main__ as cli
from tesserae.operators import governance
from tesserae.operators.governance import ApprovedException, ExceptionTarget, GovernancePolicy, LayerPolicy, Subsystem, Subsystems
from tesserae.plans import analysis, documents, presets
from tesserae.schema import evidence, graph
from tests.test_graph import JAVA, defect, whole_policy

# The report's keys in their order.
KEYS = [
    "governance", "graph", "roleRefinementPasses", "layerEntropy", "cycleEntropy", "persistenceEntropy", "securityEntropy", "totalEntropy", "maturity", "maturityLevel", "confidence",
    "confidenceByDimension", "exceptionLedger", "invariantAggregate", "invariants", "skippedInvariants", "extractionDiagnostics",
]


def whole_text(doc):
    return "".join(doc.text())


def as_rows(spark, doc):
    return "".join(r["text"] for r in doc.rows(spark).orderBy("piece", "place").collect())


def test_report_of_a_graph(spark):
    target = ExceptionTarget(source_id="p.Controller", target_id="p.Repo", relation="CALL")
    a = analysis.analyse(*defect(spark), whole_policy((ApprovedException(target, "legacy \"x\"\n", "board"), ApprovedException(ExceptionTarget(node_id="gone"), "old", "board"))))
    doc = documents.report(a, "s", "1", spark.createDataFrame([("b.java: unreadable",), ("a.java: unreadable",)], "diagnostic string"))
    text = whole_text(doc)
    assert as_rows(spark, doc) == text
    got = json.loads(text)
    assert list(got) == KEYS
    assert [n["id"] for n in got["graph"]["nodes"]] == ["p.Controller", "p.Repo", "p.Jpa", "p.Impl"] and len(got["graph"]["edges"]) == 5
    assert got["graph"]["edges"][0]["provenance"][0]["executionContext"] == "ITERATED" and got["graph"]["edges"][4]["target"] == {"resolved": False, "description": "driver"}
    assert got["graph"]["nodes"][0]["evidence"][0]["location"] is None and got["graph"]["nodes"][2]["attributes"] == {}
    assert got["layerEntropy"]["relevantEdgeCount"] == 2 and len(got["layerEntropy"]["violatingEdges"]) == 2 and '"relevantEdgeCount":2.0' in text
    assert got["persistenceEntropy"]["value"] == 0.5 and got["persistenceEntropy"]["weightedValue"] == 0.5 and len(got["persistenceEntropy"]["flaggedEdges"]) == 1
    assert got["cycleEntropy"]["relevantSccs"] == [] and got["securityEntropy"] == {"value": None, "opportunityCount": 0, "flaggedCount": 0, "opportunities": [], "flagged": []}
    assert got["exceptionLedger"]["unmatched"] == [{"target": {"kind": "node", "nodeId": "gone"}, "reason": "old", "approvedBy": "board"}]
    assert {e["reason"] for e in got["exceptionLedger"]["excused"]} == {"legacy \"x\"\n"} and {e["dimension"] for e in got["exceptionLedger"]["excused"]} == {"layer", "persistence", "invariant:no_presentation_to_persistence"}
    rule = got["invariants"]["no_presentation_to_persistence"]
    assert rule["holds"] is False and len(rule["violations"]) == 2 and rule["violations"][0]["subject"]["edge"]["target"]["id"] == "p.Repo"
    assert got["invariants"]["entropy_budget"]["violations"] == [{"subject": {"kind": "graph"}, "rationale": "graph violated invariant 'entropy_budget'"}]
    assert got["extractionDiagnostics"] == ["a.java: unreadable", "b.java: unreadable"] and got["confidenceByDimension"]["security"] is None
    assert got["governance"]["layerPolicy"]["knownRoles"][0] == "PRESENTATION" and got["governance"]["subsystems"] == [] and got["governance"]["driftSensitivity"]["beta"] is None


def test_cycles_and_security_in_full(spark):
    weak = evidence("jsp", "unescaped output", attributes={"encoding": "unescaped"})
    nodes = [(f"{p}.{x}", "COMPONENT") for p in ("billing", "shipping") for x in "abcdef"] + [("v.ok", "VIEW", "UNKNOWN", [evidence("jsp", "escaped output")]), ("v.bad", "VIEW", "UNKNOWN", [weak])]
    pairs = [("billing.a", "billing.b"), ("billing.b", "billing.c"), ("billing.c", "billing.a"), ("billing.e", "shipping.f"), ("shipping.f", "billing.e"), ("shipping.a", "shipping.b")]
    base = whole_policy()
    split = Subsystems((Subsystem("billing", "billing.", LayerPolicy(("DOMAIN",), {"DOMAIN": ("DOMAIN",)})), Subsystem("shipping", "shipping."), Subsystem("none", "none.")))
    policy = GovernancePolicy(base.layer_policy, split, False, base.calibration, base.invariants, base.invariant_weights, None, (), ())
    a = analysis.analyse(*graph(spark, nodes, [(s, t, "CALL") for s, t in pairs], "s", "1"), policy)
    doc = documents.report(a, "s", "1")
    got = json.loads(whole_text(doc))
    assert as_rows(spark, doc) == whole_text(doc)
    cycle = got["cycleEntropy"]
    assert cycle["relevantSccs"] == [["billing.a", "billing.b", "billing.c"], ["billing.e", "shipping.f"]] and cycle["participatingNodeCount"] == 5 and cycle["value"] == 5 / 14
    assert [(s["subsystem"], s["value"], s["totalNodeCount"], s["participatingNodes"]) for s in cycle["bySubsystem"]] == [("billing", 4 / 6, 6, ["billing.a", "billing.b", "billing.c", "billing.e"]), ("shipping", 1 / 6, 6, ["shipping.f"]), ("none", None, 0, [])]
    assert [(f["nodeId"], f["weaknessDetected"]) for f in got["securityEntropy"]["opportunities"]] == [("v.ok", False), ("v.bad", True)] and len(got["securityEntropy"]["flagged"]) == 1
    assert got["governance"]["subsystems"][1]["layerPolicy"] is None and got["governance"]["subsystems"][0]["layerPolicy"]["allowedTargets"] == {"DOMAIN": ["DOMAIN"]}
    seen = json.loads(whole_text(documents.view(a, "s", "1")))
    assert [f["subject"] for f in seen["findings"] if f["dimension"] == "cycle"] == [None, None]
    assert seen["unanswered"] == [documents.NOT_COMPARED, documents.NO_RISK, documents.UNADDRESSED.format(2)]


def test_view_with_and_without_a_baseline(spark):
    target = ExceptionTarget(source_id="p.Controller", target_id="p.Repo", relation="CALL")
    policy = whole_policy((ApprovedException(target, "legacy", "board"),), beta=2.0, drifts=(("layer", 1.0), ("cycle", 0.5), ("security", 1.5)))
    a = analysis.analyse(*defect(spark), policy)
    alone = json.loads(whole_text(documents.view(a, "s", "1")))
    assert list(alone) == ["subjectId", "governanceFingerprint", "observed", "changed", "violated", "risk", "findings", "unanswered"] and alone["changed"] is None and alone["risk"] is None
    assert len(alone["findings"]) == 3 and all(f["excused"] and f["excusedBy"]["approvedBy"] == "board" for f in alone["findings"])
    limits = {c["invariantName"]: c for c in alone["violated"]["constraints"]}
    assert list(limits) == ["no_presentation_to_persistence", "entropy_budget"] and len(limits["no_presentation_to_persistence"]["violations"]) == 2 and limits["entropy_budget"]["violations"][0]["subject"] is None
    base = spark.createDataFrame([("s", "0", d, v, None) for d, v in (("layer", 0.6), ("cycle", 0.0))], "subject_id string, scan_id string, dimension string, value double, governance_fingerprint string")
    doc = documents.view(a, "s", "1", base)
    got = json.loads(whole_text(doc))
    assert as_rows(spark, doc) == whole_text(doc)
    assert got["changed"]["drift"]["layer"] == {"baselineValue": 0.6, "currentValue": 1.0, "delta": 0.4} and [p["dimension"] for p in got["risk"]["penalties"]] == ["layer", "cycle"]
    why = [documents.REASONS["policy_unrecorded"], documents.REASONS["not_comparable"].format("security", "1.5")]
    assert got["risk"]["undefinedBecause"] == why and got["unanswered"] == [documents.RISK.format(w) for w in why]


def test_strings_escape_like_the_writer(spark):
    texts = ['a"b\\c', "tab\tnl\ncr\rbs\bff\f", "\x01\x1f é /", "", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["j"] for r in d.orderBy("i").select(documents.json_string(F.col("t")).alias("j")).collect()]
    from tesserae.functions.javatext import json_text

    assert got == [json_text(t) for t in texts] and [json.loads(g) for g in got] == texts


def test_command_line(spark, tmp_path, capsys):
    for name, text in JAVA.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "Bytes.java").write_bytes(b"class X { \xff\xfe }")
    assert cli.main([]) == 2
    assert cli.main([str(tmp_path), "lib.jar"]) == 0
    text = capsys.readouterr().out
    got = json.loads(text)
    assert list(got) == KEYS and len(got["extractionDiagnostics"]) == 1 and "com.shop.Shop" in [n["id"] for n in got["graph"]["nodes"]]
    assert got["governance"]["calibration"][3] == {"dimension": "security", "weight": 0.0, "function": "linear"}
    assert cli.main([str(tmp_path), "--write", str(tmp_path / "out")]) == 0
    files = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-"))
    assert json.loads("".join(p.read_text() for p in files)) == got


def test_declaration_lists_exceptions_and_weights():
    p = presets.drifting()
    got = documents.governance(p)
    assert list(got) == ["layerPolicy", "subsystems", "includeSelfCyclesInCycleEntropy", "calibration", "invariants", "invariantWeights", "driftSensitivity", "approvedExceptions"]
    assert got["driftSensitivity"] == {"beta": 2.0, "dimensionWeights": {"layer": 1.0, "cycle": 0.5, "persistence": 1.0}} and got["invariants"][1]["referencedMetrics"] == ["total_entropy"]
    assert pytest.approx(1.0) == sum(d["weight"] for d in got["calibration"]) and governance.GovernancePolicy is type(p)
