"""The graph operators on small graphs with known values, and under reordering."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tesserae.functions.javatext import double_text, json_text
from tesserae.operators import calibration, cycles, governance, invariants, metrics, roles
from tesserae.operators.governance import ApprovedException, Calibration, CalibrationProfile, ExceptionTarget, GovernancePolicy, LayerPolicy, Subsystem, Subsystems, WeightedDimension
from tesserae.plans import analysis, presets
from tesserae.schema import checked, dangling, edges_from, edges_to, evidence, graph, node
from tesserae.sources import facts, java, scans

P, A, D, S = "PRESENTATION", "APPLICATION", "DOMAIN", "PERSISTENCE"
CONTROLLER = evidence("spring", "@Controller annotation")
SERVICE = evidence("spring", "@Service annotation")
DATA = evidence("spring-data", "Repository interface")
LOOP = evidence("java", "call", execution_context="ITERATED")
POLICY = LayerPolicy((P, A, D, S, "INFRASTRUCTURE"), {P: (P, A), A: (A, D, S), D: (D, S), S: (S, "INFRASTRUCTURE"), "INFRASTRUCTURE": ("INFRASTRUCTURE",)})
SMALL = LayerPolicy((P, A, S), {P: (P, A), A: (A, S), S: (S,)})


def layered(spark):
    nodes = [("web.C", "COMPONENT", P, [CONTROLLER]), ("service.S", "COMPONENT", A, [SERVICE]), ("domain.O", "DATA", D), ("repo.R", "COMPONENT", S, [DATA])]
    edges = [("web.C", "service.S", "CALL"), ("service.S", "domain.O", "DEPENDS"), ("service.S", "repo.R", "CALL"), ("web.C", "repo.R", "CALL"), ("repo.R", ("unresolved", "external source"), "COMMUNICATES")]
    return graph(spark, nodes, edges)


def one(df):
    return df.first().asDict()


def test_layered_slice(spark):
    n, e = layered(spark)
    r = one(metrics.layer_entropy(n, e, POLICY))
    assert (r["relevant"], r["violating"], r["value"]) == (4, 1, 0.25)
    assert one(metrics.confidence(n, e))["value"] == 0.8
    r = one(metrics.persistence_entropy(n, e))
    assert (r["relevant"], r["flagged"], r["value"]) == (2, 0, 0.0)
    assert one(cycles.cycle_entropy(cycles.components(n, e)))["value"] == 0.0
    found = invariants.violations([invariants.no_presentation_to_persistence()], n, e).collect()
    assert [(v["source_id"], v["target_id"]) for v in found] == [("web.C", "repo.R")]
    assert {r["id"]: r["role"] for r in roles.seeded(n).collect()} == {"web.C": P, "service.S": A, "domain.O": D, "repo.R": S}
    checked(n, e)[0].count()
    assert dangling(n, e).isEmpty() and node(n, "web.C").count() == 1 and edges_from(e, "web.C").count() == 2 and edges_to(e, "repo.R").count() == 2


def test_undefined_is_not_zero(spark):
    n, e = graph(spark, [("a", "MODULE")], [])
    assert one(metrics.layer_entropy(n, e, POLICY))["value"] is None and one(metrics.persistence_entropy(n, e))["value"] is None
    assert one(metrics.security_entropy(n))["value"] is None and one(metrics.confidence(n, e))["value"] is None
    assert one(cycles.cycle_entropy(cycles.components(n, e)))["value"] == 0.0
    empty = graph(spark, [], [])
    assert cycles.cycle_entropy(cycles.components(*empty)).collect() == []


def test_bad_graphs_are_refused(spark):
    with pytest.raises(ValueError):
        graph(spark, [("a", "MODULE")], [("a", "b", "CALL")])
    with pytest.raises(ValueError):
        graph(spark, [("a", "NO_TYPE")], [])
    n, _ = graph(spark, [("a", "MODULE", P), ("a", "DATA", A)], [])
    assert [(r["id"], r["type"]) for r in n.collect()] == [("a", "DATA")]


def test_four_dimensions(spark):
    view = evidence("jsp", "renders ${order.notes} as unescaped output")
    n, e = graph(spark, [("c", "COMPONENT", P), ("s", "COMPONENT", A), ("r", "COMPONENT", S), ("v", "VIEW", P, [view])], [("c", "s", "CALL"), ("s", "r", "CALL", [LOOP]), ("c", "r", "CALL")])
    values = [one(metrics.layer_entropy(n, e, SMALL))["value"], one(cycles.cycle_entropy(cycles.components(n, e)))["value"], one(metrics.persistence_entropy(n, e))["value"], one(metrics.security_entropy(n))["value"]]
    assert values == [1 / 3, 0.0, 0.5, 1.0]
    row = spark.createDataFrame([("s", "x", *values)], "subject_id string, scan_id string, layer double, cycle double, persistence double, security double")
    quarters = CalibrationProfile(tuple(WeightedDimension(d, 0.25) for d in ("layer", "cycle", "persistence", "security")))
    total = one(calibration.total_entropy(row, quarters))["total_entropy"]
    assert total == pytest.approx(0.25 / 3 + 0.125 + 0.25)
    assert one(row.select(calibration.maturity_level(F.lit(1 - total)).alias("l")))["l"] == "L1_REACTIVE"
    poisoned = row.withColumn("security", F.lit(None).cast("double"))
    assert one(calibration.total_entropy(poisoned, quarters))["total_entropy"] is None
    assert one(calibration.total_entropy(poisoned, presets.THIRDS))["total_entropy"] is not None


def test_escaped_and_unescaped(spark):
    cases = {"escaped output": False, "unescaped output": True, "nothing": None}
    n, _ = graph(spark, [(k, "VIEW", "UNKNOWN", [evidence("jsp", k)]) for k in cases] + [("x", "DATA", "UNKNOWN", [evidence("jsp", "unescaped output")]), ("y", "VIEW", "UNKNOWN", [evidence("jsp", "z", attributes={"encoding": "escaped"}), evidence("jsp", "unescaped output")])], [])
    got = {r["id"]: r["weak"] for r in metrics.security_findings(n).collect()}
    assert got == {"escaped output": False, "unescaped output": True, "y": False}
    with pytest.raises(ValueError):
        metrics.SecurityRule("r", "Not_Canonical", lambda: F.lit(True))


def test_refinement_passes_and_precedence(spark):
    n, e = graph(spark, [("A", "COMPONENT"), ("B", "COMPONENT"), ("C", "COMPONENT", "UNKNOWN", [DATA]), ("X", "COMPONENT"), ("W", "COMPONENT", "UNKNOWN", [CONTROLLER]), ("L1", "COMPONENT"), ("L2", "COMPONENT")], [("A", "B", "EXTENDS"), ("B", "C", "EXTENDS"), ("X", "W", "IMPLEMENTS"), ("X", "C", "IMPLEMENTS"), ("L1", "L2", "EXTENDS"), ("L2", "L1", "EXTENDS")])
    out, passes = roles.refined(n, e)
    got = {r["id"]: (r["role"], r["pass"]) for r in out.collect()}
    assert got == {"A": (S, 2), "B": (S, 1), "C": (S, 0), "X": (S, 1), "W": (P, 0), "L1": ("UNKNOWN", 0), "L2": ("UNKNOWN", 0)}
    assert one(passes)["passes"] == 2
    assert len(out.where("id = 'X'").first()["signals"]) == 2


def closure(nodes, edges):
    reach = {a: {a} for a in nodes}
    for _ in nodes:
        for a, b in edges:
            for v in nodes:
                if a in reach[v]:
                    reach[v].add(b)
    return {a: min(b for b in nodes if b in reach[a] and a in reach[b]) for a in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components_against_closure(spark, seed):
    r = random.Random(seed)
    names = [f"n{i:02d}" for i in range(25)]
    pairs = [(r.choice(names), r.choice(names)) for _ in range(34)] + [("n01", "n01"), ("n02", "n03"), ("n02", "n03")]
    n, e = graph(spark, [(x, "COMPONENT") for x in names], [(a, b, r.choice(["CALL", "DEPENDS"])) for a, b in pairs])
    want = closure(names, pairs)
    for limit in (cycles.GROUPED_EDGES, 0):  # one task per graph, then distributed
        got = {x["id"]: x["scc"] for x in cycles.components(n, e, grouped_edges=limit).collect()}
        assert got == want


def test_long_chains_and_self_loops(spark):
    chain = [(f"{i:06d}", f"{i + 1:06d}") for i in range(200_000)]
    assert len(set(cycles.tarjan(chain).values())) == 200_001
    assert len(set(cycles.tarjan(chain + [("200000", "000000")]).values())) == 1
    n, e = graph(spark, [("a", "COMPONENT"), ("b", "COMPONENT"), ("c", "COMPONENT")], [("a", "b", "CALL"), ("b", "a", "DEPENDS"), ("c", "c", "CALL"), ("a", "b", "CALL")])
    comps = cycles.components(n, e)
    assert one(cycles.cycle_entropy(comps))["value"] == 2 / 3 and one(cycles.cycle_entropy(comps, True))["value"] == 1.0
    assert [r["id"] for r in cycles.self_loops(e).collect()] == ["c"]


def test_cycles_by_subsystem(spark):
    names = ["billing.Invoice", "billing.LineItem", "billing.Ledger", "shipping.Crate", "shipping.Label", "shared.Clock"]
    nodes = [(x, "COMPONENT") for x in names] + [(f"{x}#m()", "FUNCTION") for x in names]
    pairs = [("billing.Invoice", "billing.LineItem"), ("billing.LineItem", "billing.Invoice"), ("billing.Ledger", "shipping.Crate"), ("shipping.Crate", "billing.Ledger")]
    n, e = graph(spark, nodes, [(a, b, "DEPENDS") for a, b in pairs])
    comps = cycles.components(n, e)
    r = one(cycles.cycle_entropy(comps))
    assert (r["participating"], r["nodes"], r["cycles"]) == (4, 12, 2)
    subs = Subsystems((Subsystem("billing", "billing."), Subsystem("shipping", "shipping."), Subsystem("warehouse", "warehouse.")))
    got = {r["subsystem"]: (r["participating"], r["claimed"], r["value"]) for r in cycles.cycle_by_subsystem(comps, subs).collect()}
    assert got == {"billing": (3, 6, 0.5), "shipping": (1, 4, 0.25), "warehouse": (0, 0, None)}


def test_persistence_weighting(spark):
    nodes = [("a", "FUNCTION", A), ("b", "FUNCTION", A), ("r", "FUNCTION", S)]
    n, e = graph(spark, nodes, [("a", "r", "CALL", [LOOP, LOOP]), ("b", "r", "CALL", [LOOP]), ("a", "r", "CALL")])
    r = one(metrics.persistence_entropy(n, e))
    assert (r["value"], r["weighted"]) == (2 / 3, 1.0)
    n, e = graph(spark, nodes, [("a", "r", "CALL", [LOOP] * 3)])
    assert one(metrics.persistence_entropy(n, e))["weighted"] == 3.0


def test_source_subsystem_judges(spark):
    n, e = graph(spark, [("vet.C", "COMPONENT", P), ("own.C", "COMPONENT", P), ("own.R", "COMPONENT", S)], [("vet.C", "own.R", "CALL"), ("own.C", "own.R", "CALL"), ("own.R", "vet.C", "CALL")])
    relaxed = LayerPolicy((P, S), {P: (P, S), S: (S,)})
    subs = Subsystems((Subsystem("vet", "vet.", relaxed), Subsystem("own", "own.")))
    got = {(r["src_id"], r["dst_id"]): (r["governed_by"], r["violating"]) for r in metrics.layer_edges(n, e, SMALL, subs).collect()}
    assert got == {("vet.C", "own.R"): ("vet", False), ("own.C", "own.R"): (None, True), ("own.R", "vet.C"): (None, True)}
    with pytest.raises(ValueError):
        Subsystems((Subsystem("a", "com.a"), Subsystem("b", "com.a.b")))


def test_assembly_ignores_order_and_refuses_conflicts(spark):
    ev = [evidence("java", "x", attributes={"k": "v"}), evidence("java", "a")]
    nf = [("s", "c", "p.A", "COMPONENT", {"x": "1"}, [ev[0]]), ("s", "c", "p.A", "COMPONENT", {"y": "2", "x": "1"}, [ev[1]]), ("s", "c", "p.B", "DATA", {}, [])]
    ef = [("s", "c", "p.A", "A", "p.B", "B", "DEPENDS", [ev[0]]), ("s", "c", "p.A", "A", "p.B", "B", "DEPENDS", [ev[0]]), ("s", "c", "q", "Q as written", "p.A", "A", "CALL", None), ("s", "c", "p.B", "B", "z", "Z as written", "CALL", [])]
    seen = set()
    for seed in range(3):
        random.Random(seed).shuffle(nf)
        random.Random(seed + 7).shuffle(ef)
        n, e = facts.assemble(facts.node_facts(spark, nf).repartition(seed + 1), facts.edge_facts(spark, ef))
        rows = [tuple(map(str, r)) for r in n.orderBy("node_seq").select("id", "type", "attributes", "evidence").collect()]
        lines = [tuple(map(str, r)) for r in e.orderBy("edge_seq").select("src_id", "src_desc", "dst_id", "dst_desc", "relation", "provenance").collect()]
        seen.add((tuple(rows), tuple(lines)))
    assert len(seen) == 1 and len(rows) == 2 and len(lines) == 4
    assert ("None", "Q as written", "p.A", "None") in [x[:4] for x in lines] and ("p.B", "None", "None", "Z as written") in [x[:4] for x in lines]
    for bad in (("s", "c", "p.B", "MODULE", {}, []), ("s", "c", "p.A", "COMPONENT", {"x": "other"}, [])):
        with pytest.raises(Exception, match="facts differ"):
            facts.merged_nodes(facts.node_facts(spark, [*nf, bad])).collect()


def test_predicates_are_typed_and_scoped(spark):
    i = invariants
    with pytest.raises(ValueError):
        i.Invariant("x", "NODE", i.always(True), i.eq(i.prop("source_role"), i.role(P)))
    with pytest.raises(ValueError):
        i.and_()
    m = i.literal_metrics(spark, [("s", "c", 1.0)], ["m"])
    n, e = graph(spark, [("a", "DATA", P), ("b", "DATA", A)], [], "s", "c")
    holds = lambda p, scope="GRAPH": i.violations([i.Invariant("x", scope, i.always(True), p)], n, e, m).isEmpty()
    assert not holds(i.eq(i.metric("m"), i.value(1))) and holds(i.eq(i.metric("m"), i.value(1.0))) and holds(i.lte(i.metric("m"), i.value(1)))
    assert holds(i.or_(i.gt(i.metric("m"), i.value(2)), i.not_(i.lt(i.metric("m"), i.value(1.0))))) and holds(i.gte(i.metric("m"), i.value(0.5)))
    assert not holds(i.eq(i.prop("role"), i.value(P)), "NODE") and holds(i.in_(i.prop("role"), i.role(P), i.role(A)), "NODE") and not holds(i.in_(i.prop("role")), "NODE")
    got = i.violations([i.Invariant("x", "NODE", i.eq(i.prop("type"), i.value("DATA", "type")), i.eq(i.prop("role"), i.role(P)))], n, e).collect()
    assert [v["node_id"] for v in got] == ["b"]


def whole_policy(exceptions=(), beta=None, drifts=()):
    return GovernancePolicy(SMALL, Subsystems(), False, presets.THIRDS, (invariants.no_presentation_to_persistence(), invariants.entropy_budget(0.35)), (("no_presentation_to_persistence", 4.0), ("entropy_budget", 3.0)), beta, drifts, exceptions)


def defect(spark, subject="s"):
    """A controller that calls a repository in a loop; two classes inherit the repository's role."""
    nodes = [("p.Controller", "COMPONENT", "UNKNOWN", [CONTROLLER]), ("p.Repo", "COMPONENT", "UNKNOWN", [DATA]), ("p.Jpa", "COMPONENT"), ("p.Impl", "COMPONENT")]
    edges = [("p.Controller", "p.Repo", "CALL", [LOOP]), ("p.Controller", "p.Repo", "CALL"), ("p.Jpa", "p.Repo", "EXTENDS"), ("p.Impl", "p.Jpa", "EXTENDS"), ("p.Impl", ("unresolved", "driver"), "CALL")]
    return graph(spark, nodes, edges, subject, "1")


def test_analysis_end_to_end(spark):
    target = ExceptionTarget(source_id="p.Controller", target_id="p.Repo", relation="CALL")
    exceptions = (ApprovedException(target, "legacy", "board"), ApprovedException(ExceptionTarget(node_id="gone"), "old", "board"))
    a = analysis.analyse(*defect(spark), whole_policy(exceptions))
    v = one(a.values)
    assert (v["layer"], v["cycle"], v["persistence"], v["security"]) == (1.0, 0.0, 0.5, None)
    assert v["total_entropy"] == pytest.approx(0.5) and v["level"] == "L1_REACTIVE" and one(a.passes)["passes"] == 2
    assert one(a.aggregate)["value"] == 7.0 and one(a.confidence)["value"] == 0.8
    assert {(r["dimension"]): 0 for r in a.excused.collect()}.keys() == {"layer", "persistence", "invariant:no_presentation_to_persistence"}
    assert [r["reason"] for r in a.unmatched.collect()] == ["old"]
    f = analysis.findings(a)
    assert f.count() == 3 and analysis.unexcused(f).count() == 0
    plain = analysis.analyse(*defect(spark), whole_policy())
    assert one(plain.values)["total_entropy"] == v["total_entropy"] and analysis.unexcused(analysis.findings(plain)).count() == 3
    assert {r["question"] for r in analysis.unanswered(a).collect()} == {"dimension:security"}
    text = analysis.report_json(a, "s", "1")
    assert '"totalEntropy":0.5,' in text.replace("0.49999999999999994", "0.5") and '"passes":2.0' in text and '"skippedInvariants":[]' in text
    row = one(analysis.scan_rows(a))
    assert (row["node_count"], row["edge_count"], row["invariant_violation_count"]) == (4, 5, 2)
    view = analysis.view(a, "s", "1")
    assert view["changed"] is None and view["risk"] is None and view["observed"]["layer"]["findings"] == 2
    n, e = analysis.graph_json(a.nodes, a.edges)
    assert '"location":null' in n.where("json like '%p.Repo%'").first()["json"] and e.where("json like '%driver%'").count() == 1


def test_many_graphs_at_once(spark):
    one_, two = defect(spark, "s1"), layered(spark)
    a = analysis.analyse(one_[0].unionByName(two[0]), one_[1].unionByName(two[1]), whole_policy())
    got = {r["subject_id"]: r["layer"] for r in a.values.collect()}
    assert got["s1"] == 1.0 and got["subject"] == 1 / 3
    assert {r["subject_id"]: r["passes"] for r in a.passes.collect()} == {"s1": 2, "subject": 0}


def test_skipped_invariants_undefine_the_aggregate(spark):
    strict = CalibrationProfile((WeightedDimension("layer", 0.5), WeightedDimension("security", 0.5)))
    p = whole_policy()
    p = GovernancePolicy(p.layer_policy, p.subsystems, False, strict, p.invariants, p.invariant_weights, None, (), ())
    a = analysis.analyse(*defect(spark), p)
    r = one(a.aggregate)
    assert r["value"] is None and r["unevaluated"] == ["entropy_budget"] and r["contributions"][0]["contribution"] == 4.0
    assert invariants.skipped(a.results).first()["skipped"] == ["entropy_budget"]
    with pytest.raises(ValueError):
        invariants.weighted(a.results, (("entropy_budget", 1.0),), [i.name for i in p.invariants])
    assert one(invariants.weighted(a.results, (), []))["value"] is None


def test_drift_and_risk(spark):
    policy = whole_policy(beta=2.0, drifts=(("layer", 1.0), ("cycle", 0.5), ("persistence", 1.0)))
    a = analysis.analyse(*defect(spark), policy)
    fp = policy.fingerprint()
    base = lambda fp, rows: spark.createDataFrame([("s", "0", d, v, fp) for d, v in rows], "subject_id string, scan_id string, dimension string, value double, governance_fingerprint string")
    rows = [("layer", 0.6), ("cycle", 0.0), ("persistence", 0.0), ("security", None)]
    got = {r["dimension"]: r["delta"] for r in calibration.drift(base(fp, rows), a.snapshots()).collect()}
    assert got == {"layer": 0.4, "cycle": 0.0, "persistence": 0.5}
    r = one(calibration.risk(a.values, base(fp, rows), a.snapshots(), policy))
    assert r["drift_term"] == pytest.approx(1.8) and r["value"] == pytest.approx(2.3) and r["undefined_because"] == []
    r = one(calibration.risk(a.values, base("other", rows[:1]), a.snapshots(), policy))
    assert r["value"] is None and r["undefined_because"] == ["policy_differs", "not_comparable:cycle", "not_comparable:persistence"] and len(r["penalties"]) == 1
    r = one(calibration.risk(a.values, base(None, rows), a.snapshots(), whole_policy()))
    assert r["undefined_because"] == ["policy_unrecorded", "policy_differs", "sensitivity_undeclared"][:1] + ["policy_differs"] * 0 + ["sensitivity_undeclared"]
    better = [("layer", 1.0), ("cycle", 1.0), ("persistence", 1.0)]
    assert one(calibration.risk(a.values, base(fp, better), a.snapshots(), policy))["drift_term"] == 0.0
    v = analysis.view(a, "s", "1", base(fp, rows))
    assert v["risk"]["driftTerm"] == pytest.approx(1.8) and v["changed"]["layer"]["delta"] == pytest.approx(0.4)


def test_policies_are_validated_and_named():
    p = whole_policy()
    assert p.fingerprint() == whole_policy().fingerprint() != presets.layered().fingerprint() and len(p.fingerprint()) == 64
    for bad in (
        lambda: CalibrationProfile((WeightedDimension("layer", 0.5),)), lambda: WeightedDimension("layer", float("nan")), lambda: WeightedDimension("layer", -1.0), lambda: whole_policy(beta=1.0), lambda: LayerPolicy((P,), {P: (A,)}),
        lambda: ApprovedException(ExceptionTarget(node_id="a"), " ", "x"), lambda: ExceptionTarget(node_id="a", source_id="b"), lambda: whole_policy((ApprovedException(ExceptionTarget(node_id="a"), "r", "x"),) * 2),
        lambda: Calibration("power", {}), lambda: Subsystems((Subsystem("a", "x"), Subsystem("a", "y"))), lambda: facts.ExtractionRequest(()),
    ):
        with pytest.raises(ValueError):
            bad()
    presets.illustrative()
    presets.drifting()


def test_scalars(spark):
    e = spark.range(1).select(*[calibration.maturity_level(F.lit(m)).substr(1, 2).alias(f"m{i}") for i, m in enumerate((0.39, 0.4, 0.6, 0.75, 0.9, 0.91))], Calibration("sigmoid", {"k": 10.0, "t": 0.3}).apply(F.lit(0.3)).alias("s"), Calibration("power", {"alpha": 2.0}).apply(F.lit(0.5)).alias("p")).first()
    assert list(e) == ["L0", "L1", "L2", "L3", "L3", "L4", 0.5, 0.25]
    assert [double_text(x) for x in (1.0, 21, 0.001, 1e-4, 1234567.0, 1e7, 1.5e23, -0.0, 0.1 + 0.2)] == ["1.0", "21.0", "0.001", "1.0E-4", "1234567.0", "1.0E7", "1.5E23", "-0.0", "0.30000000000000004"]
    assert json_text({"a": [1, None, True], "b": 'line1\nline2\ttab"quote\\back\x01'}) == '{"a":[1.0,null,true],"b":"line1\\nline2\\ttab\\"quote\\\\back\\u0001"}'
    with pytest.raises(ValueError):
        json_text(float("nan"))
    assert facts.method_id("a.B$C", "m", ["int", "X$Y"]) == "a.B.C#m(int,X$Y)" and facts.module_id("g", "a") == "g:a"


def test_scans_table(spark, tmp_path):
    rows = spark.createDataFrame([("p", 1, "a"), ("p", 3, "c"), ("q", 2, "b")], "project_id string, scanned_at long, report string")
    scans.append(rows, str(tmp_path / "t"))
    scans.append(rows.limit(0), str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    assert sorted((r["project_id"], r["scanned_at"]) for r in scans.latest(t).collect()) == [("p", 3), ("q", 2)]
    assert [r["scanned_at"] for r in scans.of_project(t, "p").collect()] == [3, 1]
    assert {r["scanned_at"]: r["previous_scan"] for r in scans.with_previous(t).collect()} == {1: None, 3: 1, 2: None}
    names = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, name string")
    assert [tuple(r) for r in scans.projects(scans.upsert(names, spark.createDataFrame([("b", "w")], names.schema))).collect()] == [("b", "w"), ("a", "x")]


def test_scans_stream(spark, tmp_path):
    from tesserae.streaming import scans as stream

    rows = spark.createDataFrame([("p", 1), ("p", 1), ("q", 2)], "project_id string, scanned_at long")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream.follow(spark, str(tmp_path / "in"), "project_id string, scanned_at long", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


JAVA = {
    "Shop.java": """package com.shop;
import org.springframework.stereotype.Controller;
import org.springframework.data.repository.CrudRepository;
/* for (x) { */
@Controller
public class Shop<T extends Comparable<T>> extends Base implements java.io.Serializable {
  private final Store store = new Store("a(b)"); int n;
  static { int z = 3; }
  void run(Store other, int k) {
    for (Item i : items) { store.load(i.id()); if (k > 0) other.load(k, 2); }
    while (more()) step();
    store.load(2);
    items.forEach(x -> { x.save(); });
    String q = "store.load(3)";
    do { step(); } while (k < 3);
  }
  boolean more() { return new Helper().ok(); }
  void step() {}
  static class Inner { Shop shop; }
}
class Base {}
""",
    "Store.java": "package com.shop;\nimport org.springframework.data.repository.CrudRepository;\ninterface Store extends CrudRepository<Item, Long> { void load(int x); }\nclass JpaStore implements Store { public void load(int x) {} }\n",
    "Broken.java": "class { ((( \x00 unterminated /* ",
}


def test_java_sources(spark, tmp_path):
    for name, text in JAVA.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "Bytes.java").write_bytes(b"class X { \xff\xfe }")
    found = java.extract(spark, facts.ExtractionRequest((str(tmp_path),)))
    n, e = facts.assemble(found.nodes, found.edges)
    out, _ = roles.refined(n, e)
    got = {r["id"]: r["role"] for r in out.collect()}
    assert got["com.shop.Shop"] == P and got["com.shop.Shop#run(Store,int)"] == P and got["com.shop.Store"] == S and got["com.shop.JpaStore"] == S and got["com.shop.Base"] == "UNKNOWN" and "com.shop.Shop.Inner" in got
    rows = [(r["src_id"], r["relation"], r["dst_id"] or "?" + r["dst_desc"], r["provenance"][0]["fidelity"][:2], r["provenance"][0]["execution_context"]) for r in e.collect()]
    run = "com.shop.Shop#run(Store,int)"
    for want in (
        ("com.shop.Shop", "EXTENDS", "com.shop.Base", "L2", "UNKNOWN"), ("com.shop.Shop", "IMPLEMENTS", "?java.io.Serializable", "L2", "UNKNOWN"), ("com.shop.Shop", "DEPENDS", "com.shop.Store", "L2", "UNKNOWN"),
        (run, "CALL", "com.shop.Store#load(int)", "L2", "ITERATED"), (run, "CALL", "com.shop.Store#load(int)", "L2", "UNKNOWN"), (run, "CALL", "?load", "L1", "ITERATED"), (run, "CALL", "com.shop.Shop#more()", "L2", "ITERATED"),
        (run, "CALL", "?save", "L1", "UNKNOWN"), (run, "MEMBER_OF", "com.shop.Shop", "L2", "UNKNOWN"), ("com.shop.Shop.Inner", "DEPENDS", "com.shop.Shop", "L2", "UNKNOWN"), ("com.shop.Store", "IMPLEMENTS", "?org.springframework.data.repository.CrudRepository", "L2", "UNKNOWN"),
    ):
        assert want in rows, want
    assert rows.count((run, "CALL", "com.shop.Shop#step()", "L2", "ITERATED")) == 2 and not any(r[1] == "CALL" and "Helper" in r[2] for r in rows)
    assert found.diagnostics.count() == 1


def test_rows_in_any_order(spark):
    n, e = layered(spark)
    for parts, seed in itertools.product((1, 5), (1, 2)):
        m, f = n.orderBy(F.rand(seed)).repartition(parts), e.orderBy(F.rand(seed)).repartition(parts)
        assert one(metrics.layer_entropy(m, f, POLICY))["value"] == 0.25 and one(governance.Subsystems((Subsystem("w", "web."),)).claimed(m).where("subsystem = 'w'"))["id"] == "web.C"
