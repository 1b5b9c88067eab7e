"""The whole analysis of any number of graphs, the governance view, and their reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.javatext import json_text
from tesserae.operators import calibration, cycles, governance, invariants, metrics, roles
from tesserae.operators.governance import GovernancePolicy
from tesserae.schema import DIMENSIONS, KEY, not_blank, require
from tesserae.storage import stored


@dataclass(frozen=True)
class DetectionCatalog:
    """The detection rules of a run: seed rules, refinement rules and security rules. Nothing is added by default; names may not repeat."""

    seed_rules: tuple
    refinement_rules: tuple
    security_rules: tuple

    def __post_init__(self) -> None:
        for rules, what in ((self.seed_rules, "seed"), (self.security_rules, "security")):
            names = [not_blank(getattr(r, "name", None), f"the name of a {what} rule") for r in rules]
            require(len(set(names)) == len(names), f"a {what} rule is named twice")
        require(all(map(callable, self.refinement_rules)), "a refinement rule is a function of roles, edges and what is new")

    def refinement(self) -> Callable:
        """The refinement rule of the run; a single one stays itself, so that what is known of it can be used."""
        return self.refinement_rules[0] if len(self.refinement_rules) == 1 else self.refine

    def refine(self, base: DataFrame, up: DataFrame, fresh: DataFrame) -> DataFrame:
        """The candidates of all refinement rules."""
        if not self.refinement_rules:
            return roles.inherit_from_supertypes(base, up, fresh).limit(0)
        return reduce(DataFrame.unionByName, [rule(base, up, fresh) for rule in self.refinement_rules])


#: The rules that the examples use.
ILLUSTRATIVE = DetectionCatalog(tuple(roles.SEED_RULES), (roles.inherit_from_supertypes,), tuple(metrics.SECURITY_RULES))


@dataclass(frozen=True)
class Analysis:
    """Tables of one run, all keyed by (subject_id, scan_id). Those that follow are made when they are first asked for; what counts edges reads their profile."""

    policy: GovernancePolicy
    catalog: DetectionCatalog
    nodes: DataFrame
    edges: DataFrame
    passes: DataFrame
    roles: DataFrame  # edges with roles, for what names edges
    numbered: bool

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        return stored(df, name) if self.numbered else df

    @cached_property
    def joined(self) -> DataFrame:
        return self._kept(self.roles, "joined")

    @cached_property
    def profile(self) -> DataFrame:
        return stored(metrics.edge_profile(self.nodes, self.edges, self.policy.subsystems), "profile")

    @cached_property
    def layer(self) -> DataFrame:
        return metrics.judged(self.joined.where(F.col("relation").isin(*metrics.LAYER_RELATIONS)), self.policy.layer_policy, self.policy.subsystems)

    @cached_property
    def components(self) -> DataFrame:
        return stored(cycles.components(self.nodes, self.edges), "cycle")

    @cached_property
    def cycle(self) -> DataFrame:
        return stored(cycles.cycle_entropy(self.components, self.policy.include_self_cycles), "cycle")

    @cached_property
    def persistence(self) -> DataFrame:
        return self._kept(metrics.persistence_edges(self.nodes, self.edges), "persistence")

    @cached_property
    def security(self) -> DataFrame:
        return metrics.security_findings(self.nodes, self.catalog.security_rules)

    @cached_property
    def summaries(self) -> dict[str, DataFrame]:
        """(key, relevant, flagged, value) of layer, persistence and security."""
        graphs = metrics.graphs(self.nodes)
        alike = self.profile.where(F.col("relation").isin(*metrics.LAYER_RELATIONS))
        calls = self.profile.where(F.col("relation").isin(*metrics.PERSISTENCE_RELATIONS) & (F.col("dst_role") == "PERSISTENCE"))
        layer = metrics.judged(alike, self.policy.layer_policy, self.policy.subsystems).drop("flagged").withColumnRenamed("violating", "flagged")
        found = {"layer": layer, "persistence": calls, "security": self.security.withColumnRenamed("weak", "flagged")}
        return {name: stored(metrics.summary(rows, graphs, "flagged", "flagged"), "summary") for name, rows in found.items()}

    @cached_property
    def values(self) -> DataFrame:
        """One row per graph: a column per dimension, total_entropy, maturity, level."""
        value = lambda df, name: df.select(*KEY, F.col("value").alias(name))
        out = metrics.graphs(self.nodes)
        for name in DIMENSIONS:
            out = out.join(value(self.cycle if name == "cycle" else self.summaries[name], name), KEY, "left")
        out = calibration.total_entropy(out, self.policy.calibration)
        out = out.withColumn("maturity", calibration.maturity(F.col("total_entropy"))).withColumn("level", calibration.maturity_level(F.col("maturity")))
        return stored(out, "values")

    @cached_property
    def confidence(self) -> DataFrame:
        return metrics.confidence(self.nodes, self.edges)

    @cached_property
    def dimension_confidence(self) -> DataFrame:
        return metrics.dimension_confidence(self.nodes, self.edges)

    @property
    def _totals(self) -> DataFrame:
        return self.values.select(*KEY, "total_entropy")

    @cached_property
    def violations(self) -> DataFrame:
        return stored(invariants.violations(self.policy.invariants, self.nodes, self.edges, self._totals, numbered=True, joined=self.joined), "violations")

    @cached_property
    def results(self) -> DataFrame:
        return self.indicators(self.policy.invariants)

    def indicators(self, declared: Sequence[invariants.Invariant]) -> DataFrame:
        """invariants.indicators() of any invariants over this run."""
        return invariants.indicators(declared, invariants.counted(declared, self.nodes, self.profile, self._totals), self.nodes, self._totals)

    @cached_property
    def aggregate(self) -> DataFrame:
        return invariants.weighted(self.results, self.policy.invariant_weights, [i.name for i in self.policy.invariants])

    @cached_property
    def excused(self) -> DataFrame:
        null = F.lit(None).cast("string")
        edge = lambda df, dim: df.select(*KEY, F.lit(dim).alias("dimension"), null.alias("node_id"), F.col("src_id").alias("source_id"), F.col("dst_id").alias("target_id"), "relation")
        findings = edge(self.layer.where("violating"), "layer").unionByName(edge(self.persistence.where("flagged"), "persistence"))
        findings = findings.unionByName(self.security.where("weak").select(*KEY, F.lit("security").alias("dimension"), F.col("id").alias("node_id"), null.alias("source_id"), null.alias("target_id"), null.alias("relation")))
        findings = findings.unionByName(self.violations.where("kind <> 'graph'").select(*KEY, F.concat(F.lit("invariant:"), "name").alias("dimension"), "node_id", "source_id", "target_id", "relation"))
        return governance.excused(findings, self.policy.exceptions_table(self.nodes.sparkSession))

    @cached_property
    def unmatched(self) -> DataFrame:
        return governance.unmatched(self.policy.exceptions_table(self.nodes.sparkSession), self.excused)

    def snapshots(self) -> DataFrame:
        return calibration.snapshots(self.values, self.policy.fingerprint())


def analyse(nodes: DataFrame, edges: DataFrame, policy: GovernancePolicy, catalog: DetectionCatalog = ILLUSTRATIVE, numbered: bool = True, inheritance: DataFrame | None = None) -> Analysis:
    """Roles, the four dimensions, total, invariants and the exception ledger. Exceptions never move a number.

    With numbered the edges are stored first, so that their numbers are the same in all tables; without it they are read where they are used,
    which suits edges that other tables give. inheritance has the edges that refinement reads, where they can be read apart from the others.
    """
    if numbered:
        edges = stored(edges, "edges")
    final, passes = roles.refined(nodes, edges if inheritance is None else inheritance, catalog.seed_rules, catalog.refinement())
    final = stored(final, "nodes")
    # layers and invariants read the same edges with roles, joined once
    joined = metrics.with_roles(edges.select(*KEY, "edge_seq", "src_resolved", "src_id", "dst_resolved", "dst_id", "relation"), final)
    return Analysis(policy, catalog, final, edges, passes, joined, numbered)


def observations(a: Analysis) -> DataFrame:
    """(key, dim_ord, dimension, value, confidence, relevant, findings): for cycles findings counts components."""
    part = lambda df, dim, n, k: df.select(*KEY, F.lit(DIMENSIONS.index(dim)).alias("dim_ord"), F.lit(dim).alias("dimension"), F.col("value"), F.col(n).alias("relevant"), F.col(k).alias("findings"))
    rows = part(a.cycle, "cycle", "nodes", "cycles")
    for dim in ("layer", "persistence", "security"):
        rows = rows.unionByName(part(a.summaries[dim], dim, "relevant", "flagged"))
    return rows.join(a.dimension_confidence.select(*KEY, "dimension", F.col("value").alias("confidence")), [*KEY, "dimension"], "left").select(*KEY, "dim_ord", "dimension", "value", "confidence", "relevant", "findings")


def findings(a: Analysis) -> DataFrame:
    """(key, dim_ord, dimension, node_id, source_id, target_id, relation, governed_by, excused_by): a cycle names nothing."""
    null = lambda n: F.lit(None).cast("string").alias(n)
    edge = lambda df, dim, by: df.select(*KEY, F.lit(DIMENSIONS.index(dim)).alias("dim_ord"), F.lit(dim).alias("dimension"), null("node_id"), F.col("src_id").alias("source_id"), F.col("dst_id").alias("target_id"), "relation", by)
    rows = edge(a.layer.where("violating"), "layer", F.col("governed_by")).unionByName(edge(a.persistence.where("flagged"), "persistence", null("governed_by")))
    cycle = cycles.cycle_groups(a.components, a.policy.include_self_cycles)
    rows = rows.unionByName(cycle.select(*KEY, F.lit(1).alias("dim_ord"), F.lit("cycle").alias("dimension"), null("node_id"), null("source_id"), null("target_id"), null("relation"), null("governed_by")))
    rows = rows.unionByName(a.security.where("weak").select(*KEY, F.lit(3).alias("dim_ord"), F.lit("security").alias("dimension"), F.col("id").alias("node_id"), null("source_id"), null("target_id"), null("relation"), null("governed_by")))
    # targets are declared once each, so a finding meets at most one of the exceptions; these are the policy's own and few
    target = ["node_id", "source_id", "target_id", "relation"]
    declared = a.policy.exceptions_table(a.nodes.sparkSession).select(*[F.col(c).alias(f"_{c}") for c in target], F.col("approved_by").alias("excused_by"))
    same = F.expr(governance.NAMED)
    for c in target:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(F.broadcast(declared), same, "left").select(*rows.columns, "excused_by")


def unexcused(found: DataFrame) -> DataFrame:
    return found.where("excused_by is null")


def constraints(a: Analysis) -> DataFrame:
    """(key, ord, name, scope, holds, violations, weight): every declared invariant, held ones included."""
    weight = F.lit(None).cast("double")
    for n, w in a.policy.invariant_weights:
        weight = F.when(F.col("name") == n, F.lit(float(w))).otherwise(weight)
    return a.results.select(*KEY, "ord", "name", "scope", "holds", "violations", weight.alias("weight"))


def unanswered(a: Analysis) -> DataFrame:
    """(key, question): dimensions without a value, invariants that weren't evaluated, and findings that name nothing."""
    o = observations(a).where("value is null").select(*KEY, F.concat(F.lit("dimension:"), "dimension").alias("question"))
    i = a.results.where("not evaluated").select(*KEY, F.concat(F.lit("invariant:"), "name").alias("question"))
    n = cycles.cycle_groups(a.components, a.policy.include_self_cycles).groupBy(*KEY).agg(F.count("*").alias("n"))
    return o.unionByName(i).unionByName(n.select(*KEY, F.concat(F.lit("unaddressable:"), F.col("n")).alias("question")))


def scan_rows(a: Analysis) -> DataFrame:
    """The flat row of each scan for the scans table: dimension values, totals, counts."""
    bad = a.results.groupBy(*KEY).agg(F.count_if(~F.col("holds")).alias("invariant_violation_count"), F.array_sort(F.collect_list(F.when(~F.col("evaluated"), F.col("name")))).alias("skipped_invariants"))
    counts = a.nodes.groupBy(*KEY).agg(F.count("*").alias("node_count"))
    lines = a.edges.groupBy(*KEY).agg(F.count("*").alias("edge_count"))
    out = a.values.join(counts, KEY, "left").join(lines, KEY, "left").join(bad, KEY, "left").join(a.passes, KEY, "left").join(a.confidence.select(*KEY, F.col("value").alias("confidence")), KEY, "left")
    return out.na.fill(0, ["node_count", "edge_count", "invariant_violation_count"])


EDGE_JSON = "struct(named_struct('resolved', src_resolved, 'id', src_id, 'description', src_desc) as source, named_struct('resolved', dst_resolved, 'id', dst_id, 'description', dst_desc) as target, relation, provenance)"


def graph_json(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as one JSON text per row, explicit nulls included: a graph of any size is written by many tasks."""
    options = {"ignoreNullFields": "false"}
    n = nodes.select(*KEY, "node_seq", F.to_json(F.struct("id", "type", "role", "attributes", "evidence"), options).alias("json"))
    return n, edges.select(*KEY, "edge_seq", F.to_json(F.expr(EDGE_JSON), options).alias("json"))


def report(a: Analysis, subject_id: str, scan_id: str) -> dict:
    """One graph's report as plain values in a fixed order; summaries only, so its size doesn't follow the graph's."""
    mine = (F.col("subject_id") == subject_id) & (F.col("scan_id") == scan_id)
    v = a.values.where(mine).first()
    o = {r["dimension"]: r for r in observations(a).where(mine).collect()}
    e = a.aggregate.where(mine).first()
    return {
        "subject": subject_id, "scan": scan_id, "passes": a.passes.where(mine).first()["passes"],
        "roles": {r["role"]: r["nodes"] for r in roles.histogram(a.nodes.where(mine)).collect()},
        **{f"{d}Entropy": {"value": o[d]["value"], "relevant": o[d]["relevant"], "findings": o[d]["findings"], "confidence": o[d]["confidence"]} for d in DIMENSIONS},
        "confidence": a.confidence.where(mine).first()["value"], "totalEntropy": v["total_entropy"], "maturity": v["maturity"], "maturityLevel": v["level"],
        "invariants": {r["name"]: {"holds": r["holds"], "violations": r["violations"]} for r in a.results.where(mine).orderBy("ord").collect() if r["evaluated"]},
        "skippedInvariants": [r["name"] for r in a.results.where(mine).where("not evaluated").orderBy("ord").collect()],
        "invariantAggregate": None if e is None else {"value": e["value"], "contributions": [c.asDict() for c in e["contributions"]], "unevaluated": list(e["unevaluated"])},
        "exceptions": {"excused": [{"dimension": r["dimension"], "node": r["node_id"], "source": r["source_id"], "target": r["target_id"], "relation": r["relation"], "approvedBy": r["approved_by"]} for r in a.excused.where(mine).orderBy("dimension", "ord").collect()], "unmatched": [r["reason"] for r in a.unmatched.orderBy("ord").collect()]},
        "governanceFingerprint": a.policy.fingerprint(),
    }


def report_json(a: Analysis, subject_id: str, scan_id: str) -> str:
    return json_text(report(a, subject_id, scan_id))


def view(a: Analysis, subject_id: str, scan_id: str, baseline: DataFrame | None = None) -> dict:
    """The governance view: observed, changed, violated, risk, findings, unanswered. Without a baseline nothing changed is claimed."""
    mine = (F.col("subject_id") == subject_id) & (F.col("scan_id") == scan_id)
    now = a.snapshots().where(mine)
    changed = risk = None
    if baseline is not None:
        changed = {r["dimension"]: {"baselineValue": r["baseline_value"], "currentValue": r["current_value"], "delta": r["delta"]} for r in calibration.drift(baseline, now).collect()}
        r = calibration.risk(a.values.where(mine), baseline, now, a.policy).first()
        risk = {"value": r["value"], "entropyTerm": r["entropy_term"], "driftTerm": r["drift_term"], "penalties": [p.asDict() for p in r["penalties"]], "undefinedBecause": list(r["undefined_because"])}
    found = findings(a).where(mine)
    return {
        "observed": {r["dimension"]: {"value": r["value"], "confidence": r["confidence"], "relevant": r["relevant"], "findings": r["findings"]} for r in observations(a).where(mine).orderBy("dim_ord").collect()},
        "changed": changed,
        "violated": [{"name": r["name"], "holds": r["holds"], "violations": r["violations"], "weight": r["weight"]} for r in constraints(a).where(mine).orderBy("ord").collect()],
        "risk": risk,
        "findings": {"total": found.count(), "unexcused": unexcused(found).count()},
        "unanswered": [r["question"] for r in unanswered(a).where(mine).orderBy("question").collect()],
    }
