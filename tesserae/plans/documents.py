"""Whole report documents: every list in full, as JSON text in pieces, so that neither the driver nor a task holds a graph.

A document is a sequence of pieces: constant text, or a table of list elements with their order. Document.rows() gives all
pieces as one table that can be written anywhere; Document.text() streams them through the driver, partition by partition. Numbers
are doubles in the reports' layout, keys come in a fixed order, and what has no value is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.javatext import json_text
from tesserae.operators import calibration, cycles
from tesserae.operators.governance import FINDING, ApprovedException, ExceptionTarget, GovernancePolicy, LayerPolicy
from tesserae.plans.analysis import Analysis, constraints, findings, observations
from tesserae.schema import DIMENSIONS, KEY, ROLES
from tesserae.sources import reports

# What the reports say where something is undefined or can't be answered.
REASONS = {
    "policy_unrecorded": "the governance policy behind at least one measurement is unrecorded, so the two cannot be shown comparable - unknown is not the same as matching",
    "policy_differs": "the two measurements were governed by different policies, so their difference is not necessarily code drift",
    "sensitivity_undeclared": "no drift sensitivity was declared, so section 5.3's second term is unknown",
    "total_entropy_undefined": "total entropy is undefined, so section 5.3's first term is unknown",
    "not_comparable": "dimension '{0}' carries drift weight {1} but was not comparable between the two measurements",
}
NOT_COMPARED = "what changed relative to baseline: no baseline was supplied, so nothing was compared - this is not a statement that nothing changed"
NO_RISK = "what risk interpretation follows: R is drift-aware and needs a baseline"
RISK = "what risk interpretation follows: {0}"
UNADDRESSED = "what evidence supports each conclusion: {0} finding(s) resolved to no node or edge identifier, so they can be read in their own dimension's result but not addressed individually"


# --- JSON in columns ---------------------------------------------------------------


def _quoted(c: Column) -> Column:
    """The column as a JSON string, null where it is null; control characters are left to without_controls()."""
    plain = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.coalesce(F.concat(F.lit('"'), plain, F.lit('"')), F.lit("null"))


def without_controls(json: Column) -> Column:
    """JSON text with its control characters escaped like the report writer's; outside of strings there are none, so an element is searched once."""
    escaped = json
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    for code in range(32):
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(short.get(code, f"\\u{code:04x}")))
    return F.when(json.rlike(r"[\x00-\x1f]"), escaped).otherwise(json)


def json_string(c: Column) -> Column:
    """The column as a JSON string, null where it is null."""
    return without_controls(_quoted(c))


def json_number(c: Column) -> Column:
    return F.coalesce(c.cast("double").cast("string"), F.lit("null"))


def json_bool(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def json_object(**fields: Column) -> Column:
    parts = []
    for i, (name, value) in enumerate(fields.items()):
        parts += [F.lit(("," if i else "{") + json_text(name) + ":"), value]
    return F.concat(*parts, F.lit("}"))


def json_array(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def attributes_json(attributes: Column) -> Column:
    entries = F.transform(F.array_sort(F.map_entries(attributes)), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), _quoted(e["value"])))
    # most have none, and only code for those is compiled
    return F.when(F.size(attributes) > 0, F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))).otherwise(F.lit("{}"))


def evidence_json(e: Column) -> Column:
    return json_object(sourceAdapter=_quoted(e["source_adapter"]), description=_quoted(e["description"]), location=_quoted(e["location"]), fidelity=_quoted(e["fidelity"]), executionContext=_quoted(e["execution_context"]), attributes=attributes_json(e["attributes"]))


def _evidences_json(items: Column) -> Column:
    """A list of evidence. Spark doesn't compile functions over lists, so lists of one, which most are, go without."""
    one = F.concat(F.lit("["), evidence_json(F.get(items, F.lit(0))), F.lit("]"))
    return F.when(F.size(items) == 1, one).otherwise(json_array(F.transform(items, evidence_json)))


def node_json() -> Column:
    return json_object(id=_quoted(F.col("id")), type=_quoted(F.col("type")), role=_quoted(F.col("role")), attributes=attributes_json(F.col("attributes")), evidence=_evidences_json(F.col("evidence")))


def _end(x: str) -> Column:
    resolved = json_object(resolved=F.lit("true"), id=_quoted(F.col(f"{x}_id")))
    return F.when(F.col(f"{x}_resolved"), resolved).otherwise(json_object(resolved=F.lit("false"), description=_quoted(F.col(f"{x}_desc"))))


def edge_json() -> Column:
    return json_object(source=_end("src"), target=_end("dst"), relation=_quoted(F.col("relation")), provenance=_evidences_json(F.col("provenance")))


def target_json() -> Column:
    """The subject that a finding's row names: a node, an edge, or null."""
    node = json_object(kind=F.lit('"node"'), nodeId=json_string(F.col("node_id")))
    edge = json_object(kind=F.lit('"edge"'), sourceId=json_string(F.col("source_id")), targetId=json_string(F.col("target_id")), relation=json_string(F.col("relation")))
    return F.when(F.col("node_id").isNotNull(), node).when(F.col("source_id").isNotNull() & F.col("target_id").isNotNull(), edge).otherwise(F.lit("null"))


# --- documents ---------------------------------------------------------------------


@dataclass(frozen=True)
class Elements:
    """List elements: rows has the columns that order them, together unique, and json, or what json is made of; joined where json has its own separators."""

    rows: DataFrame
    order: tuple[str, ...]
    joined: bool = False
    json: Column | None = None

    def placed(self) -> DataFrame:
        """(place, json): place orders like the columns, with separators in json."""
        kinds = dict(self.rows.dtypes)
        parts = [F.col(c) if kinds[c] == "string" else F.lpad(F.col(c).cast("string"), 19, "0") for c in self.order]
        return self._separated(self.rows, F.array(*parts).alias("place"))

    def sorted(self) -> DataFrame:
        """(json) in order, with separators: rows are sorted as they are, and the text is made of what is sorted, once."""
        return self._separated(self.rows.orderBy(*self.order)).select("json")

    def texts(self) -> DataFrame:
        """(json) in order, without separators."""
        return self._made(self.rows.orderBy(*self.order)).select("json")

    def _made(self, rows: DataFrame, *more: Column) -> DataFrame:
        keys = [c for c in self.order if c != "json"]
        made = rows.select(*keys, *more, (F.col("json") if self.json is None else self.json).alias("json"))
        return made.withColumn("json", without_controls(F.col("json")))

    def _separated(self, rows: DataFrame, *more: Column) -> DataFrame:
        made = self._made(rows, *more)
        if self.joined:
            return made
        first = self.rows.agg(F.min(F.struct(*self.order))).first()[0]
        if first is None:
            return made
        begins = F.lit(True)
        for c in self.order:
            begins = begins & F.col(c).eqNullSafe(F.lit(first[c]))
        return made.withColumn("json", F.concat(F.when(begins, F.lit("")).otherwise(F.lit(",")), "json"))


@dataclass(frozen=True)
class Document:
    pieces: tuple[str | Elements, ...]

    def __add__(self, other: Document | str) -> Document:
        return Document((*self.pieces, *(other.pieces if isinstance(other, Document) else (other,))))

    def __radd__(self, other: str) -> Document:
        return Document((other, *self.pieces))

    def rows(self, spark: SparkSession) -> DataFrame:
        """(piece, place, text): all texts in order of the first two make the document."""
        constant = [(i, p) for i, p in enumerate(self.pieces) if isinstance(p, str)]
        out = spark.createDataFrame([(i, [], p) for i, p in constant], "piece int, place array<string>, text string")
        for i, p in enumerate(self.pieces):
            if isinstance(p, Elements):
                out = out.unionByName(p.placed().select(F.lit(i).alias("piece"), "place", F.col("json").alias("text")))
        return out

    def text(self) -> Iterator[str]:
        """The document's text, one element after the other."""
        for p in self.pieces:
            if isinstance(p, str):
                yield p
                continue
            for n, r in enumerate(p.texts().toLocalIterator()):
                yield ("," if n and not p.joined else "") + r["json"]

    def write(self, spark: SparkSession, path: str, separator: str = "", compression: str = "") -> None:
        """The document in parts with a manifest, written by many tasks; a job that fails leaves what was there."""
        # a union's partitions come one table after the other, so each piece is sorted by itself
        each = [p.sorted() if isinstance(p, Elements) else spark.createDataFrame([(p,)], "json string").coalesce(1) for p in self.pieces]
        reports.write(reduce(DataFrame.union, each), path, separator, compression)


def constant(value: object) -> Document:
    return Document((json_text(value),))


def listed(rows: DataFrame, *order: str, json: Column | None = None) -> Document:
    return Document(("[", Elements(rows, order, json=json), "]"))


def obj(fields: dict[str, Document]) -> Document:
    out = Document(("{",))
    for i, (name, value) in enumerate(fields.items()):
        out = out + (("," if i else "") + json_text(name) + ":") + value
    return out + "}"


def mine(df: DataFrame, subject_id: str, scan_id: str) -> DataFrame:
    return df.where((F.col("subject_id") == subject_id) & (F.col("scan_id") == scan_id))


# what node_json() and edge_json() read
_NODE = ("id", "type", "role", "attributes", "evidence")
_EDGE = ("src_resolved", "src_id", "src_desc", "dst_resolved", "dst_id", "dst_desc", "relation", "provenance")


def graph(nodes: DataFrame, edges: DataFrame) -> Document:
    """One graph, nodes and edges in order."""
    return obj({"nodes": listed(nodes.select("node_seq", *_NODE), "node_seq", json=node_json()), "edges": _edges(edges)})


def _edges(edges: DataFrame, some: DataFrame | None = None) -> Document:
    rows = edges if some is None else edges.join(some.select(*KEY, "edge_seq"), [*KEY, "edge_seq"], "left_semi")
    return listed(rows.select("edge_seq", *_EDGE), "edge_seq", json=edge_json())


def _one(df: DataFrame, *names: str) -> list:
    r = df.select(*names).first()
    return [None] * len(names) if r is None else list(r)


def layer(layer_rows: DataFrame, edges: DataFrame) -> Document:
    n, bad = _one(layer_rows.agg(F.count("*").alias("n"), F.count_if("violating").alias("bad")), "n", "bad")
    return obj({"value": constant(bad / n if n else None), "relevantEdgeCount": constant(n), "violatingEdgeCount": constant(bad), "relevantEdges": _edges(edges, layer_rows), "violatingEdges": _edges(edges, layer_rows.where("violating"))})


def _ids(rows: DataFrame, by: str) -> Elements:
    """Sorted lists of ids by a column, as opening, member and closing elements; the least id of each list is its name."""
    first = rows.agg(F.min(by)).first()[0]
    lists = rows.groupBy(by).agg(F.min("id").alias("least"))
    opening = lists.select(F.col(by).alias("list"), F.lit(0).alias("part"), F.lit("").alias("id"), F.concat(F.when(F.col(by) == F.lit(first), F.lit("")).otherwise(F.lit(",")), F.lit("[")).alias("json"))
    members = rows.join(lists, by).select(F.col(by).alias("list"), F.lit(1).alias("part"), "id", F.concat(F.when(F.col("id") == F.col("least"), F.lit("")).otherwise(F.lit(",")), json_string(F.col("id"))).alias("json"))
    closing = lists.select(F.col(by).alias("list"), F.lit(2).alias("part"), F.lit("").alias("id"), F.lit("]").alias("json"))
    return Elements(opening.unionByName(members).unionByName(closing), ("list", "part", "id"), joined=True)


def cycle(comps: DataFrame, policy: GovernancePolicy) -> Document:
    on = comps.where(cycles.participates(policy.include_self_cycles))
    n, m = comps.count(), on.count()
    by = {r["subsystem"]: r for r in cycles.cycle_by_subsystem(comps, policy.subsystems, policy.include_self_cycles).collect()}  # declared subsystems only
    scoped = []
    for s in policy.subsystems.declared:
        r = by.get(s.name)
        claimed, part = (r["claimed"], r["participating"]) if r else (0, 0)
        ids = on.where(F.col("id").startswith(s.id_prefix)).select("id", json_string(F.col("id")).alias("json"))
        scoped.append(obj({"subsystem": constant(s.name), "value": constant(part / claimed if claimed else None), "totalNodeCount": constant(claimed), "participatingNodeCount": constant(part), "participatingNodes": listed(ids, "id")}))
    return obj({"value": constant(m / n if n else None), "totalNodeCount": constant(n), "participatingNodeCount": constant(m), "relevantSccs": Document(("[", _ids(on, "scc"), "]")), "bySubsystem": _join(scoped)})


def _join(documents: list[Document]) -> Document:
    out = Document(("[",))
    for i, d in enumerate(documents):
        out = out + ("," if i else "") + d
    return out + "]"


def persistence(rows: DataFrame, edges: DataFrame) -> Document:
    n, bad, records = _one(rows.agg(F.count("*").alias("n"), F.count_if("flagged").alias("bad"), F.coalesce(F.sum("iterated_count"), F.lit(0)).alias("records")), "n", "bad", "records")
    return obj({"value": constant(bad / n if n else None), "weightedValue": constant(records / n if n else None), "relevantEdgeCount": constant(n), "flaggedEdgeCount": constant(bad), "relevantEdges": _edges(edges, rows), "flaggedEdges": _edges(edges, rows.where("flagged"))})


def security(rows: DataFrame, nodes: DataFrame) -> Document:
    n, bad = _one(rows.agg(F.count("*").alias("n"), F.count_if("weak").alias("bad")), "n", "bad")
    says = F.concat(F.lit("rule "), F.col("rule"), F.when(F.col("weak"), F.lit(" found a weakness of ")).otherwise(F.lit(" found no weakness of ")), F.lit("concern "), F.col("concern"))
    ordered = rows.join(nodes.select(*KEY, "id", "node_seq"), [*KEY, "id"])
    json = json_object(nodeId=json_string(F.col("id")), ruleName=json_string(F.col("rule")), concern=json_string(F.col("concern")), weaknessDetected=json_bool(F.col("weak")), rationale=json_string(says))
    each = ordered.select("node_seq", "rule", "weak", json.alias("json"))
    return obj({"value": constant(bad / n if n else None), "opportunityCount": constant(n), "flaggedCount": constant(bad), "opportunities": listed(each, "node_seq", "rule"), "flagged": listed(each.where("weak"), "node_seq", "rule")})


def invariant(a: Analysis, found: DataFrame, nodes: DataFrame, edges: DataFrame, r) -> Document:
    """One evaluated invariant with each violation's whole subject; r is its row of results."""
    own = found.where(F.col("name") == r["name"])
    wrong = lambda what: json_string(F.concat(F.lit(what), F.lit(f" violated invariant '{r['name']}'")))
    if r["scope"] == "NODE":
        rows = own.join(nodes.select(*KEY, F.col("id").alias("node_id"), F.col("node_seq").alias("at")), [*KEY, "node_id"])
        rows = rows.select("at", json_object(subject=json_object(kind=F.lit('"node"'), nodeId=json_string(F.col("node_id"))), rationale=json_string(F.concat(F.lit("node "), "node_id", F.lit(f" violated invariant '{r['name']}'")))).alias("json"))
    elif r["scope"] == "EDGE":
        rows = edges.join(own.select(*KEY, F.col("seq").alias("edge_seq")), [*KEY, "edge_seq"], "left_semi")
        says = F.concat(F.lit("edge "), "src_id", F.lit(" "), "relation", F.lit(" "), "dst_id", F.lit(f" violated invariant '{r['name']}'"))
        rows = rows.select(F.col("edge_seq").alias("at"), json_object(subject=json_object(kind=F.lit('"edge"'), edge=edge_json()), rationale=json_string(says)).alias("json"))
    else:
        rows = own.select(F.lit(0).alias("at"), json_object(subject=F.lit('{"kind":"graph"}'), rationale=wrong("graph")).alias("json"))
    severity = next(i.severity for i in a.policy.invariants if i.name == r["name"])
    return obj({"invariantName": constant(r["name"]), "severity": constant(severity), "holds": constant(r["holds"]), "indicatorValue": constant(r["indicator"]), "violations": listed(rows, "at")})


def target(t: ExceptionTarget) -> dict:
    return {"kind": "node", "nodeId": t.node_id} if t.node_id is not None else {"kind": "edge", "sourceId": t.source_id, "targetId": t.target_id, "relation": t.relation}


def exception(e: ApprovedException) -> dict:
    return {"target": target(e.target), "reason": e.reason, "approvedBy": e.approved_by}


def ledger(excused: DataFrame, unmatched: DataFrame, policy: GovernancePolicy) -> Document:
    """What approved exceptions excuse, and those that excuse nothing."""
    json = json_object(dimension=json_string(F.col("dimension")), target=target_json(), reason=json_string(F.col("reason")), approvedBy=json_string(F.col("approved_by")))
    rows = excused.select(*FINDING, "ord", json.alias("json")).groupBy("dimension", "ord").agg(F.count("*").alias("n"), F.first("json").alias("json"))
    each = rows.select("dimension", "ord", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"), "json")  # equal findings give equal texts
    left = {r["ord"] for r in unmatched.select("ord").collect()}  # declared exceptions only
    return obj({"excused": listed(each, "dimension", "ord", "copy"), "unmatched": constant([exception(e) for i, e in enumerate(policy.exceptions) if i in left])})


def matrix(p: LayerPolicy) -> dict:
    inorder = lambda rs: [r for r in ROLES if r in rs]
    return {"knownRoles": inorder(p.known), "allowedTargets": {r: inorder(p.allowed[r]) for r in ROLES if r in p.allowed}}


def governance(p: GovernancePolicy) -> dict:
    """The declaration; predicates aren't part of it."""
    return {
        "layerPolicy": matrix(p.layer_policy),
        "subsystems": [{"name": s.name, "idPrefix": s.id_prefix, "layerPolicy": matrix(s.policy) if s.policy else None} for s in p.subsystems.declared],
        "includeSelfCyclesInCycleEntropy": p.include_self_cycles,
        "calibration": [{"dimension": d.name, "weight": d.weight, "function": d.calibration.name()} for d in p.calibration.dimensions],
        "invariants": [{"name": i.name, "scope": i.scope, "severity": i.severity, "referencedMetrics": sorted(i.metrics())} for i in p.invariants],
        "invariantWeights": [{"invariantName": n, "weight": w} for n, w in p.invariant_weights],
        "driftSensitivity": {"beta": p.beta, "dimensionWeights": dict(p.drift_weights)},
        "approvedExceptions": [exception(e) for e in p.exceptions],
    }


def aggregate(row) -> dict:
    if row is None:
        return {"value": None, "contributions": [], "unevaluatedWeightedInvariants": []}
    parts = [{"invariantName": c["name"], "weight": c["weight"], "indicatorValue": c["indicator"], "contribution": c["contribution"]} for c in row["contributions"]]
    return {"value": row["value"], "contributions": parts, "unevaluatedWeightedInvariants": list(row["unevaluated"])}


def report(a: Analysis, subject_id: str, scan_id: str, diagnostics: DataFrame | None = None) -> Document:
    """The whole report of one graph, its graph and all findings included; diagnostics has a column diagnostic."""
    own = lambda df: mine(df, subject_id, scan_id)
    nodes, edges, found = own(a.nodes), own(a.edges), own(a.violations)
    results = own(a.results).orderBy("ord").collect()  # declared invariants only
    value = _one(own(a.values), "total_entropy", "maturity", "level")
    by = {r["dimension"]: r["value"] for r in own(a.dimension_confidence).collect()}
    return obj({
        "governance": constant(governance(a.policy)), "graph": graph(nodes, edges), "roleRefinementPasses": constant(_one(own(a.passes), "passes")[0]),
        "layerEntropy": layer(own(a.layer), edges), "cycleEntropy": cycle(own(a.components), a.policy), "persistenceEntropy": persistence(own(a.persistence), edges), "securityEntropy": security(own(a.security), nodes),
        "totalEntropy": constant(value[0]), "maturity": constant(value[1]), "maturityLevel": constant(value[2]), "confidence": constant(_one(own(a.confidence), "value")[0]),
        "confidenceByDimension": constant({d: by.get(d) for d in DIMENSIONS}), "exceptionLedger": ledger(own(a.excused), a.unmatched, a.policy), "invariantAggregate": constant(aggregate(own(a.aggregate).first())),
        "invariants": obj({r["name"]: invariant(a, found, nodes, edges, r) for r in results if r["evaluated"]}), "skippedInvariants": constant([r["name"] for r in results if not r["evaluated"]]),
        "extractionDiagnostics": constant([]) if diagnostics is None else listed(diagnostics.select("diagnostic").distinct().select("diagnostic", json_string(F.col("diagnostic")).alias("json")), "diagnostic"),
    })


def drift(baseline: DataFrame, current: DataFrame) -> dict:
    rows = {r["dimension"]: r for r in calibration.drift(baseline, current).collect()}  # dimensions only
    return {d: {"baselineValue": rows[d]["baseline_value"], "currentValue": rows[d]["current_value"], "delta": rows[d]["delta"]} for d in DIMENSIONS if d in rows}


def reason(code: str, policy: GovernancePolicy) -> str:
    """The text of a risk's reason code."""
    kind, _, dimension = code.partition(":")
    return REASONS[kind].format(dimension, json_text(dict(policy.drift_weights).get(dimension, 0.0)))


def risk(row, policy: GovernancePolicy) -> dict:
    penalties = [{"dimension": p["dimension"], "gamma": p["weight"], "delta": p["delta"], "penalty": p["penalty"]} for p in row["penalties"]]
    return {"value": row["value"], "entropyTerm": row["entropy_term"], "driftTerm": row["drift_term"], "penalties": penalties, "undefinedBecause": [reason(c, policy) for c in row["undefined_because"]]}


def _findings(a: Analysis, rows: DataFrame) -> Document:
    """Findings as elements; equal ones are told apart by a copy number, so none is lost."""
    declared = F.lit(None).cast("string")
    for e in a.policy.exceptions:
        t = e.target
        same = F.col("node_id").eqNullSafe(F.lit(t.node_id)) & F.col("source_id").eqNullSafe(F.lit(t.source_id)) & F.col("target_id").eqNullSafe(F.lit(t.target_id)) & F.col("relation").eqNullSafe(F.lit(t.relation))
        declared = F.when(same & F.col("excused_by").isNotNull(), F.lit(json_text(exception(e)))).otherwise(declared)
    json = json_object(dimension=json_string(F.col("dimension")), subject=target_json(), governedBy=json_string(F.col("governed_by")), excused=json_bool(F.col("excused_by").isNotNull()), excusedBy=F.coalesce(declared, F.lit("null")))
    order = ["dim_ord", *(F.coalesce(c, F.lit("")).alias(c) for c in ("node_id", "source_id", "target_id", "relation"))]
    counts = rows.select(json.alias("json"), *order).groupBy("json", "dim_ord", "node_id", "source_id", "target_id", "relation").agg(F.count("*").alias("n"))
    each = counts.select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    return listed(each, "dim_ord", "node_id", "source_id", "target_id", "relation", "copy", "json")


def view(a: Analysis, subject_id: str, scan_id: str, baseline: DataFrame | None = None) -> Document:
    """The governance view: what is observed, what changed, what is violated, which risk follows, all findings, and what has no answer."""
    own = lambda df: mine(df, subject_id, scan_id)
    found, value = own(findings(a)), _one(own(a.values), "total_entropy", "maturity", "level")
    dimensions = [{"dimension": r["dimension"], "value": r["value"], "confidence": r["confidence"], "relevantCount": r["relevant"], "findingCount": r["findings"]} for r in own(observations(a)).orderBy("dim_ord").collect()]
    changed = risks = None
    if baseline is not None:
        now = own(a.snapshots())
        changed = {"drift": drift(baseline, now)}
        risks = risk(calibration.risk(own(a.values), baseline, now, a.policy).first(), a.policy)
    gaps = [NOT_COMPARED, NO_RISK] if baseline is None else [RISK.format(r) for r in risks["undefinedBecause"]]
    nameless = found.where("node_id is null and (source_id is null or target_id is null)").count()
    gaps += [UNADDRESSED.format(nameless)] if nameless else []
    excuses = own(a.excused).select(*FINDING, F.col("approved_by").alias("excused_by")).distinct()
    violated = own(a.violations).select(*KEY, F.concat(F.lit("invariant:"), "name").alias("dimension"), "node_id", "source_id", "target_id", "relation")
    same = violated["subject_id"].eqNullSafe(excuses["subject_id"])
    for c in FINDING[1:]:
        same = same & violated[c].eqNullSafe(excuses[c])
    violated = violated.join(excuses, same, "left").select(*[violated[c] for c in violated.columns], "excused_by").withColumns({"dim_ord": F.lit(0), "governed_by": F.lit(None).cast("string")})
    severity = {i.name: i.severity for i in a.policy.invariants}
    limits = []
    for r in own(constraints(a)).orderBy("ord").collect():
        if r["holds"] is not None:
            rows = violated.where(F.col("dimension") == F.lit(f"invariant:{r['name']}"))
            limits.append(obj({"invariantName": constant(r["name"]), "severity": constant(severity[r["name"]]), "holds": constant(r["holds"]), "indicatorValue": constant(0 if r["holds"] else 1), "weight": constant(r["weight"]), "violations": _findings(a, rows)}))
    stale = {r["ord"] for r in a.unmatched.select("ord").collect()}
    return obj({
        "subjectId": constant(subject_id), "governanceFingerprint": constant(a.policy.fingerprint()),
        "observed": obj({"dimensions": constant(dimensions), "totalEntropy": constant(value[0]), "maturity": constant(value[1]), "maturityLevel": constant(value[2]), "confidence": constant(_one(own(a.confidence), "value")[0])}),
        "changed": constant(changed),
        "violated": obj({"constraints": _join(limits), "invariantAggregate": constant(aggregate(own(a.aggregate).first())), "unmatchedExceptions": constant([exception(e) for i, e in enumerate(a.policy.exceptions) if i in stale])}),
        "risk": constant(risks), "findings": _findings(a, found), "unanswered": constant(gaps),
    })
