"""Invariants: a small predicate language, compiled once into columns, and their evaluation and weighting.

Equality is typed: a text never equals a number, and an int never equals a double, so such comparisons fold to false
when they are compiled. A property used outside its scope is refused when compiled, too.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.metrics import graphs, with_roles
from tesserae.schema import KEY, not_blank, require

# Properties by scope, with the kind of their values.
PROPERTIES = {
    "NODE": {"role": "role", "type": "type"},
    "EDGE": {"source_role": "role", "target_role": "role", "source_type": "type", "target_type": "type", "relation": "relation"},
    "GRAPH": {"metric": "double"},
}
_COLUMNS = {"role": "role", "type": "type", "source_role": "src_role", "target_role": "dst_role", "source_type": "src_type", "target_type": "dst_type", "relation": "relation"}


@dataclass(frozen=True)
class Value:
    """A property, or a constant with its kind: role, type, relation, string, int, double or boolean."""

    kind: str
    prop: str | None = None
    constant: Any = None
    metric: str | None = None


def prop(name: str) -> Value:
    for props in PROPERTIES.values():
        if name in props and name != "metric":
            return Value(props[name], prop=name)
    raise ValueError(f"unknown property {name}")


def metric(name: str) -> Value:
    return Value("double", prop="metric", metric=not_blank(name, "metric"))


def value(constant: Any, kind: str | None = None) -> Value:
    """A constant; kind tells roles, types and relations from plain text."""
    if kind is None:
        kind = "boolean" if isinstance(constant, bool) else "int" if isinstance(constant, int) else "double" if isinstance(constant, float) else "string"
    return Value(kind, constant=constant)


def role(name: str) -> Value:
    return value(name, "role")


@dataclass(frozen=True)
class Predicate:
    op: str
    args: tuple = field(default_factory=tuple)

    def values(self) -> list[Value]:
        out: list[Value] = []
        for a in self.args:
            out += a.values() if isinstance(a, Predicate) else [a] if isinstance(a, Value) else []
        return out


def _compare(op: str):
    return lambda a, b: Predicate(op, (a, b))


eq, not_eq, lt, lte, gt, gte = (_compare(op) for op in ("eq", "ne", "lt", "le", "gt", "ge"))


def in_(v: Value, *candidates: Value) -> Predicate:
    return Predicate("in", (v, *candidates))


def and_(*ps: Predicate) -> Predicate:
    require(len(ps) > 0, "and needs an operand")
    return Predicate("and", ps)


def or_(*ps: Predicate) -> Predicate:
    require(len(ps) > 0, "or needs an operand")
    return Predicate("or", ps)


def not_(p: Predicate) -> Predicate:
    return Predicate("not", (p,))


def always(holds: bool) -> Predicate:
    return Predicate("always", (holds,))


@dataclass(frozen=True)
class Invariant:
    name: str
    scope: str
    when: Predicate
    then: Predicate
    severity: str = "ERROR"

    def __post_init__(self) -> None:
        not_blank(self.name, "invariant name")
        require(self.scope in PROPERTIES, f"unknown scope {self.scope}")
        _validated(self.when, self.scope)
        _validated(self.then, self.scope)

    def metrics(self) -> set[str]:
        """Names of the metrics that the predicates read."""
        return {v.metric for v in (*self.when.values(), *self.then.values()) if v.metric}


def _validated(p: Predicate, scope: str) -> None:
    """Refuses properties of another scope, and order comparisons of what isn't a number; needs no session."""
    for v in p.values():
        require(v.prop is None or v.prop in PROPERTIES[scope], f"{v.prop} is no property of {scope} scope")
    if p.op in ("lt", "le", "gt", "ge"):
        require(all(v.kind in ("int", "double") for v in p.args), f"{p.op} compares numbers")
    for a in p.args:
        if isinstance(a, Predicate):
            _validated(a, scope)


def _column(v: Value, scope: str, metrics: dict[str, Column]) -> Column:
    if v.prop is None:
        return F.lit(v.constant)
    if v.prop == "metric":
        return metrics.get(v.metric, F.col(v.metric))
    return F.col(_COLUMNS[v.prop])


def compiled(p: Predicate, scope: str, metrics: dict[str, Column]) -> Column:
    """The predicate as a boolean column over the scope's rows."""
    if p.op == "always":
        return F.lit(bool(p.args[0]))
    if p.op in ("and", "or"):
        out = compiled(p.args[0], scope, metrics)
        for a in p.args[1:]:
            c = compiled(a, scope, metrics)
            out = (out & c) if p.op == "and" else (out | c)
        return out
    if p.op == "not":
        return ~compiled(p.args[0], scope, metrics)
    columns = [_column(v, scope, metrics) for v in p.args]
    same = lambda i: columns[0].eqNullSafe(columns[i]) if p.args[0].kind == p.args[i].kind else F.lit(False)
    if p.op in ("eq", "ne"):
        return same(1) if p.op == "eq" else ~same(1)
    if p.op == "in":
        out = F.lit(False)
        for i in range(1, len(columns)):
            out = out | same(i)
        return out
    a, b = (c.cast("double") for c in columns)
    return {"lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[p.op]


def no_presentation_to_persistence() -> Invariant:
    return Invariant("no_presentation_to_persistence", "EDGE", eq(prop("source_role"), role("PRESENTATION")), not_eq(prop("target_role"), role("PERSISTENCE")))


def entropy_budget(limit: float) -> Invariant:
    return Invariant("entropy_budget", "GRAPH", always(True), lte(metric("total_entropy"), value(float(limit))))


# --- rules as rows -----------------------------------------------------------

#: A row for each part of a rule's two predicates. path numbers the parts from the root on, "" being the root, "0" its first operand, "0.1" that one's second.
RULES = "name string, scope string, severity string, side string, path string, op string, kind string, prop string, metric string, constant string"
_OPERANDS = {"always": (0, 0), "not": (1, 1), "and": (1, None), "or": (1, None), "in": (1, None)} | {op: (2, 2) for op in ("eq", "ne", "lt", "le", "gt", "ge")}
_READ = {"int": int, "double": float, "boolean": lambda t: {"true": True, "false": False}[t]}


def _rows(p: Predicate, path: str) -> list[tuple]:
    """(path, op, kind, prop, metric, constant) of a predicate and what is in it."""
    if p.op == "always":
        return [(path, "always", "boolean", None, None, str(bool(p.args[0])).lower())]
    out: list[tuple] = [(path, p.op, None, None, None, None)]
    for i, a in enumerate(p.args):
        at = f"{path}.{i}".lstrip(".")
        if isinstance(a, Predicate):
            out += _rows(a, at)
        else:
            text = None if a.prop else str(a.constant).lower() if a.kind == "boolean" else repr(a.constant) if a.kind == "double" else str(a.constant)
            out.append((at, "value", a.kind, a.prop, a.metric, text))
    return out


def rules_table(spark: SparkSession, rules: Sequence[Invariant]) -> DataFrame:
    """Declared invariants as rows of RULES; from_rules() gives them back."""
    rows = [(r.name, r.scope, r.severity, side, *x) for r in rules for side, p in (("when", r.when), ("then", r.then)) for x in _rows(p, "")]
    return spark.createDataFrame(rows, RULES)


def _built(parts: dict[tuple[int, ...], Any], at: tuple[int, ...], where: str) -> Predicate | Value:
    r = parts.pop(at, None)
    require(r is not None, f"{where} lacks the part {'.'.join(map(str, at)) or 'at its root'}")
    below = sorted(k for k in parts if len(k) == len(at) + 1 and k[: len(at)] == at)
    require([k[-1] for k in below] == list(range(len(below))), f"the operands of {r['op']} in {where} aren't numbered from 0 on")
    if r["op"] == "value":
        require(not below, f"a value in {where} has operands")
        if r["prop"] == "metric":
            return metric(r["metric"])
        if r["prop"] is not None:
            v = prop(r["prop"])
            require(r["kind"] in (None, v.kind), f"{r['prop']} in {where} is a {v.kind}")
            return v
        require(r["constant"] is not None and r["kind"] in ("role", "type", "relation", "string", *_READ), f"a constant in {where} needs a kind and a text")
        try:
            return value(_READ.get(r["kind"], str)(r["constant"]), r["kind"])
        except (KeyError, ValueError):
            raise ValueError(f"{r['constant']!r} in {where} is no {r['kind']}") from None
    require(r["op"] in _OPERANDS, f"unknown operator {r['op']} in {where}")
    low, high = _OPERANDS[r["op"]]
    require(len(below) >= low and (high is None or len(below) <= high), f"{r['op']} in {where} has {len(below)} operands")
    if r["op"] == "always":
        require(r["constant"] in ("true", "false"), f"always in {where} is true or false")
        return always(r["constant"] == "true")
    args = tuple(_built(parts, k, where) for k in below)
    wanted = Predicate if r["op"] in ("and", "or", "not") else Value
    require(all(isinstance(a, wanted) for a in args), f"{r['op']} in {where} takes {'predicates' if wanted is Predicate else 'values'}")
    return Predicate(r["op"], args)


def from_rules(table: DataFrame) -> tuple[Invariant, ...]:
    """The invariants that rows of RULES declare, by name; what doesn't make a rule, by its form, its types or its scope, is refused.

    The rows of declared rules are few; they become columns, and the rules run like all others.
    """
    rules: dict[str, dict] = {}
    for r in table.select(*[c.split()[0] for c in RULES.split(", ")]).orderBy("name", "side", "path").collect():
        rule = rules.setdefault(not_blank(r["name"], "rule name"), {"scope": r["scope"], "severity": r["severity"], "when": {}, "then": {}})
        require((rule["scope"], rule["severity"]) == (r["scope"], r["severity"]), f"{r['name']} has two scopes or severities")
        require(r["side"] in ("when", "then"), f"unknown side {r['side']} of {r['name']}")
        require(r["path"] is not None and all(x.isdigit() for x in r["path"].split(".") if r["path"]), f"no path of {r['name']}: {r['path']}")
        at = tuple(int(x) for x in r["path"].split(".")) if r["path"] else ()
        require(at not in rule[r["side"]], f"{r['name']} has the part {r['path']} twice")
        rule[r["side"]][at] = r
    out = []
    for name, rule in rules.items():
        sides = {}
        for side in ("when", "then"):
            parts = rule[side]
            sides[side] = _built(parts, (), f"{name}.{side}")
            require(isinstance(sides[side], Predicate) and not parts, f"{name}.{side} isn't one predicate")
        out.append(Invariant(name, rule["scope"], sides["when"], sides["then"], rule["severity"] or "ERROR"))
    return tuple(out)


VIOLATION = ["name", "kind", "node_id", "source_id", "target_id", "relation"]


def violations(invariants: Sequence[Invariant], nodes: DataFrame, edges: DataFrame, metrics: DataFrame | None = None, numbered: bool = False, joined: DataFrame | None = None) -> DataFrame:
    """(key, name, kind, node_id, source_id, target_id, relation) of every violation; metrics has one row per graph.

    With numbered also seq, the number of the node or edge, which tells equal edges apart. joined gives the edges with roles, where they are made already.

    All invariants of a scope run over one scan of its rows. A graph whose metric is NULL has the invariant skipped.
    """
    spark = nodes.sparkSession
    null = lambda: F.lit(None).cast("string")
    out = spark.createDataFrame([], "subject_id string, scan_id string, name string, kind string, node_id string, source_id string, target_id string, relation string" + ", seq bigint" * numbered)
    for scope, rows in (("NODE", nodes), ("EDGE", edges), ("GRAPH", metrics)):
        mine = [i for i in invariants if i.scope == scope]
        if not mine:
            continue
        require(rows is not None, "a graph-scope invariant needs metrics")
        if scope == "EDGE":
            rows = joined if joined is not None else with_roles(edges.select(*KEY, "edge_seq", "src_resolved", "src_id", "dst_resolved", "dst_id", "relation"), nodes)
        some, broken = _broken(mine, scope)
        # a filter is compiled and, what of it asks for one end's role, put before the joins; the list is interpreted, for what is left
        rows = rows.where(some)
        ids = {"NODE": ("node", F.col("id"), null(), null(), null()), "EDGE": ("edge", null(), F.col("src_id"), F.col("dst_id"), F.col("relation")), "GRAPH": ("graph", null(), null(), null(), null())}[scope]
        seq = {"NODE": F.col("node_seq"), "EDGE": F.col("edge_seq")}.get(scope, F.lit(None).cast("bigint")) if numbered else None
        found = rows.select(*KEY, F.explode(broken).alias("name"), F.lit(ids[0]).alias("kind"), *[c.alias(n) for c, n in zip(ids[1:], VIOLATION[2:])], *([seq.alias("seq")] if numbered else []))
        out = out.unionByName(found)
    return out


def _broken(mine: Sequence[Invariant], scope: str) -> tuple[Column, Column]:
    """(whether a row of the scope breaks an invariant, the names of those that it breaks)."""
    broken, some = [], F.lit(False)
    for i in mine:
        bad = compiled(i.when, scope, {}) & ~compiled(i.then, scope, {})
        for m in sorted(i.metrics()) if scope == "GRAPH" else ():
            bad = F.col(m).isNotNull() & bad
        broken.append(F.when(bad, F.lit(i.name)))
        some = some | bad
    return some, F.filter(F.array(*broken), lambda x: x.isNotNull())


def counted(invariants: Sequence[Invariant], nodes: DataFrame, profile: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """(key, name, n): how many violations() there are of each invariant that has some; edges are counted by their profile, metrics.edge_profile()."""
    out = nodes.sparkSession.createDataFrame([], "subject_id string, scan_id string, name string, n bigint")
    for scope, rows in (("NODE", nodes), ("EDGE", profile), ("GRAPH", metrics)):
        mine = [i for i in invariants if i.scope == scope]
        if not mine:
            continue
        require(rows is not None, "a graph-scope invariant needs metrics")
        rows = rows.where("src_role is not null") if scope == "EDGE" else rows.withColumn("n", F.lit(1).cast("bigint"))
        some, broken = _broken(mine, scope)
        out = out.unionByName(rows.where(some).select(*KEY, F.explode(broken).alias("name"), "n"))
    return out.groupBy(*KEY, "name").agg(F.sum("n").alias("n"))


def indicators(invariants: Sequence[Invariant], found: DataFrame, nodes: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """(key, ord, name, scope, evaluated, violations, indicator, holds) of every declared invariant in every graph; found is from violations() or counted().

    Not evaluated, all three NULL: the invariant reads a metric that is undefined for the graph.
    """
    base = graphs(nodes) if metrics is None else graphs(nodes).join(metrics, KEY, "left")
    rows = []
    for i, inv in enumerate(invariants):
        ready = F.lit(True)
        for m in sorted(inv.metrics()):
            ready = ready & (F.col(m).isNotNull() if metrics is not None and m in metrics.columns else F.lit(False))
        rows.append(F.struct(F.lit(i).alias("ord"), F.lit(inv.name).alias("name"), F.lit(inv.scope).alias("scope"), ready.alias("evaluated")))
    if not rows:
        return base.select(*KEY, F.lit(0).alias("ord"), F.lit("").alias("name"), F.lit("").alias("scope"), F.lit(True).alias("evaluated"), F.lit(0).cast("long").alias("violations"), F.lit(0).alias("indicator"), F.lit(True).alias("holds")).limit(0)
    declared = base.select(*KEY, F.explode(F.array(*rows)).alias("i")).select(*KEY, "i.*")
    counts = found if "n" in found.columns else found.groupBy(*KEY, "name").agg(F.count("*").alias("n"))
    out = declared.join(counts, [*KEY, "name"], "left")
    n = F.when(F.col("evaluated"), F.coalesce("n", F.lit(0)))
    return out.select(*KEY, "ord", "name", "scope", "evaluated", n.alias("violations"), F.when(n > 0, 1).when(n == 0, 0).cast("int").alias("indicator"), (n == 0).alias("holds"))


def weighted(results: DataFrame, weights: Sequence[tuple[str, float]], declared: Sequence[str]) -> DataFrame:
    """(key, value, contributions, unevaluated): value is NULL without weights, or where a weighted invariant was skipped.

    Every declared invariant needs a weight once any has one, and a weight must name a declared invariant.
    """
    if weights:
        missing, unknown = [n for n in declared if n not in dict(weights)], [n for n, _ in weights if n not in declared]
        require(not missing, f"invariants without a weight: {missing}")
        require(not unknown, f"weights that name no invariant: {unknown}")
    aggs = []
    total = F.lit(0.0)
    known = F.lit(bool(weights))
    parts, skipped = [], []
    for n, w in weights:
        aggs.append(F.max(F.when(F.col("name") == n, F.col("indicator"))).alias(f"i_{len(aggs)}"))
        i = F.col(f"i_{len(aggs) - 1}")
        total = total + F.coalesce(i * F.lit(float(w)), F.lit(0.0))
        if w:
            known = known & i.isNotNull()
            skipped.append(F.when(i.isNull(), F.lit(n)))
        parts.append(F.when(i.isNotNull(), F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight"), i.alias("indicator"), (i * F.lit(float(w))).alias("contribution"))))
    some = lambda xs, kind: F.filter(F.array(*xs), lambda x: x.isNotNull()) if xs else F.array().cast(kind)
    rows = results.groupBy(*KEY).agg(*(aggs or [F.count("*").alias("_n")]))
    return rows.select(*KEY, F.when(known, total).alias("value"), some(parts, "array<struct<name:string,weight:double,indicator:int,contribution:double>>").alias("contributions"), some(skipped, "array<string>").alias("unevaluated"))


def skipped(results: DataFrame) -> DataFrame:
    """(key, skipped): names of the invariants that weren't evaluated, as declared."""
    return results.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.when(~F.col("evaluated"), F.struct("ord", "name")))), lambda x: x["name"]).alias("skipped"))


def literal_metrics(spark: SparkSession, rows: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(list(rows), "subject_id string, scan_id string, " + ", ".join(f"{n} double" for n in names))
