"""Governance declarations: frozen, validated, nothing defaulted in silence; and what follows from them alone."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.javatext import double_text
from tesserae.schema import RELATIONS, ROLES, not_blank, require


@dataclass(frozen=True)
class LayerPolicy:
    """Which role may use which: allowed maps a source role to its targets; known lists the roles that count at all.

    Nothing is derived: a known role without an entry permits nothing, and a role outside known may not be named.
    """

    known: tuple[str, ...]
    allowed: dict[str, tuple[str, ...]]

    def __post_init__(self) -> None:
        for r in (*self.known, *self.allowed, *(t for ts in self.allowed.values() for t in ts)):
            require(r in ROLES, f"unknown role {r}")
        require(len(set(self.known)) == len(self.known), "a role is known twice")
        for s, ts in self.allowed.items():
            require(s in self.known and all(t in self.known for t in ts), f"the matrix names a role outside the known ones at {s}")

    def knows(self, src: str, dst: str) -> Column:
        return F.coalesce(F.col(src).isin(*self.known) & F.col(dst).isin(*self.known), F.lit(False)) if self.known else F.lit(False)

    def allows(self, src: str, dst: str) -> Column:
        pairs = [f"{s}>{t}" for s, ts in self.allowed.items() for t in ts]
        return F.concat_ws(">", src, dst).isin(*pairs) if pairs else F.lit(False)

    def text(self) -> str:
        """Roles in their declared vocabulary order, for the fingerprint."""
        inorder = lambda rs: "[" + ", ".join(r for r in ROLES if r in rs) + "]"
        rows = [f"known={inorder(self.known)}"] + [f"{r}->{inorder(self.allowed[r])}" for r in ROLES if r in self.allowed]
        return "{" + ";".join(rows) + "}"


@dataclass(frozen=True)
class Subsystem:
    name: str
    id_prefix: str
    policy: LayerPolicy | None = None

    def __post_init__(self) -> None:
        not_blank(self.name, "subsystem name")
        not_blank(self.id_prefix, "id prefix")


#: Characters of prefixes and names that an index may hold as constants; larger tables of prefixes are joined.
INDEXED = 4 << 20
#: So few prefixes are compared one by one, which is compiled; the search is interpreted row by row.
COMPARED = 16
_APART = "\x00"


def overlapping(prefixes: Sequence[str]) -> tuple[str, str] | None:
    """Two prefixes of which one begins with the other, if there are any: in their order such two lie next to each other."""
    ordered = sorted(prefixes, key=str.encode)
    return next(((a, b) for a, b in zip(ordered, ordered[1:]) if b.startswith(a)), None)


def constants(texts: Sequence[str]) -> Column:
    """Texts as one constant: an expression of the same size for any number of them."""
    require(not any(_APART in t for t in texts), "a prefix or name holds the character 0")
    return F.split(F.lit(_APART.join(texts)), _APART) if texts else F.array().cast("array<string>")


class PrefixIndex:
    """Which of many exclusive prefixes an id begins with: binary search among the sorted prefixes, inside one expression.

    The greatest prefix that isn't above an id is the only one that it can begin with. The plan has the same size for any number of prefixes.
    """

    def __init__(self, entries: Sequence[tuple[str, str]]) -> None:
        """entries are (prefix, name)."""
        self.entries = sorted(entries, key=lambda e: e[0].encode())
        clash = overlapping([e[0] for e in self.entries])
        require(clash is None, f"the prefixes {clash} overlap")
        require(sum(len(a) + len(b) for a, b in self.entries) <= INDEXED, "too many prefixes for an index: join them as a table")

    def place(self, id_: Column) -> Column:
        """The place in entries of the prefix that an id has, NULL without one."""
        if not self.entries:
            return F.lit(None).cast("int")
        bounds = constants([e[0] for e in self.entries])
        n = len(self.entries)

        def halve(acc: Column, _: Column) -> Column:
            middle = F.shiftright(acc["low"] + acc["high"], 1)
            below = F.get(bounds, middle) <= id_
            go = acc["low"] < acc["high"]
            return F.struct(F.when(go & below, middle + 1).otherwise(acc["low"]).alias("low"), F.when(go & ~below, middle).otherwise(acc["high"]).alias("high"))

        begin = F.struct(F.lit(0).alias("low"), F.lit(n).alias("high"))
        at = F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length())), begin, halve, lambda acc: acc["low"] - 1)
        return F.transform(F.array(at), lambda i: F.when((i >= 0) & F.startswith(id_, F.get(bounds, i)), i))[0]

    def compared(self, id_: Column) -> Column:
        """place(), without a search where there are few prefixes: for what is asked of every edge."""
        if not 0 < len(self.entries) <= COMPARED:
            return self.place(id_)
        return F.coalesce(*[F.when(F.startswith(id_, F.lit(e[0])), F.lit(i)) for i, e in enumerate(self.entries)])

    def name(self, id_: Column) -> Column:
        return self.named(self.place(id_))

    def named(self, place: Column) -> Column:
        return F.get(constants([e[1] for e in self.entries]), place) if self.entries else F.lit(None).cast("string")


def claimed_by(nodes: DataFrame, prefixes: DataFrame, id_col: str = "id", name: str = "claimed_by", indexed: int = INDEXED) -> DataFrame:
    """nodes with the name of the prefix that the id begins with; prefixes is a table (prefix, name) of any size, without overlaps.

    Up to indexed characters in all, which is checked, the table becomes an index; beyond it ids meet prefixes by equality, once for each length that
    prefixes have, and ids that none claims are added again.
    """
    size = prefixes.agg(F.coalesce(F.sum(F.length("prefix") + F.length("name")), F.lit(0))).first()[0]
    if size <= indexed:
        return nodes.withColumn(name, PrefixIndex([(r["prefix"], r["name"]) for r in prefixes.select("prefix", "name").collect()]).name(F.col(id_col)))
    lengths = [r[0] for r in prefixes.select(F.length("prefix")).distinct().orderBy(F.length("prefix")).collect()]  # at most as many as the longest has characters
    table = prefixes.select(F.col("prefix").alias("_head"), F.col("name").alias(name))
    own = prefixes.select(F.explode(F.array(*[F.when(F.length("prefix") > k, F.substring("prefix", 1, k)) for k in lengths])).alias("_head"))
    clash = own.join(table, "_head", "left_semi").limit(1).collect()
    require(not clash and prefixes.count() == prefixes.select("prefix").distinct().count(), f"the prefixes overlap: {clash}")
    ids = nodes.select(F.col(id_col).alias("_id")).distinct()
    probes = ids.select("_id", F.explode(F.array_distinct(F.transform(F.array(*map(F.lit, lengths)), lambda k: F.substring(F.col("_id"), F.lit(1), k)))).alias("_head"))
    found = probes.join(table, "_head").select("_id", name)
    return nodes.join(found, nodes[id_col] == found["_id"], "left").drop("_id")


@dataclass(frozen=True)
class Subsystems:
    """Declared subsystems; prefixes are plain and exclusive, so that at most one claims a node."""

    declared: tuple[Subsystem, ...] = ()

    def __post_init__(self) -> None:
        names = [s.name for s in self.declared]
        require(len(set(names)) == len(names), "a subsystem is declared twice")
        clash = overlapping([s.id_prefix for s in self.declared])
        require(clash is None, f"the prefixes {clash} overlap")

    def claiming(self, id_col: str = "id") -> Column:
        """The name of the subsystem whose prefix an id has, NULL without one."""
        return PrefixIndex([(s.id_prefix, s.name) for s in self.declared]).name(F.col(id_col))

    def claimed(self, nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("subsystem", self.claiming())


def linear(e: Column) -> Column:
    return e


@dataclass(frozen=True)
class Calibration:
    """A calibration function of a dimension's value: linear, power(alpha) or sigmoid(k, t)."""

    kind: str = "linear"
    params: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        need = {"linear": set(), "power": {"alpha"}, "sigmoid": {"k", "t"}}
        require(self.kind in need, f"unknown calibration {self.kind}")
        require(set(self.params) == need[self.kind], f"{self.kind} takes {sorted(need[self.kind])}")

    def apply(self, e: Column) -> Column:
        if self.kind == "power":
            return F.pow(e, F.lit(float(self.params["alpha"])))
        if self.kind == "sigmoid":
            return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.lit(float(self.params["k"])) * (e - F.lit(float(self.params["t"])))))
        return e

    def name(self) -> str:
        if self.kind == "power":
            return f"power(alpha={double_text(self.params['alpha'])})"
        if self.kind == "sigmoid":
            return f"sigmoid(k={double_text(self.params['k'])},t={double_text(self.params['t'])})"
        return "linear"


@dataclass(frozen=True)
class CustomCalibration:
    """A calibration function of one's own: a name, which the fingerprint and the reports show, and columns in, columns out."""

    label: str
    function: Callable[[Column], Column]

    def __post_init__(self) -> None:
        not_blank(self.label, "calibration name")
        require(callable(self.function), "a calibration is a function of a column")

    def apply(self, e: Column) -> Column:
        return self.function(e)

    def name(self) -> str:
        return self.label


def weight(value: float, what: str) -> float:
    require(isinstance(value, (int, float)) and not math.isnan(value) and value >= 0, f"{what} must be a number of 0 or more")
    return float(value)


@dataclass(frozen=True)
class WeightedDimension:
    name: str
    weight: float
    calibration: Calibration | CustomCalibration = Calibration()

    def __post_init__(self) -> None:
        not_blank(self.name, "dimension")
        weight(self.weight, "weight")
        require(callable(getattr(self.calibration, "apply", None)) and callable(getattr(self.calibration, "name", None)), "a calibration has apply() and name()")


@dataclass(frozen=True)
class CalibrationProfile:
    """Weighted dimensions whose weights sum to 1 within 1e-9."""

    dimensions: tuple[WeightedDimension, ...]

    def __post_init__(self) -> None:
        require(len({d.name for d in self.dimensions}) == len(self.dimensions), "a dimension is weighted twice")
        require(abs(sum(d.weight for d in self.dimensions) - 1.0) <= 1e-9, "weights must sum to 1")


@dataclass(frozen=True)
class ExceptionTarget:
    """A node by id, or an edge by source, target and relation."""

    node_id: str | None = None
    source_id: str | None = None
    target_id: str | None = None
    relation: str | None = None

    def __post_init__(self) -> None:
        edge = (self.source_id, self.target_id, self.relation)
        if self.node_id is not None:
            not_blank(self.node_id, "node id")
            require(edge == (None, None, None), "a target is a node or an edge")
        else:
            for x in edge:
                not_blank(x, "an edge target's parts")
            require(self.relation in RELATIONS, f"unknown relation {self.relation}")

    def text(self) -> str:
        return f"OfNode[nodeId={self.node_id}]" if self.node_id is not None else f"OfEdge[sourceId={self.source_id}, targetId={self.target_id}, relation={self.relation}]"


@dataclass(frozen=True)
class ApprovedException:
    target: ExceptionTarget
    reason: str
    approved_by: str

    def __post_init__(self) -> None:
        not_blank(self.reason, "reason")
        not_blank(self.approved_by, "approved_by")


@dataclass(frozen=True)
class GovernancePolicy:
    """All that an organisation declares. Weights and exceptions may be empty, but never by default of the engine."""

    layer_policy: LayerPolicy
    subsystems: Subsystems
    include_self_cycles: bool
    calibration: CalibrationProfile
    invariants: tuple
    invariant_weights: tuple[tuple[str, float], ...]
    beta: float | None
    drift_weights: tuple[tuple[str, float], ...]
    exceptions: tuple[ApprovedException, ...]

    def __post_init__(self) -> None:
        for rows, what in ((self.invariant_weights, "invariant"), (self.drift_weights, "dimension")):
            require(len({n for n, _ in rows}) == len(rows), f"a {what} is weighted twice")
            for n, w in rows:
                not_blank(n, what)
                weight(w, f"the weight of {n}")
        require((self.beta is None) == (not self.drift_weights), "beta and drift weights are declared together")
        if self.beta is not None:
            weight(self.beta, "beta")
        targets = [e.target for e in self.exceptions]
        require(len(set(targets)) == len(targets), "an exception is declared twice")
        names = [i.name for i in self.invariants]
        require(len(set(names)) == len(names), "an invariant is declared twice")

    def canonical(self) -> str:
        """The declaration as text, predicates left out; equal declarations give equal text."""
        listed = lambda xs: "[" + ",".join(xs) + "]"
        subs = listed(f"{s.name}@{s.id_prefix}->{s.policy.text() if s.policy else 'default'}" for s in self.subsystems.declared)
        cal = listed(f"{d.name}={double_text(d.weight)}:{d.calibration.name()}" for d in self.calibration.dimensions)
        inv = listed(f"{i.name}:{i.scope}:{i.severity}:[{', '.join(sorted(i.metrics()))}]" for i in self.invariants)
        beta = "OptionalDouble.empty" if self.beta is None else f"OptionalDouble[{double_text(self.beta)}]"
        rows = {
            "layerPolicy": self.layer_policy.text(), "subsystems": subs, "includeSelfCyclesInCycleEntropy": str(self.include_self_cycles).lower(), "calibration": cal, "invariants": inv,
            "invariantWeights": listed(f"{n}={double_text(w)}" for n, w in self.invariant_weights), "driftSensitivity": f"beta:{beta}" + listed(f"{n}={double_text(w)}" for n, w in self.drift_weights),
            "approvedExceptions": listed(f"{e.target.text()}/{e.reason}/{e.approved_by}" for e in self.exceptions),
        }
        return "\n".join(f"{k}={v}" for k, v in rows.items())

    def fingerprint(self) -> str:
        """SHA-256 of canonical(). Differing fingerprints prove differing policies; equal ones don't prove equal predicates."""
        return hashlib.sha256(self.canonical().encode()).hexdigest()

    def exceptions_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, e.target.node_id, e.target.source_id, e.target.target_id, e.target.relation, e.reason, e.approved_by) for i, e in enumerate(self.exceptions)]
        return spark.createDataFrame(rows, "ord int, node_id string, source_id string, target_id string, relation string, reason string, approved_by string")


#: The findings that an exception can excuse; cycles and whole-graph violations name nothing that it could.
FINDING = ["subject_id", "scan_id", "dimension", "node_id", "source_id", "target_id", "relation"]
#: What an exception can name.
NAMED = "node_id is not null or (source_id is not null and target_id is not null)"


def excused(findings: DataFrame, exceptions: DataFrame) -> DataFrame:
    """findings ⋈ exceptions by exact target; findings has the FINDING columns. The declared table is small: it is broadcast up to its own size limit by the optimizer."""
    e = exceptions.select("ord", F.col("node_id").alias("n"), F.col("source_id").alias("s"), F.col("target_id").alias("t"), F.col("relation").alias("r"), "reason", "approved_by")
    same = F.col("node_id").eqNullSafe(F.col("n")) & F.col("source_id").eqNullSafe(F.col("s")) & F.col("target_id").eqNullSafe(F.col("t")) & F.col("relation").eqNullSafe(F.col("r"))
    return findings.where(NAMED).join(e, same).select(*FINDING, "ord", "reason", "approved_by")


def unmatched(exceptions: DataFrame, found: DataFrame) -> DataFrame:
    """Declared exceptions that excuse nothing any more."""
    return exceptions.join(found.select("ord").distinct(), "ord", "left_anti")


Rule = Callable[[], Column]
