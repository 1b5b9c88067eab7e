"""The canonical tables of an architecture graph, its closed vocabularies, and their checks.

A graph is a typed property multigraph: nodes keyed by id, edges without a key (equal edges are legal and kept). Many
graphs live in one pair of tables, told apart by (subject_id, scan_id).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

KEY = ["subject_id", "scan_id"]
EVIDENCE = "struct<source_adapter:string,description:string,location:string,fidelity:string,execution_context:string,attributes:map<string,string>>"
NODES = f"subject_id string, scan_id string, node_seq bigint, id string, type string, role string, attributes map<string,string>, evidence array<{EVIDENCE}>"
EDGES = f"subject_id string, scan_id string, edge_seq bigint, src_resolved boolean, src_id string, src_desc string, dst_resolved boolean, dst_id string, dst_desc string, relation string, provenance array<{EVIDENCE}>"
NODE_FACTS = f"subject_id string, scan_id string, id string, type string, attributes map<string,string>, evidence array<{EVIDENCE}>"
EDGE_FACTS = f"subject_id string, scan_id string, source_key string, source_desc string, target_key string, target_desc string, relation string, provenance array<{EVIDENCE}>"

# The closed vocabularies, in their declared order.
NODE_TYPES = ("MODULE", "COMPONENT", "FUNCTION", "DATA", "VIEW", "CONFIG", "SCRIPT")
ROLES = ("PRESENTATION", "APPLICATION", "DOMAIN", "PERSISTENCE", "INFRASTRUCTURE", "EXTERNAL", "UNKNOWN")
RELATIONS = ("CALL", "DEPENDS", "READS", "WRITES", "EXTENDS", "IMPLEMENTS", "RENDERS", "CONFIGURES", "COMMUNICATES", "MEMBER_OF")
FIDELITIES = ("L1_SYNTAX", "L2_SYMBOL_RESOLVED", "L3_DATA_FLOW_AWARE")
CONTEXTS = ("SINGLE", "ITERATED", "UNKNOWN")
DIMENSIONS = ("layer", "cycle", "persistence", "security")


def require(ok: bool, why: str) -> None:
    if not ok:
        raise ValueError(why)


def not_blank(value: str | None, what: str) -> str:
    require(value is not None and bool(value.strip()), f"{what} must not be blank")
    return value


def evidence(source_adapter: str, description: str, location: str | None = None, fidelity: str = "L1_SYNTAX", execution_context: str = "UNKNOWN", attributes: dict[str, str] | None = None) -> Row:
    """One evidence record; adapter and description are mandatory, the execution context defaults to UNKNOWN."""
    not_blank(source_adapter, "source_adapter")
    not_blank(description, "description")
    require(fidelity in FIDELITIES, f"unknown fidelity {fidelity}")
    require(execution_context in CONTEXTS, f"unknown execution context {execution_context}")
    return Row(source_adapter=source_adapter, description=description, location=location, fidelity=fidelity, execution_context=execution_context, attributes=dict(attributes or {}))


def graph(spark: SparkSession, nodes: Sequence[tuple], edges: Sequence[tuple], subject_id: str = "subject", scan_id: str = "scan") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from literals: nodes are (id, type[, role[, evidence[, attributes]]]), edges (source, target, relation[, evidence]).

    A source or target is an id, or ("unresolved", description). A later node of an id replaces an earlier one and keeps its
    place. A resolved end without a node is refused.
    """
    by_id: dict[str, tuple] = {}
    for n in nodes:
        n = (*n, *(None,) * (5 - len(n)))
        not_blank(n[0], "node id")
        require(n[1] in NODE_TYPES, f"unknown node type {n[1]}")
        require((n[2] or "UNKNOWN") in ROLES, f"unknown role {n[2]}")
        by_id[n[0]] = n
    rows = [(subject_id, scan_id, i, n[0], n[1], n[2] or "UNKNOWN", dict(n[4] or {}), list(n[3] or [])) for i, n in enumerate(by_id.values())]

    def end(x: str | tuple) -> tuple:
        if isinstance(x, tuple):
            return False, None, not_blank(x[1], "description")
        require(x in by_id, f"edge end {x} is no node")
        return True, x, None

    lines = []
    for i, e in enumerate(edges):
        require(e[2] in RELATIONS, f"unknown relation {e[2]}")
        lines.append((subject_id, scan_id, i, *end(e[0]), *end(e[1]), e[2], list(e[3] if len(e) > 3 else [])))
    return spark.createDataFrame(rows, NODES), spark.createDataFrame(lines, EDGES)


def checked(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same tables, which fail as they are read where a value is outside its vocabulary or an id is blank."""
    named = lambda c: F.col(c).rlike(r"\S")
    ok_node = F.coalesce(named("id") & F.col("type").isin(*NODE_TYPES) & F.col("role").isin(*ROLES), F.lit(False))
    ends = [F.when(F.col(f"{x}_resolved"), F.col(f"{x}_id").isNotNull()).otherwise(F.col(f"{x}_id").isNull() & named(f"{x}_desc")) for x in ("src", "dst")]
    ok_edge = F.coalesce(ends[0] & ends[1] & F.col("relation").isin(*RELATIONS), F.lit(False))

    def holding(df: DataFrame, ok: Column, what: str) -> DataFrame:
        return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"invalid {what}: "), F.to_json(F.struct(*[c for c in df.columns if c not in ("evidence", "provenance", "attributes")]))))))

    return holding(nodes, ok_node, "node"), holding(edges, ok_edge, "edge")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Resolved edge ends without a node: (subject_id, scan_id, id). Empty for a sound graph."""
    ends = edges.where("src_resolved").select(*KEY, F.col("src_id").alias("id")).union(edges.where("dst_resolved").select(*KEY, F.col("dst_id").alias("id")))
    return ends.distinct().join(nodes.select(*KEY, "id"), [*KEY, "id"], "left_anti")


def node(nodes: DataFrame, id_: str) -> DataFrame:
    return nodes.where(F.col("id") == id_)


def edges_from(edges: DataFrame, id_: str) -> DataFrame:
    return edges.where(F.col("src_resolved") & (F.col("src_id") == id_))


def edges_to(edges: DataFrame, id_: str) -> DataFrame:
    return edges.where(F.col("dst_resolved") & (F.col("dst_id") == id_))
