"""The ratio metrics of a graph and the confidence of each. A ratio with denominator 0 is NULL, never 0.

Findings keep whole rows; summaries aggregate the same predicate per (subject_id, scan_id), and start from the list of
graphs so that one without a relevant row has a row of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.governance import LayerPolicy, PrefixIndex, Subsystems
from tesserae.schema import KEY

LAYER_RELATIONS = ("CALL", "DEPENDS")
CYCLE_RELATIONS = ("CALL", "DEPENDS")
PERSISTENCE_RELATIONS = ("CALL",)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def graphs(nodes: DataFrame) -> DataFrame:
    return nodes.select(*KEY).distinct()


def summary(found: DataFrame, of: DataFrame, flag: str, flagged: str, value: str = "value") -> DataFrame:
    """(key, relevant, flagged, value) with a row for each graph of `of`; a row of found stands for n where it has such a column."""
    n = F.col("n") if "n" in found.columns else F.lit(1)
    counts = found.groupBy(*KEY).agg(F.sum(n).alias("relevant"), F.sum(F.when(F.col(flag), n).otherwise(0)).alias(flagged))
    out = of.join(counts, KEY, "left").select(*KEY, F.coalesce("relevant", F.lit(0)).alias("relevant"), F.coalesce(flagged, F.lit(0)).alias(flagged))
    return out.withColumn(value, ratio(F.col(flagged), F.col("relevant")))


def _met(edges: DataFrame, nodes: DataFrame, x: str, how: str = "inner") -> DataFrame:
    """edges with the role and type of one end, x being src or dst."""
    # the join compares the hash first, because ids begin alike; equal ids are still asked for
    at = lambda c: F.xxhash64(*KEY, c).alias("_at")
    side = nodes.select(at("id"), *KEY, F.col("id").alias(f"{x}_id"), F.col("role").alias(f"{x}_role"), F.col("type").alias(f"{x}_type"))
    # nodes are never broadcast (a stored table's files are many times smaller than its rows); ids are unique, so a task holds its even share of them
    return edges.select("*", at(f"{x}_id")).join(side.hint("shuffle_hash"), ["_at", *KEY, f"{x}_id"], how).drop("_at")


def with_roles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends resolved, and the role and type of either end."""
    return _met(_met(edges.where("src_resolved and dst_resolved"), nodes, "src"), nodes, "dst")


def edge_profile(nodes: DataFrame, edges: DataFrame, subsystems: Subsystems | None = None) -> DataFrame:
    """(key, relation, src_role, src_type, dst_role, dst_type, _judge, flagged, n): how many edges with both ends resolved are alike in all these.

    src_role is NULL where the source is no node; _judge is the place of the source's prefix, flagged as in persistence_edges(). All that counts
    edges can be read off it. Edges that leave like sources for one target are counted before they meet the target's role, so a busy target gets few rows.
    """
    calls = F.col("relation").isin(*PERSISTENCE_RELATIONS)
    rows = edges.where("src_resolved and dst_resolved").select(*KEY, "src_id", "dst_id", "relation", F.coalesce(calls & (iterated() > 0), F.lit(False)).alias("flagged"))
    rows = _met(rows.withColumn("_judge", _judges(subsystems)[0].compared(F.col("src_id"))), nodes, "src", "left")
    alike = [*KEY, "relation", "src_role", "src_type", "_judge", "flagged"]
    counted = rows.groupBy("dst_id", *alike).agg(F.count("*").alias("n"))
    return _met(counted, nodes, "dst").groupBy(*alike, "dst_role", "dst_type").agg(F.sum("n").alias("n"))


# --- layer -----------------------------------------------------------------


def layer_edges(nodes: DataFrame, edges: DataFrame, policy: LayerPolicy, subsystems: Subsystems | None = None, relations: Sequence[str] = LAYER_RELATIONS) -> DataFrame:
    """Relevant edges with governed_by (the subsystem whose matrix judges, NULL for the default) and violating.

    Relevant: of the relations, both ends resolved, both roles known to the policy that governs. The source's subsystem
    judges. The matrices are looked up as constants, so that no join is spent on them.
    """
    pruned = edges.where(F.col("relation").isin(*relations)).select(*KEY, "edge_seq", "src_resolved", "src_id", "dst_resolved", "dst_id", "relation")
    # who judges is asked before the joins, so that the source's id goes no further than its own join where nothing else needs it
    return judged(with_roles(pruned.withColumn("_judge", _judges(subsystems)[0].compared(F.col("src_id"))), nodes), policy, subsystems)


def _judges(subsystems: Subsystems | None) -> tuple[PrefixIndex, dict[str, LayerPolicy]]:
    """The subsystems with a matrix of their own, and the matrix of each by its name."""
    declared = [s for s in (subsystems.declared if subsystems else ()) if s.policy is not None]
    return PrefixIndex([(s.id_prefix, s.name) for s in declared]), {s.name: s.policy for s in declared}


def judged(found: DataFrame, policy: LayerPolicy, subsystems: Subsystems | None = None) -> DataFrame:
    """layer_edges() of edges of the relations that have roles already; _judge, where it is there, is the place of the source's prefix."""
    known, allowed = policy.knows("src_role", "dst_role"), policy.allows("src_role", "dst_role")
    index, policies = _judges(subsystems)
    if "_judge" not in found.columns:
        found = found.withColumn("_judge", index.compared(F.col("src_id")))
    # one lookup finds the subsystem, and there are as many branches as differing matrices, not as subsystems
    matrices: dict[str, list[int]] = {}
    for i, (_, name) in enumerate(index.entries):
        matrices.setdefault(policies[name].text(), []).append(i)
    for places in matrices.values():
        p, mine = policies[index.entries[places[0]][1]], F.coalesce(F.col("_judge").isin(*places), F.lit(False))
        known = F.when(mine, p.knows("src_role", "dst_role")).otherwise(known)
        allowed = F.when(mine, p.allows("src_role", "dst_role")).otherwise(allowed)
    # no matrix knows other roles; the optimizer asks this of the nodes, before they meet the edges
    some = sorted({r for p in (policy, *policies.values()) for r in p.known})
    for x in ("src_role", "dst_role"):
        found = found.where(F.col(x).isin(*some) if some else F.lit(False))
    return found.where(known).withColumn("governed_by", index.named(F.col("_judge"))).withColumn("violating", ~allowed).drop("_judge")


def layer_entropy(nodes: DataFrame, edges: DataFrame, policy: LayerPolicy, subsystems: Subsystems | None = None, relations: Sequence[str] = LAYER_RELATIONS) -> DataFrame:
    """(key, relevant, violating, value)."""
    return summary(layer_edges(nodes, edges, policy, subsystems, relations), graphs(nodes), "violating", "violations").withColumnRenamed("violations", "violating")


# --- persistence -------------------------------------------------------------


def iterated(provenance: str = "provenance") -> Column:
    return F.size(F.filter(provenance, lambda e: e["execution_context"] == "ITERATED"))


def persistence_edges(nodes: DataFrame, edges: DataFrame, relations: Sequence[str] = PERSISTENCE_RELATIONS) -> DataFrame:
    """Calls of PERSISTENCE nodes, with iterated_count and flagged (some evidence is ITERATED); the source's role doesn't matter."""
    pruned = edges.where(F.col("relation").isin(*relations) & F.col("src_resolved") & F.col("dst_resolved"))
    pruned = pruned.select(*KEY, "edge_seq", "src_id", "dst_id", "relation", F.coalesce(iterated(), F.lit(0)).alias("iterated_count"))
    target = nodes.where("role = 'PERSISTENCE'").select(*KEY, F.col("id").alias("dst_id"))
    return pruned.join(target, [*KEY, "dst_id"], "left_semi").withColumn("flagged", F.col("iterated_count") > 0)


def persistence_entropy(nodes: DataFrame, edges: DataFrame, relations: Sequence[str] = PERSISTENCE_RELATIONS) -> DataFrame:
    """(key, relevant, flagged, value, weighted): weighted counts every ITERATED record and may exceed 1."""
    counts = persistence_edges(nodes, edges, relations).groupBy(*KEY).agg(F.count("*").alias("relevant"), F.count_if("flagged").alias("flagged"), F.sum("iterated_count").alias("records"))
    out = graphs(nodes).join(counts, KEY, "left").na.fill(0, ["relevant", "flagged", "records"])
    return out.select(*KEY, "relevant", "flagged", ratio(F.col("flagged"), F.col("relevant")).alias("value"), ratio(F.col("records"), F.col("relevant")).alias("weighted"))


# --- security ----------------------------------------------------------------


@dataclass(frozen=True)
class SecurityRule:
    """A rule on one node: verdict() is NULL where it has no opportunity, else whether the node is weak."""

    name: str
    concern: str
    verdict: Callable[[], Column]

    def __post_init__(self) -> None:
        import re

        if not re.fullmatch(r"[a-z0-9]+(-[a-z0-9]+)*", self.concern):
            raise ValueError(f"concern {self.concern!r} is not in canonical form")


def _encoding(e: Column) -> Column:
    """true for unescaped output, false for escaped; unescaped is asked first, because its words contain the other's."""
    named = F.try_element_at(e["attributes"], F.lit("encoding"))
    says = lambda word: F.coalesce(named == word, F.lit(False)) | F.coalesce(e["description"].contains(f"{word} output"), F.lit(False))
    return F.when(says("unescaped"), F.lit(True)).when(says("escaped"), F.lit(False))


def _view_output() -> Column:
    decided = F.filter(F.transform("evidence", _encoding), lambda v: v.isNotNull())
    return F.when(F.col("type") == "VIEW", F.get(decided, F.lit(0)))


SECURITY_RULES = (SecurityRule("xss-unencoded-view-output", "xss", _view_output),)


def security_findings(nodes: DataFrame, rules: Sequence[SecurityRule] = SECURITY_RULES) -> DataFrame:
    """(key, id, rule, concern, weak) for each node that is an opportunity of a rule, in the rules' order."""
    each = [F.struct(F.lit(i).alias("rule_order"), F.lit(r.name).alias("rule"), F.lit(r.concern).alias("concern"), r.verdict().alias("weak")) for i, r in enumerate(rules)]
    if not each:
        return nodes.select(*KEY, "id", F.lit("").alias("rule"), F.lit("").alias("concern"), F.lit(False).alias("weak")).limit(0)
    return nodes.select(*KEY, "id", F.explode(F.array(*each)).alias("r")).where("r.weak is not null").select(*KEY, "id", "r.rule", "r.concern", "r.weak")


def security_entropy(nodes: DataFrame, rules: Sequence[SecurityRule] = SECURITY_RULES) -> DataFrame:
    return summary(security_findings(nodes, rules), graphs(nodes), "weak", "flagged")


# --- confidence --------------------------------------------------------------


def confidence(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, total, resolved, value) of the whole graph; MEMBER_OF doesn't count. Roles and policies play no part."""
    rows = edges.where("relation <> 'MEMBER_OF'").withColumn("both", F.col("src_resolved") & F.col("dst_resolved"))
    return summary(rows, graphs(nodes), "both", "resolved").withColumnRenamed("relevant", "total")


def dimension_confidence(nodes: DataFrame, edges: DataFrame, layer: Sequence[str] = LAYER_RELATIONS, cycle: Sequence[str] = CYCLE_RELATIONS, persistence: Sequence[str] = PERSISTENCE_RELATIONS) -> DataFrame:
    """(key, dimension, total, resolved, value): one pass over the edges; security reads no edge, so it has none."""
    sets = {"layer": layer, "cycle": cycle, "persistence": persistence}
    both = F.col("src_resolved") & F.col("dst_resolved")
    aggs = [a for d, r in sets.items() for a in (F.count_if(F.col("relation").isin(*r)).alias(f"{d}_total"), F.count_if(F.col("relation").isin(*r) & both).alias(f"{d}_resolved"))]
    counts = graphs(nodes).join(edges.groupBy(*KEY).agg(*aggs), KEY, "left").na.fill(0)
    rows = [F.struct(F.lit(d).alias("dimension"), F.col(f"{d}_total").alias("total"), F.col(f"{d}_resolved").alias("resolved")) for d in sets]
    rows.append(F.struct(F.lit("security").alias("dimension"), F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("resolved")))
    return counts.select(*KEY, F.explode(F.array(*rows)).alias("d")).select(*KEY, "d.*").withColumn("value", ratio(F.col("resolved"), F.col("total")))
