"""Facts of source adapters, and their assembly into one graph, whatever order they come in."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.schema import EDGE_FACTS, EVIDENCE, KEY, NODE_FACTS, not_blank, require
from tesserae.storage import stored


@dataclass(frozen=True)
class ExtractionRequest:
    """What to scan: at least one root; an empty classpath means that symbols stay as they are written."""

    roots: tuple[str, ...]
    classpath: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        require(len(self.roots) > 0, "a scan needs a root")


@dataclass(frozen=True)
class Extraction:
    """Facts of one scan as tables; diagnostics has a text for each source that could not be read."""

    nodes: DataFrame
    edges: DataFrame
    diagnostics: DataFrame


class SourceAdapter(Protocol):
    """A technology's adapter: from a request to facts."""

    def extract(self, spark: SparkSession, request: ExtractionRequest) -> Extraction: ...


def module_id(group: str, artifact: str) -> str:
    return f"{not_blank(group, 'group')}:{not_blank(artifact, 'artifact')}"


def type_id(name: str) -> str:
    return not_blank(name, "type name").replace("$", ".")


def method_id(owner: str, name: str, params: Sequence[str] = ()) -> str:
    return f"{type_id(owner)}#{not_blank(name, 'method name')}({','.join(params)})"


def type_id_column(name: Column) -> Column:
    return F.translate(name, "$", ".")


def node_facts(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), NODE_FACTS)


def edge_facts(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), EDGE_FACTS)


def _ordered(evidence: Column) -> Column:
    """Evidence in its canonical order; attributes are compared as sorted entries."""
    entries = lambda e: F.array_sort(F.map_entries(F.coalesce(e["attributes"], F.create_map().cast("map<string,string>"))))
    keyed = F.transform(evidence, lambda e: F.struct(e["source_adapter"].alias("source_adapter"), e["description"].alias("description"), e["location"].alias("location"), e["fidelity"].alias("fidelity"), e["execution_context"].alias("execution_context"), entries(e).alias("attributes")))
    named = ("source_adapter", "description", "location", "fidelity", "execution_context")
    return F.transform(F.array_sort(keyed), lambda e: F.struct(*[e[n].alias(n) for n in named], F.map_from_entries(e["attributes"]).alias("attributes")))


def _united(facts: DataFrame, *more: Column) -> DataFrame:
    """(subject_id, scan_id, id, type, attributes) and aggregates of one row per id. Differing types or attribute values are refused."""
    lists = facts.groupBy(*KEY, "id").agg(F.min("type").alias("type"), F.max("type").alias("other"), F.array_distinct(F.flatten(F.collect_list(F.map_entries("attributes")))).alias("entries"), *more)
    clash = F.size(F.array_distinct(F.transform("entries", lambda e: e["key"]))) < F.size("entries")
    refuse = lambda what: F.raise_error(F.concat(F.lit(f"facts differ in {what} of "), F.col("id")))
    kind = F.when(F.col("type") != F.col("other"), refuse("the type")).otherwise(F.col("type"))
    attributes = F.when(clash, refuse("an attribute").cast("map<string,string>")).otherwise(F.map_from_entries(F.array_sort(F.filter("entries", lambda e: ~clash))))
    return lists.withColumns({"type": kind, "attributes": attributes}).drop("other", "entries")


def merged_nodes(facts: DataFrame) -> DataFrame:
    """One row per id: attributes united, evidence joined and ordered. Differing types or attribute values are refused."""
    rows = _united(facts, F.flatten(F.collect_list("evidence")).alias("evidence"))
    return rows.select(*KEY, "id", "type", F.lit("UNKNOWN").alias("role"), "attributes", _ordered(F.col("evidence")).alias("evidence"))


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """df with a number that ascends in the given order within each graph; a range sort, so no graph meets one task."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartitionByRange(n, *KEY, *order).sortWithinPartitions(*KEY, *order).withColumn(name, F.monotonically_increasing_id())


def _declared(ids: DataFrame, end: str) -> DataFrame:
    return ids.select(*KEY, F.col("id").alias(f"{end}_key"), F.lit(True).alias(f"{end}_hit"))


def assemble(node_rows: DataFrame, edge_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): each end is resolved on its own against the declared ids, or keeps its description.

    Equal edges are kept, edges with an unresolved source, too. Numbers follow ids and the edges' canonical order.
    """
    nodes = stored(numbered(merged_nodes(node_rows), ["id"], "node_seq"), "graph")
    found = edge_rows
    for x in ("source", "target"):
        found = found.join(_declared(nodes, x), [*KEY, f"{x}_key"], "left")
    end = lambda hit, key, desc, x: [hit.isNotNull().alias(f"{x}_resolved"), F.when(hit.isNotNull(), key).alias(f"{x}_id"), F.when(hit.isNull(), desc).alias(f"{x}_desc")]
    provenance = _ordered(F.coalesce("provenance", F.array().cast(f"array<{EVIDENCE}>")))
    rows = found.select(*KEY, *end(F.col("source_hit"), F.col("source_key"), F.col("source_desc"), "src"), *end(F.col("target_hit"), F.col("target_key"), F.col("target_desc"), "dst"), "relation", provenance.alias("provenance"))
    rows = rows.withColumn("_text", F.to_json("provenance"))
    order = ["src_resolved", "src_id", "src_desc", "dst_resolved", "dst_id", "dst_desc", "relation", "_text"]
    edges = stored(numbered(rows, order, "edge_seq").drop("_text"), "graph")
    return nodes, edges


def resolution(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """(subject_id, scan_id, relation, src_resolved, dst_resolved, n): the edges of assemble(), counted by what was resolved.

    No edge is numbered, sorted or stored: all meet their source once, then those of one target, relation and outcome are a count, and counts meet the targets.
    Facts that assemble() refuses are refused here, too.
    """
    united = _united(node_rows)
    # both are read, always true, so that what they refuse isn't left out with unread columns
    both = F.coalesce(F.length("type"), F.lit(0)) + F.coalesce(F.size("attributes"), F.lit(0))
    ids = stored(united.where(both >= 0).select(*KEY, "id"), "graph")
    met = edge_rows.join(_declared(ids, "source").hint("shuffle_hash"), [*KEY, "source_key"], "left")
    counts = met.groupBy(*KEY, "target_key", "relation", F.col("source_hit").isNotNull().alias("src_resolved")).agg(F.count("*").alias("n"))
    found = counts.join(_declared(ids, "target").hint("shuffle_hash"), [*KEY, "target_key"], "left")
    return found.groupBy(*KEY, "relation", "src_resolved", F.col("target_hit").isNotNull().alias("dst_resolved")).agg(F.sum("n").alias("n"))
