"""Refinement rules as table functions: a handler that sees all known supertypes of one node, for rules that columns can't express.

A pass joins the inheritance edges with what the pass before made known, and hands the rows to the handler partition by partition: TABLE(candidates)
PARTITION BY graph and node, in the order of the edges. The handler is a Python table function whose analyze() names the columns that it needs;
what it yields are signals like those of any other rule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tesserae.operators.roles import INHERIT
from tesserae.schema import KEY, require

#: What a handler gets: the node, one of its supertypes that is known, and that one's role.
CANDIDATE = ("subject_id", "scan_id", "id", "dst_id", "relation", "edge_seq", "role")
_SIGNALS = StructType([*[StructField(c, StringType()) for c in ("subject_id", "scan_id", "id", "rule", "role", "rationale")], StructField("edge_seq", LongType())])


class Rule:
    """The base of handlers: rows of one node come one after the other to eval(), and terminate() ends the node.

    A handler gives signals from either by self.signal(row, role, rationale), which it yields.
    """

    name = "rule"

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        require(rows.isTable, "a rule takes a table")
        missing = [c for c in CANDIDATE if c not in rows.dataType.names]
        require(not missing, f"a rule's table lacks {missing}")
        return AnalyzeResult(schema=_SIGNALS)

    def signal(self, row: Row, role: str, rationale: str) -> tuple:
        return row["subject_id"], row["scan_id"], row["id"], self.name, role, rationale, row["edge_seq"]

    def eval(self, row: Row) -> Iterator[tuple]:
        raise NotImplementedError

    def terminate(self) -> Iterator[tuple]:
        yield from ()


class Inherit(Rule):
    """The rule that roles.inherit_from_supertypes() writes in columns."""

    name = INHERIT

    def eval(self, row: Row) -> Iterator[tuple]:
        yield self.signal(row, row["role"], f"inherits role from {row['relation']} target {row['dst_id']}")


class Agreement(Rule):
    """A role only where all supertypes that are known by now agree, whatever their number."""

    name = "graph-role-that-known-supertypes-agree-on"

    def __init__(self) -> None:
        self.rows: list[Row] = []

    def eval(self, row: Row) -> Iterator[tuple]:
        # a node's supertypes are few; of each only what a signal needs is kept
        self.rows.append(row)
        yield from ()

    def terminate(self) -> Iterator[tuple]:
        if self.rows and len({r["role"] for r in self.rows}) == 1:
            yield self.signal(self.rows[0], self.rows[0]["role"], f"{len(self.rows)} known supertypes agree")


def as_refinement(handler: type[Rule]) -> Callable[[DataFrame, DataFrame, DataFrame], DataFrame]:
    """The handler as a refinement rule, for roles.refined() and detection catalogs."""
    call = F.udtf(handler)

    def refine(base: DataFrame, up: DataFrame, fresh: DataFrame) -> DataFrame:
        known = fresh.where("role <> 'UNKNOWN'").select(*KEY, F.col("id").alias("dst_id"), "role")
        found = up.select(*KEY, F.col("src_id").alias("id"), "dst_id", "relation", "edge_seq").join(known, [*KEY, "dst_id"])
        table = found.select(*CANDIDATE).asTable().partitionBy(*KEY, "id").orderBy("edge_seq")
        return call(table).select(*KEY, "id", "rule", "role", "rationale", "edge_seq")

    return refine
