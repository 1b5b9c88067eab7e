"""The driver's tables as a catalog of fact rules; the same facts as the SELECTs of the bridge, table by table."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc

from tesserae.operators.roles import CONTROLLER, SERVICE
from tesserae.sources.datasource import EdgeRule, Key, Lookup, NodeRule

REGION, NATION, CUSTOMER = "geo.region.", "geo.nation.", "web.customer."
ORDER, PART, SUPPLIER, PAGE = "app.order.", "domain.part.", "store.supplier.", "view.page."


def _when(held: pa.ChunkedArray, *texts: str) -> tuple[pa.Array, ...]:
    """Each text where the condition holds, else null."""
    held = pc.fill_null(held, False).combine_chunks()
    return tuple(pc.if_else(held, pa.scalar(x, pa.string()), pa.scalar(None, pa.string())) for x in texts)


def _spring(annotation: str, held: pa.ChunkedArray) -> tuple[pa.Array, pa.Array, pa.Array]:
    return _when(held, "spring", "annotated class", annotation)


def _repository(t: pa.Table) -> tuple[pa.Array, pa.Array, pa.Array]:
    return (*_when(pa.chunked_array([pa.array([True] * t.num_rows)]), "spring-data", "repository interface"), pa.nulls(t.num_rows, pa.string()))


def _page(t: pa.Table) -> tuple[pa.Array, pa.Array, pa.Array]:
    escaped = pc.fill_null(pc.match_substring(t["html"], "&amp;"), False).combine_chunks()
    id_ = pc.cast(t["page_id"], pa.int64()).combine_chunks()
    third = pc.fill_null(pc.equal(pc.subtract(id_, pc.multiply(pc.divide(id_, 3), 3)), 0), False)
    null = pa.scalar(None, pa.string())
    text = pc.if_else(escaped, "renders escaped output", pc.if_else(third, pa.scalar("renders unescaped output"), null))
    return pc.if_else(pc.or_(escaped, third), pa.scalar("jsp"), null), text, pa.nulls(t.num_rows, pa.string())


NODES = (
    NodeRule("region", "MODULE", Key(REGION, "r_regionkey")),
    NodeRule("nation", "CONFIG", Key(NATION, "n_nationkey")),
    NodeRule("customer", "COMPONENT", Key(CUSTOMER, "c_custkey"), lambda t: _spring(CONTROLLER, pc.is_in(t["c_mktsegment"], pa.array(["BUILDING", "MACHINERY"]))), ("c_mktsegment",)),
    NodeRule("orders", "FUNCTION", Key(ORDER, "o_orderkey"), lambda t: _spring(SERVICE, pc.not_equal(t["o_orderstatus"], "P")), ("o_orderstatus",)),
    NodeRule("part", "DATA", Key(PART, "p_partkey")),
    NodeRule("supplier", "COMPONENT", Key(SUPPLIER, "s_suppkey"), _repository),
    NodeRule("pages", "VIEW", Key(PAGE, "page_id"), _page, ("html",)),
)
_OF_ITEM, _SUPPLIER = Key(ORDER, "l_orderkey"), Key(SUPPLIER, "l_suppkey")
EDGES = (
    EdgeRule("orders", "CALL", Key(CUSTOMER, "o_custkey"), Key(ORDER, "o_orderkey")),
    EdgeRule("lineitem", "CALL", _OF_ITEM, _SUPPLIER, iterated=("l_linenumber", ">", 1)),
    EdgeRule("lineitem", "DEPENDS", _OF_ITEM, Key(PART, "l_partkey")),
    EdgeRule("lineitem", "CALL", Key(CUSTOMER, "o_custkey"), _SUPPLIER, where=("l_returnflag", "=", "R"), lookup=Lookup("orders", "o_orderkey", "o_custkey", "l_orderkey")),
    EdgeRule("lineitem", "CALL", _SUPPLIER, _OF_ITEM, where=("l_returnflag", "=", "R")),
    EdgeRule("customer", "EXTENDS", Key(CUSTOMER, "c_custkey"), Key(CUSTOMER, "c_custkey", halved=True), where=("c_custkey", ">=", 1)),
    EdgeRule("lineitem", "COMMUNICATES", _OF_ITEM, None, "external carrier", where=("l_discount", "=", 0)),
    EdgeRule("supplier", "CONFIGURES", Key(SUPPLIER, "s_suppkey"), Key(NATION, "s_nationkey")),
    EdgeRule("nation", "MEMBER_OF", Key(NATION, "n_nationkey"), Key(REGION, "n_regionkey")),
)
RULES = (NODES, EDGES)
