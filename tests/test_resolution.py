"""Edges counted by what was resolved, without the graph they come from."""

from collections import Counter

import pytest

from tesserae.plans import queries
from tesserae.schema import KEY
from tesserae.sources import facts

NODES = [("s", "1", "a", "COMPONENT", {}, []), ("s", "1", "b", "DATA", {"k": "v"}, []), ("s", "1", "b", "DATA", {"k": "v", "l": "w"}, []), ("s", "2", "c", "COMPONENT", {}, [])]
ENDS = [("1", "a", "b"), ("1", "a", "b"), ("1", "b", "nowhere"), ("1", "nowhere", "a"), ("1", None, "a"), ("1", "a", None), ("2", "c", "a"), ("2", "a", "c"), ("2", "x", "y")]
EDGES = [("s", scan, a, f"from {a}", b, f"to {b}", relation, None) for scan, a, b in ENDS for relation in ("CALL", "DEPENDS")]


def test_counts_are_those_of_the_assembled_edges(spark):
    nodes, edges = facts.node_facts(spark, NODES), facts.edge_facts(spark, EDGES)
    want = Counter((r["scan_id"], r["relation"], r["src_resolved"], r["dst_resolved"]) for r in facts.assemble(nodes, edges)[1].collect())
    got = {(r["scan_id"], r["relation"], r["src_resolved"], r["dst_resolved"]): r["n"] for r in facts.resolution(nodes, edges).collect()}
    assert got == want and sum(got.values()) == len(EDGES)


@pytest.mark.parametrize("other", [("s", "1", "a", "DATA", {}, []), ("s", "1", "b", "DATA", {"k": "other"}, [])])
def test_facts_that_differ_are_refused(spark, other):
    with pytest.raises(Exception, match="facts differ"):
        facts.resolution(facts.node_facts(spark, [*NODES, other]), facts.edge_facts(spark, EDGES)).collect()


def test_the_query_stores_ids_alone(spark, monkeypatch):
    kept, store = [], facts.stored
    monkeypatch.setattr(facts, "stored", lambda df, name: kept.append(df.columns) or store(df, name))
    assert queries.queries()["assemble_resolution"](spark, "/root/testdata/sf0.001").count() == 4
    assert kept == [[*KEY, "id"]]
