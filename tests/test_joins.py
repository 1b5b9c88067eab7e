"""How edges meet the roles of their ends, and what is asked of them before."""

import random

from pyspark.sql import functions as F

from tesserae.operators import governance, invariants, metrics
from tesserae.operators.governance import PrefixIndex
from tesserae.schema import graph

NODES = [("a.1", "COMPONENT", "PRESENTATION"), ("b.1", "COMPONENT", "PERSISTENCE"), ("c.1", "VIEW", "UNKNOWN")]
EDGES = [("a.1", "b.1", "CALL"), ("a.1", "c.1", "CALL"), ("b.1", "a.1", "READS"), ("c.1", ("unresolved", "x"), "CALL")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nodes_are_not_broadcast_to_edges(spark):
    nodes, edges = graph(spark, NODES, EDGES)
    found = metrics.with_roles(edges, nodes)
    assert "Broadcast" not in plan(found) and plan(found).count("ShuffledHashJoin") == 2
    assert sorted((r["src_id"], r["src_role"], r["dst_id"], r["dst_role"]) for r in found.collect()) == [("a.1", "PRESENTATION", "b.1", "PERSISTENCE"), ("a.1", "PRESENTATION", "c.1", "UNKNOWN"), ("b.1", "PERSISTENCE", "a.1", "PRESENTATION")]


def test_few_prefixes_are_compared_without_a_search(spark, monkeypatch):
    rng = random.Random(3)
    ids = spark.createDataFrame([(None,), ("",), *[("".join(rng.choice("ab.é\U0001f600") for _ in range(rng.randint(1, 5))),) for _ in range(300)]], "id string")
    entries = [("a.", "x"), ("ab", "y"), ("é", "z"), ("\U0001f600a", "w")]
    named = lambda: ids.select(PrefixIndex(entries).named(PrefixIndex(entries).compared(F.col("id"))).alias("n"))
    direct = named()
    assert "aggregate(" not in plan(direct)
    want = [next((n for p, n in entries if r["id"] is not None and r["id"].startswith(p)), None) for r in ids.collect()]
    assert [r["n"] for r in direct.collect()] == want
    monkeypatch.setattr(governance, "COMPARED", 0)
    assert [r["n"] for r in named().collect()] == want


def test_edges_that_break_no_rule_are_left_out_before_the_joins(spark):
    nodes, edges = graph(spark, NODES, EDGES)
    found = invariants.violations([invariants.no_presentation_to_persistence()], nodes, edges)
    # the last filter of the plan's text that names the role stands below the join, at the nodes
    text = plan(found)
    assert text.rindex("<=> PRESENTATION") > text.rindex("ShuffledHashJoin")
    assert [(r["source_id"], r["target_id"]) for r in found.collect()] == [("a.1", "b.1")]
