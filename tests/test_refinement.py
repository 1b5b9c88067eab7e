"""Chains of supertypes settled by doubling against passes one by one, and depth that passes could not go."""

import random

from pyspark.sql import functions as F

from tesserae.operators import roles, rules
from tesserae.schema import KEY, evidence, graph

SEEDS = {"P": [evidence("spring-data", "x")], "A": [evidence("spring", "annotated class", attributes={"annotation": roles.SERVICE})]}


def pass_by_pass(base, up, fresh):
    return roles.inherit_from_supertypes(base, up, fresh)


def rows(result):
    out, passes = result
    found = [(r["subject_id"], r["id"], r["role"], r["pass"], [tuple(s) for s in r["signals"]]) for r in out.collect()]
    return sorted(found), sorted(map(tuple, passes.select(*KEY, "passes").collect()))


def test_doubling_equals_passes(spark):
    r, parts = random.Random(3), []
    for g, several in enumerate((0.0, 0.1, 0.4, 0.0)):
        n = 60
        nodes = [(f"n{i:02d}", "COMPONENT", "UNKNOWN", SEEDS[r.choice("PA")] if r.random() < 0.06 else []) for i in range(n)]
        edges = []
        for i in range(n):
            if r.random() < 0.95:
                back = g == 3 and r.random() < 0.2  # circles, too
                edges.append((f"n{i:02d}", f"n{r.randrange(n) if back else max(0, i - r.randint(1, 2)):02d}", r.choice(("EXTENDS", "IMPLEMENTS"))))
                while r.random() < several:
                    edges.append((f"n{i:02d}", f"n{r.randrange(n):02d}", "IMPLEMENTS"))
        edges += [("n05", "n05", "EXTENDS"), (("unresolved", "far"), "n01", "EXTENDS"), ("n07", ("unresolved", "far"), "EXTENDS")]
        parts.append(graph(spark, nodes, edges, subject_id=f"g{g}"))
    nodes, edges = parts[0]
    for a, b in parts[1:]:
        nodes, edges = nodes.unionByName(a), edges.unionByName(b)
    want = rows(roles.refined(nodes, edges))
    assert want == rows(roles.refined(nodes, edges, refine=pass_by_pass))
    assert want == rows(roles.refined(nodes, edges, refine=rules.as_refinement(rules.Inherit)))


def test_a_deep_chain_takes_few_rounds(spark):
    n = 3000
    id_ = lambda c: F.format_string("n%05d", c)
    seed, _ = graph(spark, [("n00000", "COMPONENT", "UNKNOWN", SEEDS["P"])], [])
    more = spark.range(1, n).select(F.lit("subject").alias("subject_id"), F.lit("scan").alias("scan_id"), F.col("id").alias("node_seq"), id_(F.col("id")).alias("id"), F.lit("COMPONENT").alias("type"), F.lit("UNKNOWN").alias("role"), F.create_map().cast("map<string,string>").alias("attributes"), F.array().cast(seed.schema["evidence"].dataType).alias("evidence"))
    _, like = graph(spark, [("a", "COMPONENT"), ("b", "COMPONENT")], [("a", "b", "EXTENDS")])
    edges = spark.range(1, n).crossJoin(like.drop("edge_seq", "src_id", "dst_id")).select("subject_id", "scan_id", F.col("id").alias("edge_seq"), "src_resolved", id_(F.col("id")).alias("src_id"), "src_desc", "dst_resolved", id_(F.col("id") - 1).alias("dst_id"), "dst_desc", "relation", "provenance")
    out, passes = roles.refined(seed.unionByName(more), edges)
    assert passes.first()["passes"] == n - 1
    assert out.where("role = 'PERSISTENCE' and pass = cast(substring(id, 2) as int)").count() == n


def test_a_rule_that_looks_at_all_supertypes(spark):
    nodes = [("p", "COMPONENT", "UNKNOWN", SEEDS["P"]), ("q", "COMPONENT", "UNKNOWN", SEEDS["P"]), ("a", "COMPONENT", "UNKNOWN", SEEDS["A"]), *[(x, "COMPONENT") for x in ("both", "split", "below", "lone")]]
    edges = [("both", "p", "EXTENDS"), ("both", "q", "IMPLEMENTS"), ("split", "p", "EXTENDS"), ("split", "a", "IMPLEMENTS"), ("below", "both", "EXTENDS"), ("below", "split", "IMPLEMENTS")]
    n, e = graph(spark, nodes, edges)
    out, passes = roles.refined(n, e, refine=rules.as_refinement(rules.Agreement))
    got = {r["id"]: (r["role"], r["pass"], [s["rationale"] for s in r["signals"] if s["rule"] == rules.Agreement.name]) for r in out.collect()}
    assert got["both"] == ("PERSISTENCE", 1, ["2 known supertypes agree"]) and got["split"] == ("UNKNOWN", 0, []) and got["lone"] == ("UNKNOWN", 0, [])
    assert got["below"] == ("PERSISTENCE", 2, ["1 known supertypes agree"]) and passes.first()["passes"] == 2
