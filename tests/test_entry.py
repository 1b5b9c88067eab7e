"""The driver's contract: names, columns and rows of queries and SQL on the smallest tables."""

import glob
import os
import random
from functools import reduce

import duckdb
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tesserae.operators import cycles
from tesserae.plans import queries as graph
from tesserae.sources import bridge

DATA = "/root/testdata/sf0.001"
FEW = ("graph_nodes", "assemble_merge", "seed_roles", "role_signals", "layer_by_subsystem", "cycle_scc", "security_findings", "confidence_by_dimension", "maturity_level", "invariant_graph_scope", "exceptions_unmatched", "drift", "risk", "risk_reasons", "scans_latest")


def plain(row):
    return tuple(None if x is None or x != x else round(float(x), 9) if isinstance(x, float) else x for x in row)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return c


@pytest.mark.parametrize("name", FEW)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == cols
    rows = want.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall()
    assert sorted(map(plain, df.select(*cols).collect()), key=str) == sorted(map(plain, rows), key=str)


@pytest.mark.parametrize("name", graph.FIXED)
def test_fixed_input_equals_sql(spark, duck, name):
    run, sql = graph.FIXED[name]
    df = run(spark, DATA)
    want = duck.sql(sql)
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols and name not in entry.queries()
    assert sorted(map(plain, df.select(*cols).collect()), key=str) == sorted(map(plain, want.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall()), key=str)


def cycles_of(pairs):
    """Members of each component of more than one node: what reaches a node and is reached from it."""
    ahead, back = {}, {}
    for a, b in pairs:
        ahead.setdefault(a, set()).add(b)
        back.setdefault(b, set()).add(a)

    def reach(start, step):
        seen, todo = {start}, [start]
        while todo:
            for y in step.get(todo.pop(), set()) - seen:
                seen.add(y)
                todo.append(y)
        return seen

    left, out = set(ahead) & set(back), []
    while left:
        x = min(left)
        both = reach(x, ahead) & reach(x, back)
        left -= both
        out += [both] if len(both) > 1 else []
    return out


@pytest.fixture(scope="module")
def whole(duck):
    """(ids of all nodes, number of edges, components of the calls and dependencies) of the whole graph, by SQL rows and plain Python."""
    ids = [r[0] for r in duck.sql(f"WITH {graph.NODES} SELECT id FROM nodes").fetchall()]
    rows = duck.sql(f"WITH {graph.EDGES} SELECT src, dst, relation FROM edges").fetchall()
    return ids, len(rows), cycles_of([(a, b) for a, b, r in rows if r in ("CALL", "DEPENDS") and b is not None])


def test_whole_analysis_against_brute_force(spark, duck, whole):
    ids, edges, comps = whole
    on = sum(map(len, comps))
    assert comps and on > 100
    run = lambda name: entry.queries()[name](spark, DATA).collect()
    seen = {r["dimension"]: r for r in run("view_observations")}
    assert (seen["cycle"]["relevant"], seen["cycle"]["findings"]) == (len(ids), len(comps)) and seen["cycle"]["value"] == on / len(ids)
    for name in ("layer", "persistence", "security"):  # these need no closure: SQL over all edges gives them
        table, flag = {"layer": ("lv", "violating"), "persistence": ("pe", "n > 0"), "security": ("se", "weak")}[name]
        n, k = duck.sql(f"{graph.BASE}, {graph.LAYER}, {graph.PERS}, {graph.SECU} SELECT count(*), count(*) FILTER ({flag}) FROM {table}").fetchall()[0]
        assert (seen[name]["relevant"], seen[name]["findings"]) == (n, k)
    total = sum(seen[d]["value"] for d in ("layer", "cycle", "persistence")) / 3
    row = run("scan_summary_row")[0]
    assert (row["node_count"], row["edge_count"]) == (len(ids), edges) and abs(row["total_entropy"] - total) < 1e-9 and abs(row["maturity"] - 1 + total) < 1e-9
    held = {r["name"]: r["holds"] for r in run("view_constraints")}
    assert held["entropy_budget"] == (total <= 0.35) and row["invariant_violation_count"] == sum(not h for h in held.values())
    found = {}
    for r in run("view_findings"):
        found[r["dimension"]] = found.get(r["dimension"], 0) + r["n"]
    assert found == {d: r["findings"] for d, r in seen.items() if r["findings"]}
    assert {r["question"] for r in run("view_unanswered")} == {f"unaddressable:{len(comps)}"} | {f"dimension:{d}" for d, r in seen.items() if r["value"] is None}


def test_whole_cycles_against_brute_force(spark, whole):
    ids, _, comps = whole
    least, size = {}, {}
    for c in comps:
        least.update(dict.fromkeys(c, min(c)))
        size.update(dict.fromkeys(c, len(c)))
    got = {r["id"]: (r["scc"], r["scc_size"]) for r in entry.queries()["cycle_scc"](spark, DATA).collect()}
    assert got == {x: (least.get(x, x), size.get(x, 1)) for x in ids}
    row = entry.queries()["cycle_entropy"](spark, DATA).first()
    assert (row["nodes"], row["participating"], row["cycles"], row["value"]) == (len(ids), len(least), len(comps), len(least) / len(ids))
    for r in entry.queries()["cycle_by_subsystem"](spark, DATA).collect():
        mine = [x for x in ids if x.startswith(r["subsystem"] + ".")]
        assert (r["claimed"], r["participating"]) == (len(mine), sum(x in least for x in mine))


def test_distributed_components_of_the_whole_graph(spark, whole):
    ids, _, comps = whole
    least = {x: min(c) for c in comps for x in c}
    found = cycles.components(bridge.nodes(spark, DATA), bridge.edges(spark, DATA), grouped_edges=0)
    assert {r["id"]: r["scc"] for r in found.collect()} == {x: least.get(x, x) for x in ids}


def by_two_walks(pairs):
    """The least id of each node's component: of what a node reaches, what reaches it."""
    ahead, back = {}, {}
    for a, b in pairs:
        ahead.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
    label = {}
    for x in sorted(set(ahead) | set(back)):
        if x in label:
            continue
        seen = []
        for step in (ahead, back):
            found, todo = {x}, [x]
            while todo:
                for y in step.get(todo.pop(), ()):
                    if y not in found and y not in label:
                        found.add(y)
                        todo.append(y)
            seen.append(found)
        label.update(dict.fromkeys(seen[0] & seen[1], x))
    return label


def pairs_of(spark, pairs, key="s"):
    return spark.createDataFrame([(key, "x", a, b) for a, b in pairs], "subject_id string, scan_id string, a string, b string")


def test_rounds_do_not_follow_the_depth_of_a_ring(spark):
    n = 100_000
    of = lambda c: c.cast("string")
    ring = spark.range(n).select(F.lit("s").alias("subject_id"), F.lit("x").alias("scan_id"), of(F.col("id")).alias("a"), of((F.col("id") + 1) % n).alias("b"))
    rounds = []
    found = cycles.distributed_components(ring, rounds=rounds)
    assert [tuple(r) for r in found.groupBy("scc").count().collect()] == [("0", n)]
    assert len(rounds) <= 60


def test_components_of_odd_graphs(spark):
    r = random.Random(8)
    name = lambda i: f"n{i:04d}"
    graphs = {
        "random": [(name(r.randrange(300)), name(r.randrange(300))) for _ in range(420)],
        "chain of rings": [(name(i), name(i + 1)) for i in range(60)] + [(name(5 * i + 4), name(5 * i)) for i in range(12)],
        "ladder": [(name(i), name(i + k)) for i in range(50) for k in (1, 2)] + [(name(9), name(0)), (name(51), name(40))],
        "tree": [(name(i), name(i // 2)) for i in range(1, 200)],
        "loops": [(name(1), name(1)), (name(1), name(2)), (name(2), name(1)), (name(1), name(2))],
    }
    df = reduce(DataFrame.union, [pairs_of(spark, p, k) for k, p in graphs.items()])
    for limit in (0, 400):
        rounds = []
        got = {(x["subject_id"], x["id"]): x["scc"] for x in cycles.distributed_components(df, limit, rounds).collect()}
        for k, p in graphs.items():
            want = by_two_walks(p)
            assert {x: got.get((k, x), x) for x in want} == want
        assert len(rounds) < 150
    assert cycles.distributed_components(df.limit(0)).collect() == []


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 1
    assert set(graph.oracle_sql()) <= set(graph.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
