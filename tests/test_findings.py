"""What a round's findings named: work that is done once, and memory and disk that don't follow the tables."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tesserae import storage
from tesserae.operators import cycles, invariants, metrics
from tesserae.plans import queries
from tesserae.sources import bridge, datasource, layout, reports, shop

DATA = "/root/testdata/sf0.001"


def _pairs(spark, pairs):
    return spark.createDataFrame([("g", "s", f"n{a}", f"n{b}") for a, b in pairs], "subject_id string, scan_id string, a string, b string")


@pytest.mark.parametrize("part", [40, 10_000])
@pytest.mark.parametrize("limit", [0, 60])
def test_contracted_components_are_the_graphs(spark, monkeypatch, part, limit):
    monkeypatch.setattr(cycles, "PART_EDGES", part)
    rng = np.random.default_rng(part + limit)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 200, (260, 2))] + [(i, i + 1) for i in range(300, 330)] + [(330, 300), (5, 5)]
    want = cycles.tarjan([(f"n{a}", f"n{b}") for a, b in pairs if a != b])
    sizes = {x: list(want.values()).count(x) for x in set(want.values())}
    got = {r["id"]: r["scc"] for r in cycles.contracted_components(_pairs(spark, pairs + pairs[:50]), limit).collect()}
    assert {k: v for k, v in want.items() if sizes[v] > 1} == {k: v for k, v in got.items() if list(got.values()).count(v) > 1}
    assert all(want[k] == v for k, v in got.items())


def test_components_of_many_parts_stay_whole(spark, monkeypatch):
    """A node's representative may have another one itself, where it lies on a cycle of a further part, too."""
    monkeypatch.setattr(cycles, "PART_EDGES", 400)
    spokes = [(100 * k, 100 * k + i % 3, 100 * k + 3 + i, 100 * k + (i + 1) % 3) for k in range(30) for i in range(60)]
    pairs = [(hub, spoke) for _, hub, spoke, _ in spokes] + [(spoke, hub) for _, _, spoke, hub in spokes]
    got = cycles.contracted_components(_pairs(spark, pairs), 2_000).collect()
    assert {r["id"]: r["scc"] for r in got} == {f"n{x}": f"n{first}" for first, *others in spokes for x in others}


def test_busy_nodes_are_contracted_at_once(spark, monkeypatch):
    """Many quiet nodes around few busy ones: one round, no names."""
    monkeypatch.setattr(cycles, "PART_EDGES", 200)
    pairs = [(i % 5, 100 + i) for i in range(400)] + [(100 + i, (i + 1) % 5) for i in range(400)]
    rounds = []
    got = cycles.contracted_components(_pairs(spark, pairs), 100, rounds).collect()
    assert rounds == ["contracted"] and {r["scc"] for r in got} == {"n0"} and len(got) == 405


def test_edges_meet_their_roles_once(spark, monkeypatch):
    calls, plain = [], metrics.with_roles
    monkeypatch.setattr(metrics, "with_roles", lambda *a: calls.append(1) or plain(*a))
    monkeypatch.setattr("tesserae.operators.invariants.with_roles", lambda *a: calls.append(1) or plain(*a))
    queries._analysis(spark, DATA)
    assert len(calls) == 1


def test_layers_store_no_edges(spark):
    queries.queries()["layer_entropy"](spark, DATA)
    before = len(storage._made)
    queries.queries()["layer_entropy"](spark, DATA)
    assert not [p for _, p in storage._made[before:] if os.path.basename(p).startswith("edges-")]


def test_a_lookup_stores_one_side(spark):
    at = layout.stored_adjacency(bridge.edges(spark, DATA).select(*queries._ENDS), storage.fresh_path(spark, "adjacency"), 4, ("out",))
    assert os.listdir(at.path.removeprefix("file:")) == ["out"]


def test_a_lookup_holds_what_it_is_asked_for(tmp_path, monkeypatch):
    orders = pa.table({"o_orderkey": np.random.default_rng(1).permutation(300_000), "o_custkey": np.arange(300_000)})
    pq.write_table(orders, tmp_path / "orders.parquet")
    held, plain = [], pa.concat_tables
    monkeypatch.setattr(datasource.pa, "concat_tables", lambda ts, **k: held.append(sum(t.num_rows for t in ts)) or plain(ts, **k))
    reader = datasource.FactReader({"path": str(tmp_path)})
    lookup = next(r.lookup for r in shop.EDGES if r.lookup)
    asked = pa.table({"l_orderkey": pa.array([0, 299_999, 7, 7, -1, None], pa.int64())})
    found = reader._looked_up(lookup, asked)
    assert found.num_rows == 4 and max(held) == 3


def test_parts_of_a_document_may_be_compressed(spark, tmp_path):
    rows = spark.range(0, 20_000, 1, 4).select(F.concat(F.lit('{"the same text in every element":'), F.col("id").cast("string"), F.lit("}")).alias("text"))
    sizes = {}
    for kind in ("", "zstd"):
        at = str(tmp_path / f"doc{kind}")
        reports.write(rows, at, "\n", kind)
        sizes[kind] = sum(os.path.getsize(f"{at}/{x}") for x in os.listdir(at)), b"".join(reports.text(at))
        assert reports.read(spark, at).orderBy("part", "element").select("text").collect() == rows.collect()
    assert sizes[""][1] == sizes["zstd"][1] and sizes["zstd"][0] * 4 < sizes[""][0]


def test_views_that_count_store_no_edges(spark):
    before = len(storage._made)
    rows = queries.queries()["view_constraints"](spark, DATA).collect()
    made = {os.path.basename(p).rsplit("-", 1)[0] for _, p in storage._made[before:]}
    assert len(rows) == 2 and not made & {"edges", "joined", "persistence", "violations"}


def test_a_profile_counts_what_its_edges_count(spark):
    """Sources that are no nodes count as calls of a target, and in nothing else."""
    nodes = spark.createDataFrame([("g", "s", i, f"n{i}", "COMPONENT", r) for i, r in enumerate(["PRESENTATION", "PERSISTENCE", "DOMAIN"])], "subject_id string, scan_id string, node_seq bigint, id string, type string, role string")
    lines = [("n0", "n1", "UNKNOWN"), ("n0", "n1", "ITERATED"), ("n2", "n1", "ITERATED"), ("gone", "n1", "ITERATED"), ("n0", "gone", "UNKNOWN"), ("n1", "n2", "UNKNOWN")]
    edges = spark.createDataFrame([("g", "s", i, True, a, True, b, "CALL", [(c,)]) for i, (a, b, c) in enumerate(lines)], "subject_id string, scan_id string, edge_seq bigint, src_resolved boolean, src_id string, dst_resolved boolean, dst_id string, relation string, provenance array<struct<execution_context:string>>")
    profile = metrics.edge_profile(nodes, edges)
    calls = metrics.summary(profile.where("dst_role = 'PERSISTENCE'"), metrics.graphs(nodes), "flagged", "flagged").first()
    assert (calls["relevant"], calls["flagged"]) == (4, 3) and metrics.persistence_edges(nodes, edges).count() == 4
    rules = [invariants.no_presentation_to_persistence()]
    assert [r["n"] for r in invariants.counted(rules, nodes, profile).collect()] == [invariants.violations(rules, nodes, edges).count()] == [2]


@pytest.mark.parametrize("sent", [0, 1_000])
def test_components_are_the_same_whatever_is_sent(spark, monkeypatch, sent):
    monkeypatch.setattr(cycles, "SENT_NODES", sent)
    monkeypatch.setattr(cycles, "PART_EDGES", 200)
    ring = [(i % 5, 100 + i) for i in range(200)] + [(100 + i, (i + 1) % 5) for i in range(200)]
    pairs = ring + [(500 + i, 100 + i) for i in range(50)] + [(100 + i, 600 + i) for i in range(50)]
    got = {r["id"]: r["scc"] for r in cycles.contracted_components(_pairs(spark, pairs), 100).collect()}
    assert {k for k, v in got.items() if v == "n0"} == {f"n{i}" for i in range(5)} | {f"n{100 + i}" for i in range(200)}
