"""Tables with keys: repeated and replaced rows, references, batches that count once; adjacency that reads one bucket; rules as rows."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import invariants as inv
from tesserae.schema import graph
from tesserae.sources import scans
from tesserae.sources.keyed import KeyedTable, columns_of
from tesserae.sources.layout import stored_adjacency


def tables(path):
    owners = KeyedTable(f"{path}/owners", "id string not null, name string", "id", "pmod(crc32(id), 3)")
    return owners, KeyedTable(f"{path}/pets", "id bigint not null, owner string, kind string not null, tags array<string>", "id", "kind", (("owner", owners),))


def test_batches_by_key(spark, tmp_path):
    owners, pets = tables(tmp_path)
    assert owners.read(spark).collect() == [] and columns_of(pets.schema) == {"id": False, "owner": True, "kind": False, "tags": True}
    people = spark.createDataFrame([("a", "Ann"), ("b", None)], "id string, name string")
    assert owners.merge(people, "p1") and not owners.merge(people.limit(0), "p1") and owners.committed(spark, "p1")
    df = lambda rows: spark.createDataFrame(rows, "id long, owner string, kind string, tags array<string>, more int")
    pets.merge(df([(1, "a", "cat", ["x"], 0), (2, "b", "dog", None, 0), (3, None, "dog", [], 0)]), "1")
    before = {f: open(f, "rb").read() for f in glob.glob(f"{tmp_path}/pets/rows/_part=cat/*.parquet")}
    pets.merge(df([(2, "a", "dog", ["new"], 0), (4, "a", "dog", None, 0)]), "2")
    pets.merge(df([(2, "b", "dog", ["kept out"], 0), (5, "b", "dog", None, 0)]), "3", replace=False)
    got = {r["id"]: (r["owner"], r["tags"]) for r in pets.read(spark).collect()}
    assert got == {1: ("a", ["x"]), 2: ("a", ["new"]), 3: (None, []), 4: ("a", None), 5: ("b", None)}
    assert before and {f: open(f, "rb").read() for f in glob.glob(f"{tmp_path}/pets/rows/_part=cat/*.parquet")} == before  # the other partition wasn't touched
    owners.delete(spark.createDataFrame([("b",)], "id string"), cascade=(pets,))
    assert [r["id"] for r in owners.read(spark).collect()] == ["a"] and sorted(r["id"] for r in pets.read(spark).collect()) == [1, 2, 3, 4]
    pets.delete(spark.createDataFrame([(1,)], "id long"))
    assert sorted(r["kind"] for r in pets.read(spark).collect()) == ["dog"] * 3


def test_batches_that_are_refused(spark, tmp_path):
    owners, pets = tables(tmp_path)
    owners.merge(spark.createDataFrame([("a", "Ann")], "id string, name string"), "1")
    df = lambda *rows: spark.createDataFrame(rows, "id long, owner string, kind string, tags array<string>")
    pets.merge(df((1, "a", "cat", None)), "1")
    for why, rows in {"a reference": [(2, "z", "cat", None)], "null": [(None, "a", "cat", None)], "kind is null": [(2, "a", None, None)], "twice": [(2, "a", "cat", None), (2, "a", "dog", None)], "moved": [(1, "a", "dog", None)]}.items():
        with pytest.raises(ValueError, match=why):
            pets.merge(df(*rows, (9, "a", "cat", None)), "2")
    assert [r["id"] for r in pets.read(spark).collect()] == [1] and not pets.committed(spark, "2")
    assert [tuple(r) for r in pets.orphans(df((2, "z", "cat", None), (3, None, "cat", None), (4, "a", "cat", None))).select("id", "broken").collect()] == [(2, "owner")]
    for bad in ("", "a/b", "../x"):
        with pytest.raises(ValueError):
            pets.merge(df((2, "a", "cat", None)), bad)


def test_a_batch_that_died_is_pushed_again(spark, tmp_path, monkeypatch):
    owners, _ = tables(tmp_path)
    rows = spark.createDataFrame([(str(i), f"n{i}") for i in range(20)], "id string, name string")
    write = KeyedTable._write

    def dies(self, rows):
        write(self, rows)
        raise OSError("gone")

    monkeypatch.setattr(KeyedTable, "_write", dies)
    with pytest.raises(OSError):
        owners.merge(rows, "1")
    assert not owners.committed(spark, "1")
    monkeypatch.setattr(KeyedTable, "_write", write)
    assert owners.merge(rows, "1") and owners.read(spark).count() == 20


def test_projects_keep_their_beginning(spark, tmp_path):
    at = str(tmp_path)
    scans.put_project(spark, at, "p", "One", "http://x")
    first = scans.project_table(at).read(spark).first()
    scans.put_project(spark, at, "p", "Two")
    again = scans.project_table(at).read(spark).collect()
    assert [(r["name"], r["repo_url"], r["created_at"]) for r in again] == [("Two", None, first["created_at"])]


def test_a_lookup_reads_one_bucket(spark, tmp_path):
    r = random.Random(5)
    ids = [f"n{i:03d}" for i in range(200)]
    pairs = [(r.choice(ids), r.choice(ids), r.choice(("CALL", "DEPENDS"))) for _ in range(3000)] + [(("unresolved", "x"), "n001", "CALL"), ("n001", ("unresolved", "y"), "CALL"), ("n001", "n002", "CALL"), ("n001", "n002", "CALL")]
    _, edges = graph(spark, [(i, "COMPONENT") for i in ids], pairs)
    at = stored_adjacency(edges, str(tmp_path / "adj"), 16)
    plain = lambda df: sorted((x["src_id"] or "", x["dst_id"] or "", x["relation"], x["edge_seq"]) for x in df.collect())
    for i in ("n001", "n077", "nowhere"):
        assert plain(at.edges_from(i)) == plain(edges.where(F.col("src_id") == i)) and plain(at.edges_to(i)) == plain(edges.where(F.col("dst_id") == i))
    files = {k: {f.split("/bucket=")[1].split("/")[0] for f in glob.glob(f"{tmp_path}/adj/{k}/bucket=*/*.parquet")} for k in ("out", "in")}
    assert len(files["out"]) > 8
    for found in (at.edges_from("n001"), at.edges_to("n077")):
        rows = found.select(F.input_file_name().alias("f")).distinct().collect()
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert len({x["f"].split("/bucket=")[1].split("/")[0] for x in rows}) == 1
        assert "PushedFilters" in plan and "EqualTo" in plan and "PartitionFilters: [isnotnull(bucket" in plan
    some = spark.createDataFrame([("subject", "scan", i) for i in ids[:7]], "subject_id string, scan_id string, id string")
    assert plain(at.edges_of(some)) == plain(edges.where(F.col("src_id").isin(*ids[:7]))) and plain(at.edges_of(some, "in")) == plain(edges.where(F.col("dst_id").isin(*ids[:7])))
    assert at.edges_of(some).columns == edges.columns
    assert {x["id"]: x["edges"] for x in at.degrees("in").collect()} == {x["dst_id"]: x["n"] for x in edges.where("dst_resolved").groupBy("dst_id").agg(F.count("*").alias("n")).collect()}


ALL = (
    inv.Invariant("a", "NODE", inv.and_(inv.eq(inv.prop("type"), inv.value("VIEW", "type")), inv.not_(inv.eq(inv.prop("role"), inv.role("UNKNOWN")))), inv.or_(inv.in_(inv.prop("role"), *[inv.role(f"DOMAIN") for _ in range(12)]), inv.always(False)), "WARNING"),
    inv.Invariant("b", "GRAPH", inv.always(True), inv.and_(inv.lte(inv.metric("layer"), inv.value(0.1 + 0.2)), inv.gt(inv.metric("cycle"), inv.value(-3)), inv.not_eq(inv.value(True), inv.value("x")))),
    inv.no_presentation_to_persistence(),
)


def test_rules_come_back_from_rows(spark):
    assert inv.from_rules(inv.rules_table(spark, ALL)) == tuple(sorted(ALL, key=lambda r: r.name))
    assert inv.from_rules(inv.rules_table(spark, ())) == ()


@pytest.mark.parametrize("change", ["path = '0' and op = 'value' -> op = 'eq'", "side = 'then' and path = '' -> op = 'xor'", "path = '1' -> path = '2'", "prop = 'type' -> prop = 'relation'", "kind = 'double' and constant is not null -> constant = 'x'", "op = 'always' -> constant = 'maybe'", "name = 'b' and op = 'lt' or op = 'le' -> op = 'not'", "path = '' and side = 'when' -> side = 'if'", "path = '0.0' -> path = '0.x'", "prop = 'role' -> kind = 'string'"])
def test_rows_that_make_no_rule_are_refused(spark, change):
    hold, _, put = change.partition(" -> ")
    column, _, new = put.partition(" = ")
    table = inv.rules_table(spark, ALL)
    with pytest.raises(ValueError):
        inv.from_rules(table.withColumn(column, F.when(F.expr(f"coalesce({hold}, false)"), F.lit(new.strip("'"))).otherwise(F.col(column))))
