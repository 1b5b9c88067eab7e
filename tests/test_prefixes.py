"""Which prefix an id has, by the index and by the join, against plain Python; and plans that don't grow."""

import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import cycles, governance, metrics
from tesserae.operators.governance import LayerPolicy, PrefixIndex, Subsystem, Subsystems
from tesserae.plans import presets
from tesserae.schema import graph

R = random.Random(2)
LETTERS = "ab.é\U0001f600z"


def exclusive(n):
    out = []
    while len(out) < n:
        p = "".join(R.choice(LETTERS) for _ in range(R.randint(3, 7)))
        if not any(p.startswith(q) or q.startswith(p) for q in out):
            out.append(p)
    return out


def test_index_and_join_against_plain_python(spark):
    for n in (0, 1, 2, 3, 33):
        prefixes = exclusive(n)
        ids = ["".join(R.choice(LETTERS) for _ in range(R.randint(0, 9))) for _ in range(300)] + prefixes + [p + "x" for p in prefixes] + [p[:-1] for p in prefixes] + [None]
        want = sorted(((i, next((f"name {p}" for p in prefixes if i is not None and i.startswith(p)), None)) for i in ids), key=str)
        df = spark.createDataFrame([(i, 1) for i in ids], "id string, name int")
        assert sorted(map(tuple, df.select("id", PrefixIndex([(p, f"name {p}") for p in prefixes]).name(F.col("id"))).collect()), key=str) == want
        table = spark.createDataFrame([(p, f"name {p}") for p in prefixes], "prefix string, name string")
        for limit in (governance.INDEXED, -1) if n else (governance.INDEXED,):
            found = governance.claimed_by(df, table, indexed=limit)
            assert found.columns == ["id", "name", "claimed_by"]
            assert sorted(((r["id"], r["claimed_by"]) for r in found.collect()), key=str) == want


def test_overlaps_are_found(spark):
    assert governance.overlapping(["b", "ab", "a.c", "abc"]) == ("ab", "abc") and governance.overlapping(["a", "a"]) == ("a", "a")
    assert governance.overlapping(["ab", "ac", "b"]) is None
    for rows in ([("ab", "x"), ("abc", "y")], [("ab", "x"), ("ab", "y")]):
        with pytest.raises(ValueError):
            PrefixIndex(rows)
        for limit in (governance.INDEXED, -1):
            with pytest.raises(ValueError):
                governance.claimed_by(spark.createDataFrame([("abcd",)], "id string"), spark.createDataFrame(rows, "prefix string, name string"), indexed=limit)
    with pytest.raises(ValueError):
        Subsystems((Subsystem("a", "x."), Subsystem("b", "x.y.")))


def test_plans_do_not_grow(spark):
    def size(n):
        """Parts of the expression, constants counting as one each."""
        plan = spark.range(5).select(F.col("id").cast("string").alias("id")).select(PrefixIndex([(f"{i:06d}.", f"s{i}") for i in range(n)]).name(F.col("id")))._jdf.queryExecution().analyzed()
        return plan.expressions().apply(0).treeString().count("\n")

    assert size(2) == size(5_000)
    ids = spark.range(200_000).select(F.format_string("%06d.x", F.col("id")).alias("id"))
    index = PrefixIndex([(f"{i:06d}.", f"s{i}") for i in range(50_000)])
    found = ids.select("id", index.name(F.col("id")).alias("by"))
    assert found.agg(F.count("by"), F.max("id"), F.count_if(F.expr("by <> concat('s', cast(substring(id, 1, 6) as int))"))).first()[0:3] == (50_000, "199999.x", 0)


def test_many_subsystems_judge_their_edges(spark):
    matrix = LayerPolicy(("PRESENTATION", "APPLICATION"), {"PRESENTATION": ("APPLICATION",)})
    other = LayerPolicy(("PRESENTATION", "APPLICATION"), {"APPLICATION": ("PRESENTATION",)})
    subs = Subsystems(tuple(Subsystem(f"s:{i}", f"m{i:03d}.", (matrix, other, None)[i % 3]) for i in range(300)))
    nodes = [(f"m{i:03d}.a", "COMPONENT", "PRESENTATION") for i in range(310)] + [(f"m{i:03d}.b", "COMPONENT", "APPLICATION") for i in range(310)]
    n, e = graph(spark, nodes, [(f"m{i:03d}.a", f"m{i:03d}.b", "CALL") for i in range(310)] + [(f"m{i:03d}.b", f"m{i:03d}.a", "CALL") for i in range(310)])
    got = {(r["src_id"], r["dst_id"]): (r["governed_by"], r["violating"]) for r in metrics.layer_edges(n, e, presets.layered().layer_policy, subs).collect()}
    for i in range(310):
        rule = i % 3 if i < 300 else 2
        by = f"s:{i}" if rule < 2 else None
        down, up = {0: (False, True), 1: (True, False), 2: (False, True)}[rule]
        assert got[(f"m{i:03d}.a", f"m{i:03d}.b")] == (by, down) and got[(f"m{i:03d}.b", f"m{i:03d}.a")] == (by, up)
    comps = cycles.components(n, e)
    rows = cycles.cycle_by_subsystem(comps, Subsystems((*subs.declared, Subsystem("none", "zzz.")))).collect()
    assert sorted((r["ord"], r["subsystem"], r["claimed"], r["participating"], r["value"]) for r in rows if r["subsystem"] != "none") == [(i, f"s:{i}", 2, 2, 1.0) for i in range(300)]
    assert [(r["claimed"], r["value"]) for r in rows if r["subsystem"] == "none"] == [(0, None)]
