"""Registered queries over the driver's tables against brute force in plain Python, and the solver against another."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tesserae.llm import common, quality_model, quality_rules, queries

xxhash = pytest.importorskip("xxhash")
DATA, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def simhash_of(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(n, near):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in near:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_query(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in common.documents(spark, DATA).collect())
    fps = [simhash_of(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    first = grouped(len(rows), near)
    want = {d: (f"{fps[i]:016x}", rows[first[i]][0]) for i, (d, _) in enumerate(rows)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op7_simhash(spark, DATA).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(want)


def test_quality_rules_query(spark):
    """Cutoffs are certified on the larger table, and decide exactly what is kept."""
    docs, labels = common.documents(spark, LARGER), common.labels(spark, LARGER)
    stats = common.stored(quality_rules.statistics(docs), "rules")
    found = quality_rules.cutoffs(stats, labels).collect()
    cuts = {(r["stratum"], r["rule"]): r["cutoff"] for r in found}
    assert ("en", "symbol_share") in cuts and all(r["false_rejections"] <= 0.05 * r["n_good"] for r in found)
    own = {r["doc_id"]: r for r in stats.collect()}
    got = {r["doc_id"]: r for r in queries.op2_quality_rules(spark, LARGER).collect()}
    rejected = lambda r: any(r[rule] > cuts.get((r["stratum"], rule), 2.0) for rule in quality_rules.RULES)
    assert {d: r["kept"] for d, r in got.items()} == {d: not r["base_failed"] and not rejected(r) for d, r in own.items()}
    assert sum(rejected(r) and not r["base_failed"] for r in own.values()) > 10
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert sum(rejected(r) for d, r in own.items() if marks.get(d) == 1) == 0


def test_bradley_terry_against_plain_descent():
    r = np.random.default_rng(1)
    good, bad = r.normal(0.4, 1, (300, 4)), r.normal(0, 1, (200, 4))
    w = quality_model.bradley_terry(good, bad, pairs=2000, seed=3, ridge=1e-2)
    draw = np.random.default_rng(3)
    d = good[draw.integers(0, 300, 2000)] - bad[draw.integers(0, 200, 2000)]
    v = np.zeros(4)
    for _ in range(20_000):
        v -= 0.05 * (1e-2 * v - (d / (1 + np.exp(d @ v))[:, None]).mean(0))
    assert np.allclose(w, v, atol=1e-5)


def test_classifier_query_on_held_out_rows(spark):
    marks = {r["doc_id"]: r["quality"] for r in common.labels(spark, LARGER).collect()}
    got = {r["doc_id"]: r for r in queries.op9_quality_classifier(spark, LARGER).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"] and i in marks]
    assert len(held) > 50 and np.mean([got[i]["predicted"] == marks[i] for i in held]) > 0.97


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls, repeats of an id with equal and other texts, copies: each stage takes what the one before kept, and loses no clean row."""
    rows = [(r["doc_id"], r["text"]) for r in common.documents(spark, DATA).where("doc_id < 40").collect()]
    clean = [i for i, t in rows if len(WORD.findall(t or "")) > 60]
    extra = [(None, rows[0][1]), (None, None), (7, None), (7, rows[8][1]), (rows[3][0], rows[3][1]), (900_001, rows[5][1] + " token=abcdef123456"), (900_002, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t)) for i, t in rows + extra], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.stored(stage(spark, docs, DATA), name)
        if name != "packing":
            assert docs.columns == before.columns and docs.count() <= before.count()
    pieces = docs.collect()
    by = {}
    for r in pieces:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        assert [o for o, _ in sorted(own)] == np.cumsum([0] + [n for _, n in sorted(own)])[:-1].tolist() and sum(n for _, n in own) <= 1024
    kept = {r["doc_id"] for r in pieces}
    labels = {r["doc_id"]: r["quality"] for r in common.labels(spark, DATA).collect()}
    texts = dict(rows)
    alone = [i for i in clean if i != rows[8][0] and labels.get(i) == 1 and sum(simhash_of(t) == simhash_of(texts[i]) for _, t in rows) == 1]
    assert alone and set(alone) <= kept
