"""Classes of the registered query against brute-force Jaccard, and different texts with equal fingerprints."""

import re

import pytest

from tesserae.llm import common, minhash, queries

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def classes(rows):
    """The least id that equal sets, and sets alike by 0.8, connect; rows are (id, text)."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and (a == b or len(a & b) >= 0.8 * len(a | b)):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {d: rows[find(i)][0] for i, (d, _) in enumerate(rows)}


def test_query_against_brute_force(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in common.documents(spark, DATA).collect())
    got = {r["doc_id"]: r["class_id"] for r in queries.minhash_classes(spark, DATA).collect()}
    want = classes(rows)
    assert got == want and len(set(want.values())) < len(want)


def test_every_pair_of_like_texts_is_verified(spark):
    base = [f"w{i}" for i in range(1500)]
    texts = []
    for k in range(40):
        w = list(base)
        w[20 * k + 7] = f"other{k}"
        texts.append(" ".join(w))
    sets = [shingles(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {(r["a"], r["b"]): r["jaccard"] for r in minhash.near_pairs(docs).collect()}
    want = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(40) for j in range(i + 1, 40)}
    assert got == pytest.approx(want)
