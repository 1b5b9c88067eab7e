"""The pipeline's stages in order, each against what it must have done to what the one before kept."""

import re

import corpus_pipeline
from tesserae.llm import common

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.documents(spark, DATA)
    columns, rows = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, DATA), name)
        rows[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    marks = {r["doc_id"]: r["quality"] for r in common.labels(spark, DATA).collect()}
    kept = {r["doc_id"] for r in rows["quality"]}
    assert all(i in kept for i, q in marks.items() if q == 1) and sum(i in kept for i, q in marks.items() if q == 0) == 0
    texts = [r["text"] for r in rows["near_dups"]]
    assert len(set(texts)) == len(texts) and len(texts) < len(rows["quality"])
    assert all(r["n_chars"] == len(r["text"]) for r in rows["secrets"])
    assert not any(re.search(r"[0-9a-f]{24,}", r["text"]) for r in rows["secrets"])
    assert {r["doc_id"] for r in rows["packing"]} == {r["doc_id"] for r in rows["secrets"]}
