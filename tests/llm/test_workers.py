"""How often a text goes to Python on its way through a stage."""

from tesserae.llm import simhash


def test_a_row_that_may_stay_is_fingerprinted_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (3, "f g h i j k"), (None, "a")], "doc_id long, text string")
    kept = simhash.keep_one(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "a"), (1, "a b c d e"), (3, "f g h i j k")]
