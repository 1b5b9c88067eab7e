"""What goes to Python in one Arrow batch."""

import pyarrow as pa
import pytest

from tesserae.llm import packing, pretokens


def test_packing_sends_few_rows_to_python_at_once(spark, monkeypatch):
    pytest.importorskip("public_tokenizers")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(packing, "pieces", lambda docs, *_: docs.mapInArrow(sizes, "n long"))
    monkeypatch.setattr(packing, "packed", lambda cut, *_: cut)
    found = [r["n"] for r in packing.pack_documents(spark.range(0, 9000, 1, 1), "unread").collect()]
    assert sum(found) == 9000 and max(found) <= 2000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_odd_texts_leave_the_other_rows_as_they_are():
    pieces = pa.array([["z"], ["a", " b"], [], ["c"], [], []], pa.list_(pa.string())).slice(1)
    odd = pa.array([None, "x y", None, "w", ""], pa.string())
    assert pretokens.filled(pieces, odd, str.split).to_pylist() == [["a", " b"], ["x", "y"], ["c"], ["w"], []]
    assert pretokens.filled(pieces, pa.nulls(5, pa.string()), str.split) is pieces
