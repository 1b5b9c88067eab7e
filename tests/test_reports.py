"""The report sink: whole bytes in order, nothing half written when tasks or jobs fail, and parts that are checked when they are read."""

import glob
import json
import os
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from tesserae.plans import documents
from tesserae.sources import bridge, reports
from tesserae.storage import stored

DATA = "/root/testdata/sf0.001"


def numbers(spark, n, parts=7):
    return spark.range(n).select(F.concat(F.lit("é"), F.col("id").cast("string"), F.lit(";")).alias("text"), "id").repartitionByRange(parts, "id").sortWithinPartitions("id").select("text")


def whole(path):
    return b"".join(reports.text(str(path))).decode()


def files(path):
    return sorted(os.path.basename(f) for f in glob.glob(f"{path}/*"))


def test_bytes_come_in_order_and_replace_what_was(spark, tmp_path):
    at = tmp_path / "doc"
    reports.write(numbers(spark, 1000), str(at))
    want = "".join(f"é{i};" for i in range(1000))
    assert whole(at) == want
    old = files(at)
    reports.write(numbers(spark, 10), f"file://{at}", "\n")
    assert whole(at) == "".join(f"é{i};\n" for i in range(10)) and not set(old) & set(files(at)) - {"manifest.json"}
    assert [r["text"] for r in reports.read(spark, str(at)).orderBy("part", "element").collect()] == [f"é{i};" for i in range(10)]
    reports.write(numbers(spark, 0), str(at))
    assert whole(at) == "" and reports.read(spark, str(at)).collect() == []
    with pytest.raises(Exception, match="can be replaced"):
        numbers(spark, 3).write.format(reports.NAME).mode("append").save(str(at))
    with pytest.raises(Exception, match="one column"):
        spark.range(3).write.format(reports.NAME).mode("overwrite").save(str(at))
    with pytest.raises(Exception, match="no document"):
        reports.read(spark, str(tmp_path / "nothing")).collect()


def test_a_failed_job_leaves_the_document_that_was_there(spark, tmp_path):
    at = tmp_path / "doc"
    reports.write(numbers(spark, 50), str(at))
    before, names = whole(at), files(at)
    bad = numbers(spark, 500).select(F.when(F.col("text") == "é400;", F.raise_error(F.lit("no"))).otherwise(F.col("text")).alias("text"))
    with pytest.raises(Exception):
        reports.write(bad, str(at))
    assert whole(at) == before and files(at) == names


def test_a_task_that_is_run_again_gives_the_same_bytes(tmp_path):
    """The parts of an attempt that died, or that lost against another, aren't in the document."""
    writer = reports.ReportWriter({"path": str(tmp_path / "doc")}, True)

    class Task:
        def __init__(self, partition, attempt):
            self.partition, self.attempt = partition, attempt

        def partitionId(self):
            return self.partition

        def taskAttemptId(self):
            return self.attempt

    def rows(k, fails=False):
        for i in range(5):
            if fails and i == 3:
                raise OSError("killed")
            yield (f"{k}.{i} ",)

    real, messages = TaskContext.get, []
    try:
        for partition, attempt, fails in ((1, 0, False), (0, 1, True), (0, 2, False), (0, 3, False)):
            TaskContext.get = classmethod(lambda cls, p=partition, a=attempt: Task(p, a))
            try:
                messages.append(writer.write(rows(partition, fails)))
            except OSError:
                pass
    finally:
        TaskContext.get = real
    assert [m.place for m in messages] == [1, 0, 0] and messages[1].sha256 == messages[2].sha256 and len(files(tmp_path / "doc")) == 4
    writer.commit([messages[0], messages[2]])
    assert whole(tmp_path / "doc") == "".join(f"{k}.{i} " for k in (0, 1) for i in range(5)) and len(files(tmp_path / "doc")) == 3
    reports.ReportWriter({"path": str(tmp_path / "doc")}, True).abort([])
    assert len(files(tmp_path / "doc")) == 3  # another job's parts stay


def test_texts_come_and_go_in_batches(tmp_path, monkeypatch):
    at = str(tmp_path / "doc")
    monkeypatch.setattr(reports.TaskContext, "get", classmethod(lambda cls: SimpleNamespace(partitionId=lambda: 0, taskAttemptId=lambda: 0)))
    writer = reports.ReportWriter({"path": at, "separator": "\n", "compression": "zstd"}, True)
    batches = [pa.record_batch([pa.array(x, pa.string())], ["text"]) for x in (["é1", "", "skipped"], [], ["2"])]
    done = writer.write(iter([batches[0].slice(0, 2), *batches[1:]]))
    writer.commit([done])
    assert (done.elements, b"".join(reports.text(at)).decode()) == (3, "é1\n\n2\n")
    reader = reports.ReportReader({"path": at})
    got = [b for p in reader.partitions() for b in reader.read(p)]
    assert pa.Table.from_batches(got).to_pydict() == {"part": [0, 0, 0], "element": [0, 1, 2], "text": ["é1", "", "2"]}
    with pytest.raises(ValueError, match="no text"):
        writer.write(iter([pa.record_batch([pa.array([None], pa.string())], ["text"])]))


def test_elements_are_sorted_before_their_text_is_made(spark):
    edges = bridge.edges(spark, DATA)
    (elements,) = [p for p in documents._edges(edges).pieces if isinstance(p, documents.Elements)]
    made, _, sorted_ = elements.sorted()._jdf.queryExecution().optimizedPlan().toString().partition("Sort ")
    assert "sourceAdapter" in made and sorted_ and "sourceAdapter" not in sorted_


def test_parts_are_checked(spark, tmp_path):
    at = tmp_path / "doc"
    reports.write(numbers(spark, 100), str(at))
    part = reports.manifest(str(at))["parts"][2]["name"]
    (at / part).write_bytes((at / part).read_bytes().replace(b"3", b"4"))
    with pytest.raises(Exception, match="isn't what the manifest says"):
        reports.read(spark, str(at)).collect()


def test_the_bridge_graph_s_report_is_its_text(spark, tmp_path):
    key = (bridge.SUBJECT, bridge.SCAN)
    nodes, edges = stored(bridge.nodes(spark, DATA), "nodes"), stored(bridge.edges(spark, DATA), "edges")
    doc = documents.graph(documents.mine(nodes, *key), documents.mine(edges, *key))
    doc.write(spark, str(tmp_path / "doc"))
    assert whole(tmp_path / "doc") == "".join(doc.text())
    assert json.loads(whole(tmp_path / "doc"))
