"""Report documents as a Spark sink and source: df.write.format("tesserae_report"), parts in order, and a manifest that makes them a document.

A task streams its rows' texts into a part of its own, under a name that no other attempt has, and reports the part's place, size and digest.
When all tasks are done the driver writes the manifest, which lists the parts in order, beside its place and moves it there: until then
readers see the document that was there before, or none. A job that fails leaves no manifest, and its parts are deleted; parts
of attempts that lost are deleted when the winner's manifest is there. Rows go out in the order they have: sort them before.

Reading gives the document's elements, part by part, in order; a part whose size or digest isn't the manifest's is refused.

Options: path (by any URI that Arrow's file systems open; on a cluster a store that all executors reach), separator (what ends an element, "" or a line
end; only with one are elements told apart when they are read), compression ("", gzip or zstd, of each part; sizes and digests are the text's).
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tesserae.schema import not_blank, require
from tesserae.sources.datasource import file_system

NAME, MANIFEST = "tesserae_report", "manifest.json"
CHUNK = 1 << 20


@dataclass
class PartWritten(WriterCommitMessage):
    place: int
    name: str
    size: int
    sha256: str
    elements: int


def manifest(path: str) -> dict | None:
    """What the document at path is made of; None where there is no document."""
    fs, base = file_system(path)
    if fs.get_file_info(f"{base}/{MANIFEST}").type != pafs.FileType.File:
        return None
    with fs.open_input_stream(f"{base}/{MANIFEST}") as f:
        return json.loads(f.read())


class ReportWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path = not_blank(options.get("path"), "path").rstrip("/")
        self.separator, self.compression = options.get("separator", ""), options.get("compression") or None
        require(self.compression in (None, "gzip", "zstd"), "parts are plain, gzip or zstd")
        require(self.separator in ("", "\n"), "elements end with nothing or with a line end")
        require(overwrite or manifest(self.path) is None, f"there is a document at {self.path}: it can be replaced, not appended to")
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch | Row]) -> PartWritten:
        task = TaskContext.get()
        name = f"part-{self.job}-{task.partitionId():06d}-{task.taskAttemptId()}"
        fs, base = file_system(self.path)
        fs.create_dir(base, recursive=True)
        digest, size, n = hashlib.sha256(), 0, 0
        with fs.open_output_stream(f"{base}/{name}", compression=self.compression) as out:
            for some in iterator:
                texts = some.column(0) if isinstance(some, pa.RecordBatch) else pa.array([some[0]], pa.string())
                data = ended(texts, self.separator)
                out.write(data)
                digest.update(data)
                size += len(data)
                n += len(texts)
        return PartWritten(task.partitionId(), name, size, digest.hexdigest(), n)

    def commit(self, messages: Sequence[PartWritten | None]) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.place)
        fs, base = file_system(self.path)
        fs.create_dir(base, recursive=True)
        listed = [{"name": m.name, "size": m.size, "sha256": m.sha256, "elements": m.elements} for m in parts]
        with fs.open_output_stream(f"{base}/{MANIFEST}.{self.job}") as out:
            out.write(json.dumps({"job": self.job, "separator": self.separator, "compression": self.compression, "parts": listed}, indent=1).encode())
        fs.move(f"{base}/{MANIFEST}.{self.job}", f"{base}/{MANIFEST}")
        self._clean(fs, base, {m.name for m in parts})

    def abort(self, messages: Sequence[PartWritten | None]) -> None:
        fs, base = file_system(self.path)
        self._clean(fs, base, set(), f"part-{self.job}-")

    def _clean(self, fs: pafs.FileSystem, base: str, kept: set[str], prefix: str = "part-") -> None:
        for x in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
            if x.base_name.startswith(prefix) and x.base_name not in kept:
                fs.delete_file(x.path)


def ended(texts: pa.Array, separator: str) -> memoryview:
    """The bytes of the texts, each followed by the separator."""
    require(texts.null_count == 0, "an element has no text")
    whole = pc.binary_join_element_wise(texts.cast(pa.large_binary()), pa.scalar(separator.encode(), pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    if not len(whole):
        return memoryview(b"")
    _, places, data = whole.buffers()
    ends = np.frombuffer(places, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    return memoryview(data or b"")[int(ends[0]) : int(ends[-1])]


@dataclass
class Stretch(InputPartition):
    place: int
    name: str
    size: int
    sha256: str


class ReportReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = not_blank(options.get("path"), "path").rstrip("/")
        found = manifest(self.path)
        require(found is not None, f"no document at {self.path}")
        self.about: dict = found

    def partitions(self) -> Sequence[Stretch]:
        return [Stretch(i, p["name"], p["size"], p["sha256"]) for i, p in enumerate(self.about["parts"])]

    def read(self, partition: Stretch | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        end = self.about["separator"].encode()
        seen, size, rest, n = hashlib.sha256(), 0, b"", 0

        def batch(texts: list[bytes]) -> pa.RecordBatch:
            place, at = pa.array(np.full(len(texts), partition.place, np.int32)), pa.array(np.arange(n, n + len(texts)))
            return pa.RecordBatch.from_arrays([place, at, pa.array(texts, pa.binary()).cast(pa.string())], ["part", "element", "text"])

        for data in chunks(self.path, partition.name, self.about.get("compression")):
            seen.update(data)
            size += len(data)
            *whole, rest = (rest + data).split(end) if end else (rest + data,)
            if whole:
                yield batch(whole)
                n += len(whole)
        require((size, seen.hexdigest()) == (partition.size, partition.sha256), f"{partition.name} isn't what the manifest says")
        if rest:
            yield batch([rest])


def chunks(path: str, name: str, compression: str | None = None) -> Iterator[bytes]:
    fs, base = file_system(path)
    with fs.open_input_stream(f"{base}/{name}", compression=compression) as f:
        while data := f.read(CHUNK):
            yield data


def text(path: str) -> Iterator[bytes]:
    """The document's bytes, in order, a chunk at a time."""
    about = manifest(path)
    require(about is not None, f"no document at {path}")
    for p in about["parts"]:
        yield from chunks(path, p["name"], about.get("compression"))


class ReportSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "part int, element long, text string"

    def reader(self, schema: StructType) -> ReportReader:
        return ReportReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        require([f.dataType.simpleString() for f in schema] == ["string"], "a document is written from one column of texts")
        return ReportWriter(dict(self.options), overwrite)


def write(rows: DataFrame, path: str, separator: str = "", compression: str = "") -> None:
    """The texts of rows, one sorted column, as a document at path, in place of one that is there."""
    rows.sparkSession.dataSource.register(ReportSource)
    rows.write.format(NAME).option("separator", separator).option("compression", compression).mode("overwrite").save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(part, element, text) of a document."""
    spark.dataSource.register(ReportSource)
    return spark.read.format(NAME).load(path)
