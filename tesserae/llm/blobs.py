"""Blocks of arrays in one binary column, so that what is shuffled for an entry is a few bytes."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed together; integers in their least width."""
    about, parts = [], []
    for x in arrays:
        if x.dtype.kind in "iu" and len(x) and x.min() >= 0:
            x = x.astype(np.min_scalar_type(int(x.max())))
        about.append((x.dtype.str, len(x)))
        parts.append(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes() if len(x) else b"")
    raw = pickle.dumps((about, b"".join(parts)))
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    about, raw = pickle.loads(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True))
    out, at = [], 0
    for kind, n in about:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).reshape(n) if n else np.zeros(0, kind))
        at += n * width
    return out


def blob_rows(rows: list[tuple], names: str = "chunk, place, blob") -> pa.RecordBatch:
    """Rows of two longs and a blob."""
    columns = zip(*rows) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], names.split(", "))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of 64-bit hashes: buckets ascend as hashes do."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def per_chunk(texts: DataFrame, answers: DataFrame, run: Callable[[int, bytes, list[tuple[int, bytes]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """run(chunk, blob, answers as (place, blob) in order) for each chunk of texts, which is bucketed by chunk: only the answers are shuffled."""

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        found = sorted(zip(right.column("place").to_pylist(), right.column("blob").to_pylist()), key=lambda x: x[0])
        return pa.Table.from_batches(run(left.column("chunk")[0].as_py(), left.column("blob")[0].as_py(), found))

    return texts.select("chunk", "blob").groupBy("chunk").cogroup(answers.select("chunk", "place", "blob").groupBy("chunk")).applyInArrow(each, schema)
