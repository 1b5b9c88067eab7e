"""Byte-level BPE encoding and decoding by one global shuffle of distinct words.

1. Each text is split into pre-tokens once, and chunks of texts are coded and stored: a chunk's distinct words, and for every text
   the sequence of their places, which keeps the pre-tokens' positions.
2. The chunks' distinct words are shuffled by word, as one block for each bucket of words: all chunks' copies of a word meet in
   one task, which encodes it once, by its bytes' ranks, and answers every chunk that has it with the ids.
3. Codes and answers meet at the chunk, where each text's ids are put together by position. Decoding joins the ids with the
   token-byte table, which has as many rows as the vocabulary and is sent to every task; decode() joins any ids with it.

A word is one entry in each chunk, so no word's entries are more than there are chunks. There is a bucket for about WORDS entries, so
tasks stay as large as they are when the corpus grows. The stored chunks are bucketed and never shuffled; chunks of one bucket
are put together one after the other.

Defined cases: null counts as an empty text, which has no ids; repeated rows are encoded row by row; special tokens'
strings are ordinary text; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import flat, pretokens
from tesserae.llm.blobs import blob_rows, bucket_of, pack, per_chunk, unpack
from tesserae.llm.common import bucketed, partitions

#: Pre-tokens of a chunk, and distinct words of chunks in a bucket.
PIECES, WORDS = 2_000_000, 250_000


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def _encoding(path: str):
    import tiktoken

    # a pre-token is encoded whole: the pattern takes all there is
    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks(path), special_tokens={})


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, bytes) of the vocabulary; as many rows as it has tokens, whatever the corpus."""
    return spark.createDataFrame(pa.table({"id": pa.array(list(ranks(path).values()), pa.int32()), "bytes": pa.array(list(ranks(path)), pa.binary())}))


def id_type(path: str) -> np.dtype:
    return np.dtype("<u2" if max(ranks(path).values()) < 1 << 16 else "<u4")


CODED = "chunk long, words long, blob binary, bytes binary"


def strings(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    """The strings of these lengths, one after the other in data."""
    offsets = np.r_[0, np.cumsum(lengths.astype(np.int64))].astype(np.int32)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))


def coded(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for each chunk of texts: ids, lengths and word codes; and its distinct words, by ascending hash."""
    names = [x.split()[0] for x in CODED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, offsets, words = pretokens.coded(batch.column(2), batch.column(3))
            data, at = flat.flat(words)
            hashes = flat.span_hashes(data, at[:-1], at[1:]) if len(words) else np.zeros(0, np.uint64)
            ids = batch.column(0).to_pylist()
            for lo, hi in flat.slabs(np.diff(offsets), PIECES):
                own, place = np.unique(codes[offsets[lo] : offsets[hi]], return_inverse=True)
                order = np.argsort(hashes[own], kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                own = own[order]
                chunk, seq = batch.column(1)[0].as_py() * (1 << 32) + seq, seq + 1
                null = np.array([x is None for x in ids[lo:hi]], np.uint8)
                blob = pack(np.array([0 if x is None else x for x in ids[lo:hi]], np.int64), null, np.diff(offsets[lo : hi + 1]), rank[place])
                sizes = (at[1:] - at[:-1])[own]
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([len(own)], pa.int64()), pa.array([blob], pa.binary()), pa.array([pack(sizes, pretokens.gather(data, at[:-1][own], sizes))], pa.binary())], names)

    split = pretokens.split(docs, F.col(text), F.col(id_col).cast("long").alias("doc_id"), F.spark_partition_id().alias("part"))
    return split.mapInArrow(run, CODED)


def blocks(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, chunk, blob): each chunk's words by ranges of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sizes, data = unpack(blob)
                ends = np.cumsum(sizes.astype(np.int64))
                starts = ends - sizes
                to = bucket_of(flat.span_hashes(data, starts, ends), buckets) if len(sizes) else ends
                cut = np.searchsorted(to, np.arange(buckets + 1))
                rows = []
                for b in np.flatnonzero(np.diff(cut)).tolist():
                    i, j = cut[b], cut[b + 1]
                    rows.append((b, chunk, pack(sizes[i:j], data[starts[i] : ends[j - 1]])))
                yield blob_rows(rows, "bucket, chunk, blob")

    return texts.select("chunk", "bytes").mapInArrow(run, "bucket long, chunk long, blob binary")


def answers(dealt: DataFrame, path: str) -> DataFrame:
    """(chunk, place, blob) from blocks, a bucket per partition: each distinct word of the bucket is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [x for b in batches for x in zip(*(c.to_pylist() for c in b.columns))]
        if not found:
            return
        encode, kind = _encoding(path).encode_ordinary, id_type(path)
        parts = [strings(*unpack(blob)) for _, _, blob in found]
        d = pc.dictionary_encode(pa.concat_arrays(parts))
        lists = [encode(w) for w in d.dictionary.to_pylist()]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter((i for x in lists for i in x), kind, int(counts.sum()))
        starts, at, begin = np.cumsum(counts) - counts, d.indices.to_numpy(), 0
        for (bucket, chunk, _), words in zip(found, parts):
            own = at[begin : begin + len(words)]
            begin += len(words)
            yield blob_rows([(chunk, bucket + 1, pack(counts[own], pretokens.gather(ids, starts[own], counts[own])))], "chunk, place, blob")

    return dealt.mapInArrow(run, "chunk long, place long, blob binary")


def decoded_words(sequences: DataFrame, path: str) -> DataFrame:
    """(ids, bytes) of distinct id sequences: each id meets the token table, and the bytes are put in order."""
    table = token_table(sequences.sparkSession, path)
    each = sequences.select("ids", F.posexplode("ids").alias("at", "id")).join(F.broadcast(table), "id")
    ordered = each.groupBy("ids").agg(F.array_sort(F.collect_list(F.struct("at", "bytes"))).alias("parts"))
    return ordered.select("ids", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["bytes"])), "")).alias("bytes"))


def round_trip(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", full: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; with full also ids and the decoded bytes."""
    spark = docs.sparkSession
    texts = bucketed(coded(docs, text, id_col), "texts", "chunk")
    buckets = max(partitions(spark), -(-texts.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0] // WORDS))
    found = answers(blocks(texts, buckets).repartitionById(buckets, F.col("bucket").cast("int")), path)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 6 if full else 4]
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary())
    # as many rows as the vocabulary has, whatever the corpus
    table = spark.sparkContext.broadcast([(r["id"], bytes(r["bytes"])) for r in token_table(spark, path).orderBy("id").collect()])

    def assemble(_: int, blob: bytes, parts: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        size = np.zeros(table.value[-1][0] + 1, np.int64)
        size[[i for i, _ in table.value]] = [len(b) for _, b in table.value]
        data = np.frombuffer(b"".join(b for _, b in table.value), np.uint8)
        yield from out(blob, [b for _, b in parts], data, np.cumsum(size) - size, size)

    def out(blob: bytes, parts: list[bytes], data: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        doc_ids, null, n, codes = unpack(blob)
        found = [unpack(p) for p in parts]
        kind = id_type(path)
        ids = np.concatenate([np.zeros(0, kind), *(x[1].astype(kind) for x in found)])
        per_word = np.concatenate([np.zeros(0, np.int64), *(x[0].astype(np.int64) for x in found)])
        starts, codes, ends = np.cumsum(per_word) - per_word, codes.astype(np.int64), np.cumsum(n.astype(np.int64))
        texts = [",".join(map(str, ids[a : a + c].tolist())) for a, c in zip(starts.tolist(), per_word.tolist())]
        cols: list[list] = [[] for _ in names]
        held = 0
        for doc, no, a, b in zip(doc_ids.tolist(), null.tolist(), (ends - n).tolist(), ends.tolist()):
            own = codes[a:b]
            tokens = pretokens.gather(ids, starts[own], per_word[own]).astype(np.int32)
            decoded = pretokens.gather(data, start[tokens], size[tokens]).tobytes()  # each id joins its row of the token table
            row = (None if no else doc, len(tokens), hashlib.sha256(",".join([texts[c] for c in own.tolist()]).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest(), tokens, decoded)
            for c, v in zip(cols, row):
                c.append(v)
            held += len(decoded) * full
            if held > 32 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
                cols, held = [[] for _ in names], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return per_chunk(texts, found, assemble, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * full)


def encode(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of every row."""
    return round_trip(docs, path, text, id_col, full=True).select("doc_id", "ids")


def decode(rows: DataFrame, path: str, ids: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, bytes) of rows with arrays of ids: ids join the token table and are put in order; ids may repeat over rows."""
    found = decoded_words(rows.where(F.size(ids) > 0).select(F.col(ids).alias("ids")).distinct(), path)
    return rows.select(F.col(id_col).alias("doc_id"), F.col(ids).alias("ids")).join(found, "ids", "left").select("doc_id", F.coalesce("bytes", F.lit(b"")).alias("bytes"))
