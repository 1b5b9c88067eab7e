"""Best-fit packing by the sum-of-squares rule: documents, cut at the sequence length, into few sequences.

Each piece goes into the open bin where the sum over gaps of (number of open bins with that gap) squared
becomes smallest; ties go to the fuller bin, and a bin is opened only where no open one has room. Pieces are dealt to groups of
about group_size, row by row, and every group is packed longest first on its own: the state is one count for each gap, so
memory and the result's quality don't depend on the corpus, nor on how often an id repeats.

Texts are encoded word by word, each distinct word of a batch once, by rounds of merges where the tokenizer is plain byte-level BPE, else by
the library; a text that has a string of the tokenizer's added tokens is
encoded whole by the library, which takes that string for the token (with special=False it is ordinary text).

Defined cases: null counts as an empty text, which is one piece with the end token alone; repeated rows, and rows without an
id, are packed as often as they occur; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import merges, pretokens
from tesserae.llm.common import stored

#: BATCH: rows of an Arrow batch, each of which brings all its words.
LENGTH, END, GROUP, CACHE, BATCH = 1024, 2, 20_000, 300_000, 2_000
_tokenizer: dict = {}


def _encoder(path: str):
    """The tokenizer of a file and its words so far: one for each Python worker, with a bounded memory."""
    if _tokenizer.get("path") != path:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _tokenizer.update(path=path, tokenizer=t, words={})
    return _tokenizer["tokenizer"], _tokenizer["words"]


def encode_words(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts) of the words, each encoded separately."""
    t, known = _encoder(path)
    new = [w for w in words if w not in known]
    if len(known) + len(new) > CACHE:
        known.clear()
        new = words
    for i in range(0, len(new), 10_000):
        for w, x in zip(new[i : i + 10_000], t.encode_batch_fast(new[i : i + 10_000], add_special_tokens=False)):
            known[w] = np.array(x.ids, np.uint32)
    found = [known[w] for w in words]
    return np.concatenate(found) if found else np.zeros(0, np.uint32), np.fromiter(map(len, found), np.int64, len(found))


def added_tokens(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f).get("added_tokens") or []]


def encode_whole(text: str, path: str) -> np.ndarray:
    """The ids of a text by the library alone, added tokens included."""
    t, _ = _encoder(path)
    t.encode_special_tokens = False
    try:
        return np.array(t.encode(text, add_special_tokens=False).ids, np.uint32)
    finally:
        t.encode_special_tokens = True


def pieces(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", length: int = LENGTH, end: int = END, special: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): only the first piece of a document may be shorter than the others."""
    added = added_tokens(path) if special else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        rounds = merges.plain(path)
        for batch in batches:
            odd = batch.column(2)
            whole = {k: x for k, x in enumerate(odd.to_pylist()) if x is not None and any(a in x for a in added)} if added and odd.null_count < len(odd) else {}
            if whole:
                odd = pa.array([None if k in whole else x for k, x in enumerate(odd.to_pylist())], pa.string())
            codes, offsets, words = pretokens.coded(batch.column(1), odd)
            ids, counts = merges.word_ids(merges.table(path), words, added=False) if rounds else encode_words(words.to_pylist(), path)
            starts, rows = np.cumsum(counts) - counts, []
            doc = batch.column(0).to_pylist()
            for lo in range(0, len(doc), 256):
                hi = min(lo + 256, len(doc))
                part = codes[offsets[lo] : offsets[hi]]
                flat = pretokens.gather(ids, starts[part], counts[part]).astype("<u4")
                cut = np.r_[0, np.cumsum(counts[part])][offsets[lo : hi + 1] - offsets[lo]]
                for k, i, a, b in zip(range(lo, hi), doc[lo:hi], cut[:-1].tolist(), cut[1:].tolist()):
                    own = encode_whole(whole[k], path) if k in whole else flat[a:b]
                    own, at, p = np.append(own, np.uint32(end)).astype("<u4"), 0, 0
                    n = (len(own) - 1) % length + 1
                    while at < len(own):
                        rows.append((i, p, at, n, zlib.crc32(own[at : at + n].tobytes())))
                        at, p, n = at + n, p + 1, length
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    split = pretokens.split(docs, F.col(text), F.col(id_col).cast("long").alias("doc_id"), apart=added)
    return split.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(lengths: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset, bins) of each length, longest first, by the sum-of-squares rule."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    counts = np.zeros(capacity + 1, np.int64)  # open bins by gap
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        if s > capacity:
            raise ValueError(f"a piece of {s} is longer than {capacity}")
        # change of the sum of squares when a bin of gap g takes the piece: (n[g]-1)^2 - n[g]^2 + (n[g-s]+1)^2 - n[g-s]^2
        after = 2 * counts[: capacity - s] + 1
        after[:1] = 0  # a full bin is closed and counts no more
        change = np.where(counts[s:-1] > 0, after - 2 * counts[s:-1] + 1, np.iinfo(np.int64).max)
        g = s + int(np.argmin(change)) if s < capacity else capacity
        if g == capacity or not counts[g]:
            g = capacity
            b, made = made, made + 1
        else:
            b = open_[g].pop()
            counts[g] -= 1
        bins[i], offsets[i] = b, capacity - g
        if g > s:
            counts[g - s] += 1
            open_[g - s].append(b)
    return bins, offsets, made


def packed(cut: DataFrame, capacity: int = LENGTH, group_size: int = GROUP) -> DataFrame:
    """cut with sequence_id and offset; cut is a stored table with doc_id, piece and length."""
    groups = max(1, round(cut.count() / group_size))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece", "length"], kind="stable")
        bins, offsets, _ = pack(group["length"].to_numpy(), capacity)
        return group.assign(sequence_id=group.pop("grp").astype("int64") * (1 << 40) + bins, offset=offsets)

    dealt = cut.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)))
    fields = ", ".join(f"`{n}` {t}" for n, t in cut.dtypes)
    return dealt.groupBy("grp").applyInPandas(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", length: int = LENGTH, end: int = END, group_size: int = GROUP, special: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    return packed(stored(pieces(docs, path, text, id_col, length, end, special), "pieces", BATCH), length, group_size)
