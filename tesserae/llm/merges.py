"""BPE by batched rounds of merges in numpy: the symbols of many words lie in one flat array.

1. Texts are split into pre-tokens on the JVM side; a batch's distinct words become symbols, one for each byte, in one array with links
   to the next and the previous symbol of the word.
2. Every pair of neighbours has a rank: its key (left id times the size of the vocabulary plus right id) is found by
   binary search among the sorted keys of all merges. In a round each word merges its pair of lowest rank wherever it stands, from
   left to right; only what a merge touches is looked up again. Words without a pair left are done, and the arrays are
   packed when half of them is.
3. A text's ids are its words' ids by position. Decoding gathers the ids' bytes.

All of one pair can be merged in a round because a merge's parts are made by merges of lower rank only; a file where that does not
hold, or with settings that are not plain byte-level BPE, is refused. Memory follows the batch, whatever the corpus. A word of n symbols takes
as many rounds as it has different merges, so time for a word of a million letters without a blank is about n times some thousands.

Defined cases: null counts as an empty text, which has no ids; repeated rows are encoded row by row; added tokens' strings in a
text are those tokens, as in the library; an empty table gives an empty result; extra columns are ignored. Decoding passes over
ids outside the vocabulary, and bytes that aren't UTF-8 become U+FFFD; null ids count as none.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import flat, pretokens

#: Pre-tokens that are put together at once, bytes of a batch that is given back, and symbols that go through rounds at once.
PIECES, BYTES, SYMBOLS = 1_000_000, 16 << 20, 1 << 19
NONE = np.iinfo(np.int32).max


class Table(NamedTuple):
    """A tokenizer's file as arrays: ids of single bytes; sorted pair keys with their ranks; what a rank makes; ids' bytes; added tokens."""

    size: int
    of_byte: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    makes: np.ndarray
    start: np.ndarray
    length: np.ndarray
    data: np.ndarray
    added: dict[str, int]


def byte_symbols() -> dict[str, int]:
    """The visible code point that byte-level vocabularies write for each byte: itself where it prints, else one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain(path: str) -> bool:
    """Whether table() takes the file."""
    try:
        table(path)
    except ValueError:
        return False
    return True


@lru_cache(2)
def table(path: str) -> Table:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += [k for k in ("lstrip", "rstrip", "single_word", "normalized") for t in spec.get("added_tokens") or [] if t.get(k)]
    if odd or model.get("type", "BPE") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError(f"{path} is not plain byte-level BPE {odd}")
    vocab, byte = model["vocab"], byte_symbols()
    merges = [tuple(x.split(" ", 1)) if isinstance(x, str) else tuple(x) for x in model["merges"]]
    made: dict[str, int] = {}
    for rank, (a, b) in enumerate(merges):
        if a + b in made or any(len(x) > 1 and x not in made for x in (a, b)):
            raise ValueError(f"{path}: merge {rank} is made before its parts, or twice")
        made[a + b] = rank
    added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
    size = 1 + max([*vocab.values(), *added.values()])
    keys = np.array([vocab[a] * size + vocab[b] for a, b in merges], np.int64)
    order = np.argsort(keys, kind="stable")
    tokens: list[bytes] = [b""] * size
    for word, i in [*vocab.items(), *added.items()]:
        tokens[i] = bytes(map(byte.get, word)) if all(c in byte for c in word) else word.encode()
    length = np.fromiter(map(len, tokens), np.int64, size)
    makes = np.array([vocab[a + b] for a, b in merges], np.int32)
    return Table(size, np.array([vocab[c] for c in sorted(byte, key=byte.get)], np.int32), keys[order], order.astype(np.int32), makes, np.cumsum(length) - length, length, np.frombuffer(b"".join(tokens), np.uint8), added)


def pair_ranks(t: Table, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ranks of pairs of ids, NONE where no merge takes them."""
    if not len(t.keys):
        return np.full(len(left), NONE, np.int32)
    key = left.astype(np.int64) * t.size + right
    at = np.minimum(np.searchsorted(t.keys, key), len(t.keys) - 1)
    return np.where(t.keys[at] == key, t.ranks[at], NONE).astype(np.int32)


def merged(t: Table, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts) of words; symbols has the words' ids one after the other, counts how many each has, at least one."""
    sym, name = symbols.astype(np.int32), np.arange(len(counts))  # name: which word it is, of those left
    done_ids, done_names, done_counts = [], [], []
    fresh = True
    while len(name):
        if fresh:
            n = len(sym)
            word = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
            begin = np.cumsum(counts) - counts
            after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
            after[begin + counts - 1] = before[begin] = -1
            rank = np.full(n, NONE, np.int32)
            inner = np.flatnonzero(after >= 0)
            rank[inner] = pair_ranks(t, sym[inner], sym[inner + 1])
            alive, fresh = np.ones(n, bool), False
        least = np.minimum.reduceat(rank, begin)
        over = least == NONE
        if over.all() or counts[over].sum() * 2 > n or alive.sum() * 2 < n:
            left = np.bincount(word[alive], minlength=len(counts))
            out = over[word]
            done_ids.append(sym[alive & out])
            done_names.append(name[over])
            done_counts.append(left[over])
            sym, name, counts, fresh = sym[alive & ~out], name[~over], left[~over], True
            continue
        at = np.flatnonzero((rank == least[word]) & (rank < NONE))
        # of pairs that overlap (one symbol, three times or more in a row) every second is merged, from the left
        joined = np.r_[False, after[at[:-1]] == at[1:]]
        place = np.arange(len(at))
        since = place - np.maximum.accumulate(np.where(joined, 0, place))
        at = at[since % 2 == 0]
        gone = after[at]
        sym[at] = t.makes[rank[at]]
        alive[gone], rank[gone] = False, NONE
        after[at] = after[gone]
        follows = at[after[at] >= 0]
        before[after[follows]] = follows
        changed = np.unique(np.r_[at, before[at][before[at] >= 0]])
        right = after[changed]
        rank[changed] = np.where(right >= 0, pair_ranks(t, sym[changed], sym[right]), NONE)
    if not done_names:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    ids, names, sizes = np.concatenate(done_ids), np.concatenate(done_names), np.concatenate(done_counts)
    order = np.argsort(names)
    starts = np.cumsum(sizes) - sizes
    return pretokens.gather(ids, starts[order], sizes[order]), sizes[order]


def word_ids(t: Table, words: pa.Array, added: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts) of distinct words; with added, a word that is an added token's string is that token."""
    data, offsets = flat.flat(words)
    sizes = np.diff(offsets)
    # some words at a time, so that the arrays of a round stay small whatever the batch
    parts = [merged(t, t.of_byte[data[offsets[i] : offsets[j]]], sizes[i:j]) for i, j in flat.slabs(sizes, SYMBOLS)]
    ids, counts = (np.concatenate([empty, *(p[k] for p in parts)]) for k, empty in ((0, np.zeros(0, np.int32)), (1, np.zeros(0, np.int64))))
    whole = pc.index_in(words, pa.array(list(t.added), pa.string())) if t.added and added else None
    if whole is None or whole.null_count == len(words):
        return ids, counts
    which = np.flatnonzero(whole.is_valid().to_numpy(zero_copy_only=False))
    starts = np.cumsum(counts) - counts
    tokens = np.array(list(t.added.values()), np.int32)[whole.drop_null().to_numpy()]
    # the tokens go to the end of the ids, and their words point there
    starts[which], counts[which] = len(ids) + np.arange(len(which)), 1
    return pretokens.gather(np.r_[ids, tokens], starts, counts), counts


def _cutter(added: dict[str, int]):
    """A function that gives a text's added tokens, longest first where several begin, and the pre-tokens between them."""
    import public_tokenizers
    import regex

    words = regex.compile(public_tokenizers.PATTERN)
    tokens = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def cut(text: str) -> list[str]:
        parts = tokens.split(text) if tokens else [text]
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else words.findall(part))]

    return cut


def encode(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", packed: bool = False) -> DataFrame:
    """(doc_id, ids) of every row; packed gives ids as little-endian unsigned 32-bit integers in a binary column."""
    with open(path, encoding="utf-8") as f:
        added = [x["content"] for x in json.load(f).get("added_tokens") or []]
    kind = pa.large_binary() if packed else pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(path)
        cut = _cutter(t.added)
        for batch in batches:
            doc, pieces, odd = batch.columns
            codes, offsets, words = pretokens.coded(pretokens.filled(pieces, odd, cut), pa.nulls(len(doc), pa.string()))
            ids, counts = word_ids(t, words)
            starts = np.cumsum(counts) - counts
            for lo, hi in flat.slabs(np.diff(offsets), PIECES):
                own = codes[offsets[lo] : offsets[hi]]
                tokens = pretokens.gather(ids, starts[own], counts[own])
                cuts = np.r_[0, np.cumsum(counts[own])][offsets[lo : hi + 1] - offsets[lo]]
                if packed:
                    column = pa.LargeBinaryArray.from_buffers(kind, hi - lo, [None, pa.py_buffer((4 * cuts).astype(np.int64).tobytes()), pa.py_buffer(tokens.astype("<u4").tobytes())])
                    column = column.cast(pa.binary())
                else:
                    column = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(tokens, pa.int32()))
                yield pa.RecordBatch.from_arrays([doc.slice(lo, hi - lo), column], ["doc_id", "ids"])

    split = pretokens.split(docs, F.col(text), F.col(id_col).cast("long").alias("doc_id"), apart=added)
    return split.mapInArrow(run, f"doc_id long, ids {'binary' if packed else 'array<int>'}")


def decode(rows: DataFrame, path: str, ids: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids, text) of rows with ids as an array or packed."""
    packed = dict(rows.dtypes)[ids] == "binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(path)
        for batch in batches:
            found, texts, at = batch.column(1), [], 0
            for k, x in enumerate(found):
                tokens = np.frombuffer(x.as_py() or b"", "<u4").astype(np.int64) if packed else pc.drop_null(x.values).to_numpy() if x.is_valid else np.zeros(0, np.int64)
                tokens = tokens[(tokens >= 0) & (tokens < t.size)]
                texts.append(pretokens.gather(t.data, t.start[tokens], t.length[tokens]).tobytes().decode(errors="replace"))
                if k + 1 == len(found) or sum(map(len, texts[-1:])) > BYTES or len(texts) == 1024:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), found.slice(at, len(texts)), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])
                    at, texts = k + 1, []

    chosen = rows.select(F.col(id_col).alias("doc_id"), F.col(ids).alias("ids"))
    return chosen.mapInArrow(run, f"doc_id {dict(rows.dtypes)[id_col]}, ids {dict(rows.dtypes)[ids]}, text string")
