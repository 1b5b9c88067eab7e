"""Pre-tokens of byte-level BPE: the matches of the public split pattern, found on the JVM side.

The pattern is written for Java's engine with the white-space set spelt out. A text with a code point that
Java's Unicode tables don't know is split by the regex module instead, whose tables are newer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode's White_Space, and the public pattern with it in place of \s.
SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
JAVA = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def split(docs: DataFrame, text: Column, *keep: Column, apart: Iterable[str] = ()) -> DataFrame:
    """keep, pieces, odd: odd is the text where Java's tables don't do, or that has a string of apart, and pieces is empty then."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    rows = docs.select(*keep, text.alias("_text"))
    odd = F.col("_text").rlike(r"\p{Cn}")
    for word in apart:
        odd = odd | F.contains("_text", F.lit(word))
    pieces = F.when(odd, F.array().cast("array<string>")).otherwise(F.regexp_extract_all("_text", F.lit(JAVA), F.lit(0)))
    return rows.select(*[c for c in rows.columns if c != "_text"], pieces.alias("pieces"), F.when(odd, F.col("_text")).alias("odd"))


@lru_cache(1)
def _python_pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def filled(pieces: pa.ListArray, odd: pa.Array, cut: Callable[[str], list[str]]) -> pa.ListArray:
    """pieces with those of the odd texts; only these become Python objects, whatever else is in the batch."""
    if odd.null_count == len(odd):
        return pieces
    parts, at = [], 0
    for i in np.flatnonzero(odd.is_valid().to_numpy(zero_copy_only=False)).tolist():
        parts += [pieces.slice(at, i - at), pa.array([cut(odd[i].as_py())], pieces.type)]
        at = i + 1
    return pa.concat_arrays([*parts, pieces.slice(at)])


def coded(pieces: pa.ListArray, odd: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, offsets, words): each row's pre-tokens as places in the list of distinct words of the batch."""
    pieces = filled(pieces, odd, lambda text: _python_pattern().findall(text))
    offsets = pieces.offsets.to_numpy().astype(np.int64)
    flat = pieces.values.slice(offsets[0], offsets[-1] - offsets[0])
    if not len(flat):
        return np.zeros(0, np.int32), offsets - offsets[0], pa.array([], pa.string())
    d = pc.dictionary_encode(flat)
    return d.indices.to_numpy(zero_copy_only=False), offsets - offsets[0], d.dictionary


def gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[starts[i] : starts[i] + counts[i]] for all i, one after the other."""
    ends = np.cumsum(counts)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.arange(ends[-1]) + np.repeat(starts - (ends - counts), counts)]
