"""Verified similarity links from banded signatures, without a cap on any bucket.

Entries that share a band's key are candidates. Up to WHOLE entries a bucket gives all its pairs, which joins verify. A larger
one goes, with its entries' shingle sets, to one task that finds a spanning forest of the bucket's links: entries are
compared with all others by postings until each is near one that was, and then all outside the largest component are, so
that no link between components is missed, while the many near copies of one text cost one comparison each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import partitions, stored

WHOLE = 48


def candidates(keyed: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(a, b, hot): pairs of entries that share a key, or with hot a large bucket's key and one entry of it. keyed has key and unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry_key, carry = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            key, unit = np.r_[carry_key, batch.column(0).to_numpy()], np.r_[carry, batch.column(1).to_numpy()]
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            yield out(key[:cut], unit[:cut])
            carry_key, carry = key[cut:], unit[cut:]
        yield out(carry_key, carry)

    def out(key: np.ndarray, unit: np.ndarray) -> pa.RecordBatch:
        a, b, hot = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(0, np.int64)
        if len(key) > 1:
            begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[begin, len(key)])
            start, small, place = np.repeat(begin, size), np.repeat(size <= whole, size), np.arange(len(key))
            for step in range(1, whole):
                i = np.flatnonzero(small[step:] & (start[step:] <= place[:-step]) & (unit[step:] != unit[:-step])) if len(key) > step else []
                if not len(i) and step >= size.max():
                    break
                a.append(np.minimum(unit[i], unit[i + step]) if len(i) else unit[:0])
                b.append(np.maximum(unit[i], unit[i + step]) if len(i) else unit[:0])
            hot = np.flatnonzero(~small)
        n = sum(map(len, a))
        flags = np.r_[np.zeros(n, bool), np.ones(len(hot), bool)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([*a, key[hot]])), pa.array(np.concatenate([*b, unit[hot]])), pa.array(flags)], ["a", "b", "hot"])

    rows = keyed.select("key", "unit").repartition(partitions(keyed.sparkSession), "key").sortWithinPartitions("key", "unit")
    return rows.mapInArrow(run, "a long, b long, hot boolean").distinct()


def forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int, float]]:
    """(i, j, Jaccard) of links that connect all entries which links connect."""
    k, size = len(sets), np.array([len(s) for s in sets])
    values, owner = np.concatenate(sets), np.repeat(np.arange(k), size)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    parent = list(range(k))
    found: list[tuple[int, int, float]] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def visit(i: int) -> np.ndarray:
        lo, hi = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
        n = hi - lo
        at = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
        common = np.bincount(owner[at], minlength=k)
        union = size + size[i] - common
        near = np.flatnonzero(common >= similarity * union)
        for j in near.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((i, j, float(common[j] / max(union[j], 1))))
        return near

    done, visited = np.zeros(k, bool), np.zeros(k, bool)
    for i in range(k):
        if not done[i]:
            visited[i] = done[i] = True
            done[visit(i)] = True
    roots = np.array([root(i) for i in range(k)])
    largest = np.bincount(roots, minlength=k).argmax()
    for i in np.flatnonzero((roots != largest) & ~visited).tolist():
        visit(i)
    return found


def links(keyed: DataFrame, sets_of, similarity: float, whole: int = WHOLE) -> DataFrame:
    """(a, b, jaccard), a < b, over distinct entries. keyed has (key, unit); sets_of(used) gives (unit, shingles) of the
    entries in used, with distinct ascending values in shingles."""
    spark = keyed.sparkSession
    found = stored(candidates(keyed, whole), "bands")
    pairs, hot = found.where("not hot").select("a", "b"), found.where("hot").select(F.col("a").alias("key"), F.col("b").alias("unit"))
    used = pairs.select(F.col("a").alias("unit")).union(pairs.select(F.col("b").alias("unit"))).union(hot.select("unit")).distinct()
    sets = stored(sets_of(used), "bands")
    both = pairs.join(sets.select(F.col("unit").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("unit").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    both = both.select("a", "b", common.alias("n"), (F.size("sa") + F.size("sb") - common).alias("u"))
    direct = both.where(F.col("n") >= similarity * F.col("u")).select("a", "b", F.when(F.col("u") == 0, 1.0).otherwise(F.col("n") / F.col("u")).alias("jaccard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, units, shingles = None, [], []
        for batch in batches:
            offsets, values = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy()
            for i, (k, u) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if k != key and units:
                    yield out(units, shingles)
                    units, shingles = [], []
                key = k
                units.append(u)
                shingles.append(values[offsets[i] : offsets[i + 1]])
        if units:
            yield out(units, shingles)

    def out(units: list[int], shingles: list[np.ndarray]) -> pa.RecordBatch:
        rows = [(min(units[i], units[j]), max(units[i], units[j]), x) for i, j, x in forest(shingles, similarity)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 3, (pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "jaccard"])

    large = hot.join(sets, "unit").select("key", "unit", "shingles").repartition(partitions(spark), "key").sortWithinPartitions("key", "unit")
    return stored(direct.unionByName(large.mapInArrow(run, "a long, b long, jaccard double")).groupBy("a", "b").agg(F.max("jaccard").alias("jaccard")), "bands")
