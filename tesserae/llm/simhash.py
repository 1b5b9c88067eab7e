"""SimHash near-duplicates: exact links within a Hamming distance, found by multi-index hashing.

Fingerprints. Lower-cased (A-Z) word shingles, repeats included, are hashed by XXH64 (UTF-8, seed 42);
bit b of a fingerprint is 1 if more than half of the hashes have it. A text of fewer words than a shingle
gives its whole sequence; one without words (null, empty, blank) has fingerprint zero and links like any other.

Links. The 64 bits are cut into segments. By the pigeonhole rule two fingerprints at distance d or less
agree in some segment up to a small radius; each distinct fingerprint goes to the table under its own
segments and enumerates the Hamming ball around each segment as probes. A probe and a table entry that
meet are verified by their complete distance. Only one of two neighbours need enumerate: the one with a
0 at the lowest differing bit. How many segments there are, how wide, and with which radii follows from the distance and
from the number of fingerprints: few wide ones have large balls, many narrow ones full buckets. A bucket
emits a spanning forest of its links, never all its pairs: an entry that has been reached is taken out of the search, so that
dense groups cost little.

Defined cases: repeated rows and equal texts share a fingerprint, of which the search sees one; an empty
table gives an empty result; null ids take no part in components; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import flat
from tesserae.llm.common import connected_components, partitions, stored, unused

SHINGLE, DISTANCE = 4, 4
#: Flips of a segment that a fingerprint may enumerate, and probes that one task sorts.
BALL, PROBES = 10_000, 4_000_000
#: Bucket entries that one comparison step holds at once.
BLOCK = 4096


def fingerprint_rows(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """The 64-bit SimHash of each text of a slab."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(offsets) - 1, np.uint64)
    s, e, rows = flat.word_spans(data, offsets)
    n = len(s)
    if not n:
        return out
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    # the words, joined by single blanks, with one blank after each
    length = e - s + 1
    at = np.r_[0, np.cumsum(length)]
    take = np.arange(at[-1]) + np.repeat(s - at[:-1], length)
    joined = lower[np.minimum(take, len(lower) - 1)]
    joined[at[1:] - 1] = 32
    text = joined.tobytes()
    begin = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    last = np.r_[begin[1:], n]
    row_last = np.repeat(last, last - begin)
    first = np.arange(n)
    keep = (first + k <= row_last) | np.isin(first, begin)
    first = first[keep]
    to = at[np.minimum(first + k, row_last[keep])] - 1
    hashes = np.fromiter((digest(text[i:j], 42) for i, j in zip(at[first].tolist(), to.tolist())), np.uint64, len(first))
    groups = np.flatnonzero(np.r_[True, rows[first][1:] != rows[first][:-1]])
    count = np.diff(np.r_[groups, len(first)])
    bits = np.zeros((len(groups), 64), np.int64)
    for b in range(64):
        bits[:, b] = np.add.reduceat(((hashes >> np.uint64(b)) & np.uint64(1)).astype(np.int32), groups)
    ones = (2 * bits > count[:, None]).astype(np.uint64)
    out[rows[first][groups]] = (ones << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return out


def _column(k: int):
    """The Arrow function from texts to fingerprints, as signed longs."""

    def run(texts: pa.Array) -> pa.Array:
        data, offsets = flat.flat(texts)
        fps = [fingerprint_rows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k) for i, j in flat.slabs(np.diff(offsets))]
        return pa.array(np.concatenate(fps or [np.zeros(0, np.uint64)]).view(np.int64))

    return F.arrow_udf(run, "long")


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), _column(k)(F.col(text).cast("string")).alias("fp"))


def segments(distance: int, n: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of each segment, for links up to distance among n fingerprints.

    Two fingerprints whose segments all differ by more than their radii differ by the sum of (radius + 1) at least, which is
    distance + 1: so none is lost. Of all numbers of segments the one is taken whose probes and comparisons with evenly filled buckets are fewest.
    """
    if not 0 <= distance < 64:
        raise ValueError("a distance between 0 and 63 is needed")
    best = None
    for m in range(1, distance + 2):
        radii = [(distance + 1 - m) // m + (i < (distance + 1 - m) % m) for i in range(m)]
        widths = [64 // m + (i < 64 % m) for i in range(m)]
        balls = [sum(comb(w, r) for r in range(1, radius + 1)) for w, radius in zip(widths, radii)]
        cost = sum((1 + ball / 2) * (1 + n / 2**w) for ball, w in zip(balls, widths))
        if max(balls) <= BALL and (best is None or cost < best[0]):
            first = [sum(widths[:i]) for i in range(m)]
            best = cost, list(zip(first, widths, radii))
    if best is None:
        raise ValueError(f"balls for distance {distance} are too large")
    return best[1]


def probes(fps: DataFrame, parts: list[tuple[int, int, int]]) -> DataFrame:
    """(seg, key, fp, probe): each fp under its segments, and as probes under the balls around them."""
    rows = []
    for i, (low, width, radius) in enumerate(parts):
        key = F.shiftrightunsigned("fp", low).bitwiseAND((1 << width) - 1) if width < 64 else F.col("fp")
        item = lambda k, probe: F.struct(F.lit(i).alias("seg"), k.alias("key"), F.lit(probe).alias("probe"))
        rows.append(F.array(item(key, False)))
        for r in range(1, radius + 1):
            for low_bit in range(width - r + 1):
                masks = [(1 << low_bit) | sum(1 << b for b in rest) for rest in combinations(range(low_bit + 1, width), r - 1)]
                signed = [x - (1 << 64) if x >> 63 else x for x in masks]
                ball = F.transform(F.array(*map(F.lit, signed)).cast("array<bigint>"), lambda x: item(key.bitwiseXOR(x), True))
                rows.append(F.when(F.shiftrightunsigned("fp", low + low_bit).bitwiseAND(1) == 0, ball).otherwise(F.array().cast("array<struct<seg:int,key:bigint,probe:boolean>>")))
    return fps.select("fp", F.explode(F.concat(*rows)).alias("p")).select("p.seg", "p.key", "fp", "p.probe")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _forest(table: np.ndarray, probe: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all entries which links of table-table and probe-table connect."""
    out = []
    nodes = np.r_[table, probe]
    own = np.r_[np.ones(len(table), bool), np.zeros(len(probe), bool)]
    left = np.arange(len(nodes))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.zeros(len(left), bool)
            for i in range(0, len(left), BLOCK * 16):
                part = left[i : i + BLOCK * 16]
                near[i : i + BLOCK * 16] = (_distance(nodes[part], nodes[at]) <= distance) & (own[part] | own[at])
            found = left[near]
            if len(found):
                out.append((np.full(len(found), nodes[at]), nodes[found]))
                queue.extend(found.tolist())
                left = left[~near]
    return out


def bucket_links(key: np.ndarray, fp: np.ndarray, probe: np.ndarray, distance: int = DISTANCE, small: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within buckets; rows come sorted by key, a bucket's table entries first."""
    if not len(key):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[begin, len(key)])
    tables = np.add.reduceat((~probe).astype(np.int64), begin)
    a, b = [], []
    live = (tables > 0) & (size > 1)
    # small buckets, all at once: entry i against entry i + step of the same bucket
    few = np.repeat(live & (size <= small), size)
    bucket = np.repeat(np.arange(len(begin)), size)
    for step in range(1, small):
        i = np.flatnonzero(few[:-step] & (bucket[:-step] == bucket[step:])) if len(key) > step else []
        if not len(i):
            break
        hit = i[(_distance(fp[i], fp[i + step]) <= distance) & ~(probe[i] & probe[i + step])]
        a.append(fp[hit])
        b.append(fp[hit + step])
    for g in np.flatnonzero(live & (size > small)):
        at, to = begin[g], begin[g] + size[g]
        for x, y in _forest(fp[at : at + tables[g]], fp[at + tables[g] : to], distance):
            a.append(x)
            b.append(y)
    return np.concatenate(a or [np.zeros(0, np.uint64)]), np.concatenate(b or [np.zeros(0, np.uint64)])


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(src, dst) over distinct fingerprints (column fp): enough verified links to connect whatever links connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if carry is None else pa.concat_tables([carry, pa.Table.from_batches([batch])])
            key = t.column("k").to_numpy()
            cut = int(np.searchsorted(key, key[-1])) if len(key) and np.all(key[1:] >= key[:-1]) else 0
            carry, head = t.slice(cut), t.slice(0, cut)
            if len(head):
                yield out(head)
        if carry is not None and len(carry):
            yield out(carry)

    def out(t: pa.Table) -> pa.RecordBatch:
        a, b = bucket_links(t.column("k").to_numpy(), t.column("fp").to_numpy().view(np.uint64), t.column("probe").to_numpy(), distance)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["src", "dst"])

    n = fps.count()
    parts = segments(distance, n)
    each = sum(1 + sum(comb(w, r) for r in range(1, radius + 1)) / 2 for _, w, radius in parts)
    p = probes(fps, parts).select(F.xxhash64("seg", "key").alias("k"), "fp", "probe")  # buckets that share a hash only cost time
    p = p.repartition(max(partitions(fps.sparkSession), int(n * each) // PROBES), "k").sortWithinPartitions("k", "probe")
    return p.mapInArrow(run, "src long, dst long")


def grouped(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, root, component_id) of distinct fingerprints: root tells components apart, component_id is the smallest doc_id in one."""
    firsts = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash")
    comp = connected_components(stored(links(firsts.select("fp"), distance), "simhash"))
    least = stored(comp.join(firsts, comp.node == firsts.fp).groupBy("component").agg(F.min("first").alias("least")), "simhash")
    of = comp.join(least, "component").select(F.col("node").alias("fp"), "component", "least")
    own = F.col("component").isNull()
    return stored(firsts.join(of, "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"), F.when(own, F.col("first")).otherwise(F.col("least")).alias("component_id")), "simhash")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", k: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row: component_id is the smallest doc_id linked, directly or not."""
    fps = stored(fingerprints(docs, text, id_col, k), "simhash")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(grouped(fps, distance), "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id", k: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row of each component: one with the smallest id, and of these one with the smallest fingerprint.

    Rows are told apart by id and fingerprint, so other texts of a repeated id stay, each in its own component. A row without an id can't be named by another
    and stays.
    """
    fps = stored(fingerprints(docs, text, id_col, k), "simhash")
    mine = fps.join(grouped(fps, distance), "fp").where("doc_id = component_id").groupBy("root", "doc_id", "fp").agg(F.count("*").alias("n"))
    id_, fp, n = unused(docs, "_id"), unused(docs, "_fp"), unused(docs, "_n")
    kept = mine.groupBy("root").agg(F.min(F.struct("doc_id", "fp", "n")).alias("k")).select(F.col("k.doc_id").alias(id_), F.col("k.fp").alias(fp), F.col("k.n").alias(n))
    kept = stored(kept, "simhash")
    columns, own = docs.columns, unused(docs, "_own")
    rows = docs.withColumn(own, _column(k)(F.col(text).cast("string")))
    # texts are dealt by id at every size; the hint keeps them unsorted. Fingerprints are never null, but equality would have Spark filter
    # them by that first, and so make each twice, in two Python workers of a task
    named = rows.join(kept.hint("shuffle_hash"), (F.col(id_col).cast("long") == F.col(id_)) & F.col(own).eqNullSafe(F.col(fp)))
    out = named.where(F.col(n) == 1) if kept.where(F.col(n) > 1).isEmpty() else named.dropDuplicates([id_, fp])
    return out.select(columns).unionByName(docs.where(F.col(id_col).isNull()))
