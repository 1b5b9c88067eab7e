"""Document fingerprints: MinHash over word shingles, band joins and verified Jaccard similarity.

Each of n_perm universal hash functions (a * x + b over 64 bits, the upper 32 kept) runs over all shingle
hashes of a text; a fingerprint is the list of the minima's low 16 bits. All of it is numpy over Arrow buffers.
Two fingerprints' likeness is the share of equal slots, which estimates the Jaccard similarity of the
shingle sets. Classes of equal shingle sets are the entries of a search: links() joins their signature bands in Spark and verifies the
exact Jaccard similarity, of sets with equal fingerprints, too; classed() names for every row the smallest doc_id that equal sets and links connect.

Defined cases: null counts as an empty text; a text without words has no shingles, every slot at its largest
value, and is like other such texts only; fewer words than a shingle form one shingle; equal texts have equal
fingerprints; repeated rows and ids are kept row by row, and an id with several texts is in the class of each; rows without an
id take no part in links; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm import bands, flat
from tesserae.llm.common import connected_components, partitions, stored

SHINGLE, PERMUTATIONS, SEED, SIMILARITY = 5, 128, 20, 0.8
#: 128 slots as 32 bands of 4: two texts of similarity 0.8 meet in some band but for one case in 10**7.
BANDS = 32


def coefficients(n_perm: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    a, b = rng.integers(0, 1 << 64, n_perm, np.uint64), rng.integers(0, 1 << 64, n_perm, np.uint64)
    return a | np.uint64(1), b


def signatures(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE, n_perm: int = PERMUTATIONS, seed: int = SEED) -> np.ndarray:
    """Rows of n_perm uint16 slots, one for each text of a slab."""
    out = np.full((len(offsets) - 1, n_perm), 0xFFFF, np.uint16)
    s, e, rows = flat.word_spans(data, offsets)
    if not len(s):
        return out
    values, at = flat.shingles(flat.span_hashes(data, s, e), rows, k)
    x = values >> np.uint64(32)
    begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    a, b = coefficients(n_perm, seed)
    v = np.empty_like(x)
    for j in range(n_perm):
        np.multiply(x, a[j], out=v)
        v += b[j]
        out[at[begin], j] = (np.minimum.reduceat(v, begin) >> np.uint64(32)).astype(np.uint16)
    return out


def all_signatures(column: pa.Array, **options) -> np.ndarray:
    data, offsets = flat.flat(column)
    parts = [signatures(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], **options) for i, j in flat.slabs(np.diff(offsets))]
    return np.concatenate(parts) if parts else np.zeros((0, options.get("n_perm", PERMUTATIONS)), np.uint16)


def hexed(sig: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in sig.astype(">u2")]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(1) if len(a) else np.zeros(0)


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", k: int = SHINGLE, n_perm: int = PERMUTATIONS) -> DataFrame:
    """(doc_id, fingerprint): hexadecimal, four digits a slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hexed(all_signatures(batch.column(1), k=k, n_perm=n_perm)), pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    out: list[np.ndarray] = []
    data, offsets = flat.flat(column)
    for i, j in flat.slabs(np.diff(offsets)):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        s, e, rows = flat.word_spans(part, at)
        values, owner = flat.shingles(flat.span_hashes(part, s, e) if len(s) else np.zeros(0, np.uint64), rows, k)
        cut = np.searchsorted(owner, np.arange(len(at)))
        out += [np.unique(values[x:y]) for x, y in zip(cut[:-1], cut[1:])]
    return out


def set_ids(sets: list[np.ndarray]) -> list[str]:
    return [hashlib.blake2b(x.tobytes(), digest_size=16).hexdigest() for x in sets]


def members(docs: DataFrame, text: str = "text", id_col: str = "doc_id", k: int = SHINGLE, n_perm: int = PERMUTATIONS) -> DataFrame:
    """(doc_id, fingerprint, set_id): set_id is a digest of the text's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = hexed(all_signatures(batch.column(1), k=k, n_perm=n_perm))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string()), pa.array(set_ids(shingle_sets(batch.column(1), k)), pa.string())], ["doc_id", "fingerprint", "set_id"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string, set_id string")


def entries(member: DataFrame) -> DataFrame:
    """(unit, first, n, fingerprint, set_id): classes of equal shingle sets, with their smallest doc_id and size, from members()."""
    rows = member.where("doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.min("fingerprint").alias("fingerprint"))
    return stored(rows.select(F.xxhash64("set_id").alias("unit"), "first", "n", "fingerprint", "set_id"), "minhash")


def links(docs: DataFrame, classes: DataFrame, text: str = "text", id_col: str = "doc_id", k: int = SHINGLE, n_perm: int = PERMUTATIONS, n_bands: int = BANDS, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, jaccard): verified links between classes, by unit.

    Buckets of a few classes give all their links, larger ones enough to connect what links connect (bands.links).
    """
    width = 4 * (n_perm // n_bands)
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("fingerprint", 1 + i * width, width)) for i in range(n_bands)])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shingle_sets(batch.column(1), k)
            # of an id's texts only those of the class count
            own = [i for i, (x, y) in enumerate(zip(set_ids(found), batch.column(2).to_pylist())) if x == y]
            short = [np.unique((found[i] >> np.uint64(32)).astype(np.uint32).view(np.int32)) for i in own]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), pa.array(short, pa.list_(pa.int32()))], ["unit", "shingles"])

    texts = docs.select(F.col(id_col).cast("long").alias("first"), F.col(text).cast("string").alias("text"))

    def sets_of(used: DataFrame) -> DataFrame:
        named = stored(used.join(classes, "unit").select("unit", "first", "set_id"), "minhash")
        found = texts.join(named, "first").select("unit", "text", "set_id").mapInArrow(sets, "unit long, shingles array<int>")
        return found.groupBy("unit").agg(F.min("shingles").alias("shingles"))

    return bands.links(classes.select(F.explode(keys).alias("key"), "unit"), sets_of, similarity)


def near_pairs(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """(a, b, jaccard): verified links between classes of equal shingle sets, each named by its smallest doc_id.

    Classes that share a band's key with more than bands.WHOLE others may be linked through some of them instead of each with each.
    """
    classes = entries(members(docs, text, id_col))
    found, names = links(docs, classes, text, id_col, **options), classes.select("unit", "first")
    named = found.join(names.toDF("a", "x"), "a").join(names.toDF("b", "y"), "b")
    return named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")


def classed(member: DataFrame, docs: DataFrame, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """member, members() as a stored table, with class_id: the smallest doc_id that equal shingle sets and links connect."""
    classes = entries(member)
    comp = stored(connected_components(links(docs, classes, text, id_col, **options), "a", "b"), "minhash")
    least = stored(comp.join(classes, comp.node == classes.unit).groupBy("component").agg(F.min("first").alias("class_id")), "minhash")
    linked = comp.join(least, "component").select(F.col("node").alias("unit"), "class_id")
    # of a class of one row without links the row's own id is the name
    several = classes.join(linked, "unit", "left").where("n > 1 or class_id is not null").select("unit", F.coalesce("class_id", "first").alias("class_id"))
    rows = member.withColumn("unit", F.xxhash64("set_id")).join(stored(several, "minhash"), "unit", "left").drop("unit")
    return rows.withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")))


def membership(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """(doc_id, class_id) of every row."""
    return classed(stored(members(docs, text, id_col), "minhash"), docs, text, id_col, **options).select("doc_id", "class_id")


def longs(values: list[int | None]) -> Column:
    """A constant array of longs, written as one string so that long ones stay one small expression."""
    text = ",".join("" if v is None else str(v) for v in values)
    return F.transform(F.split(F.lit(text), ","), lambda x: F.when(x != "", x.cast("long"))) if values else F.array().cast("array<long>")


def edited(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text, next_text) in partitions by ascending id, next_text being that of the next document.

    After the last document comes the first. Ids are dealt out by range: the ranges' bounds come from the ids
    alone; the first document of each range is also sent to the range before it. Rows without an id come first,
    rows of one id follow one another by text.
    """
    spark = docs.sparkSession
    n = 4 * partitions(spark)  # small ranges keep the buffers of sorting and of Arrow small
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("order"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    bounds = sorted(set(rows.select("order").stat.approxQuantile("order", [i / n for i in range(1, n)], 0.25 / n))) if n > 1 else []
    bounds = [int(b) for b in bounds if b > -(2.0**62)]
    # the number of bounds at or below an id, found in two steps of about the root of their number
    step = max(1, math.isqrt(len(bounds)))
    count = lambda bs: F.size(F.filter(bs, lambda b: b <= F.col("order")))
    coarse = count(longs(bounds[::step]))
    low = F.greatest(coarse - 1, F.lit(0)) * step
    part = F.when(coarse == 0, 0).otherwise(low + count(F.slice(longs(bounds), low + 1, step)))
    heads = sorted((r["part"], r["head"]) for r in rows.select("order").groupBy(part.alias("part")).agg(F.min("order").alias("head")).collect())
    # the head of each range goes, as a guard, to the last non-empty range before it; the first of all to the last
    head_of, guard_to = [None] * n, [None] * n
    for i, (p, head) in enumerate(heads):
        head_of[p], guard_to[p] = head, heads[i - 1][0]
    rows = rows.withColumn("part", part)
    own = F.struct("part", F.lit(False).alias("guard"))
    as_guard = F.when(F.get(longs(head_of), F.col("part")) == F.col("order"), F.struct(F.get(longs(guard_to), F.col("part")).cast("int").alias("part"), F.lit(True).alias("guard")))
    send = [own, as_guard]
    dealt = rows.select("order", "doc_id", "text", F.explode(F.filter(F.array(*send), lambda x: x.isNotNull())).alias("d")).select(F.col("d.part").alias("to"), "d.guard", "order", "doc_id", "text")
    return dealt.repartitionById(max(1, len(bounds) + 1), F.col("to")).sortWithinPartitions("guard", "order", "text")


def edited_fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", k: int = SHINGLE, n_perm: int = PERMUTATIONS) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last quarter the next document's beginning replaces."""
    import hashlib

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ended = None, False  # the last row awaits its successor
        for batch in batches:
            guards = batch.column(1).to_numpy(zero_copy_only=False)
            take = int(np.argmax(guards)) + 1 if guards.any() else len(guards)  # of several guards the first counts
            if ended or not take:
                continue
            ended = bool(guards.any())
            for i, j in flat.slabs(np.diff(flat.flat(batch.column(4))[1])[:take]):
                part = pa.Table.from_batches([batch]).slice(i, j - i).select(["doc_id", "text"])
                part = part if held is None else pa.concat_tables([held, part])
                held = part.slice(len(part) - 1)
                if len(part) > 1:
                    yield out(part)

    def out(t: pa.Table) -> pa.RecordBatch:
        texts = t.column("text").to_pylist()
        edit = [x[: len(x) - len(x) // 4] + y[: len(x) // 4] for x, y in zip(texts, texts[1:])]
        own = all_signatures(t.column("text").combine_chunks(), k=k, n_perm=n_perm)
        new = all_signatures(pa.array(edit, pa.large_string()), k=k, n_perm=n_perm)
        arrays = [
            t.column("doc_id").combine_chunks().slice(0, len(edit)), pa.array([len(x) for x in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edit], pa.string()), pa.array(hexed(own[:-1]), pa.string()), pa.array(hexed(new), pa.string()),
            pa.array(likeness(own[:-1], new)), pa.array(likeness(own[:-1], own[1:])),
        ]
        return pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return edited(docs, text, id_col).mapInArrow(run, schema)
