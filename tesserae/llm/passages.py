"""Substring dedup: passages that repeat across documents, by paragraph MinHash banding and exact word windows.

Near copies. A paragraph is a line of MIN_PARAGRAPH words or more. Equal paragraphs are one entry; entries that share a
MinHash band (ROWS slots, BANDS bands: similarity 0.8 meets with probability 0.999) become candidates, the exact
Jaccard similarity of their 5-word shingle sets is verified, and links join into components. The occurrence
in the document with the smallest id stays, in all others the paragraph is marked.

Exact passages anywhere. Every window of MIN_RUN words that a document with a smaller id also has is marked, word by word, so
a repeated run is marked to its true ends whatever stands around it. Each window is named by the least of its hashes of
ANCHOR words; only windows whose anchor several documents have are shuffled. A sentence (up to a line end, or a stop before
white space; long ones are cut where a word's hash says so) of MIN_SENTENCE words or more that a document with a smaller id
also has is marked, too.

Marked spans that touch, or that fewer than MIN_SENTENCE words separate, form a run; runs of MIN_RUN words or more are
removed, and shorter ones where a whole paragraph is marked. Repeats within one document stay.

Defined cases: null counts as an empty text, without passages; rows that repeat an id with one text are one document, whose
spans hold for each row; rows that repeat an id with several texts are told apart by a hash of the text, each has its own
spans, and none repeats another; rows without an id are left alone; empty tables give empty results. Extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import bands, flat
from tesserae.llm.common import connected_components, partitions, stored, unused
from tesserae.llm.minhash import coefficients

SHINGLE, SIMILARITY = 5, 0.8
ROWS, BANDS = 3, 10
MIN_PARAGRAPH, MIN_SENTENCE, LONG = 20, 4, 40
#: Words of an exact window, and of the least run of them that goes.
WINDOW, MIN_RUN = 20, 36
#: Words of an anchor; bits of the filter over keys that several documents have: more keys than fit only let more rows pass.
ANCHOR, FILTER_BITS, BLOCK = 8, 28, 4096
#: A key of more rows is dealt by so many salts.
HOT, SALTS = 20_000, 32
#: Texts that are Python objects at once.
PART = 500
MARKED = "doc_id long, variant long, keeper long, first int, words int"


def breaks(data: np.ndarray, s: np.ndarray, e: np.ndarray, rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line ends, sentence ends): whether a line or a sentence ends with each word."""
    lines = np.r_[0, np.cumsum(data == 10)]
    last = np.ones(len(s), bool)
    last[:-1] = (rows[1:] != rows[:-1]) | (lines[s[1:]] > lines[e[:-1]])
    stop = last | np.isin(data[e - 1], np.frombuffer(b".!?", np.uint8))
    begin = np.flatnonzero(np.r_[True, stop[:-1]])
    long = np.repeat(np.diff(np.r_[begin, len(s)]) > LONG, np.diff(np.r_[begin, len(s)]))
    return last, stop | (long & (hashes % np.uint64(8) == 0))


def sequence_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the words start to end of each range."""
    up, down = flat.powers(len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return flat.mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def _words(column: pa.Array) -> Iterator[tuple]:
    """(first row, bytes, start, end, row, hash) of the words of each slab."""
    data, offsets = flat.flat(column)
    for i, j in flat.slabs(np.diff(offsets)):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        s, e, rows = flat.word_spans(part, at)
        yield i, j, part, at, s, e, rows, flat.span_hashes(part, s, e) if len(s) else np.zeros(0, np.uint64)


UNITS = "doc_id long, variant long, unit long, first int, words int, keys array<long>, shingles array<int>"


def units(rows: DataFrame) -> DataFrame:
    """Paragraphs of _texts rows, with band keys and distinct shingle hashes, by word places."""
    a, b = coefficients(ROWS * BANDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, variants = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for i, _, data, _, s, e, rows, h in _words(batch.column(1)):
                if not len(s):
                    continue
                yield out(ids[i + rows], variants[i + rows], h, np.searchsorted(rows, rows), breaks(data, s, e, rows, h)[0], MIN_PARAGRAPH)

    def out(ids: np.ndarray, variants: np.ndarray, h: np.ndarray, origin: np.ndarray, ends: np.ndarray, least: int) -> pa.RecordBatch:
        to = np.flatnonzero(ends) + 1
        at = np.r_[0, to[:-1]]
        keep = to - at >= least
        at, to = at[keep], to[keep]
        n = len(at)
        cols = [pa.array(ids[at], pa.int64()), pa.array(variants[at], pa.int64()), pa.array(sequence_hashes(h, at, to).view(np.int64)), pa.array((at - origin[at]).astype(np.int32)), pa.array((to - at).astype(np.int32))]
        if not n:
            return pa.RecordBatch.from_arrays([*cols, pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32()))], names)
        count = to - at - SHINGLE + 1
        starts = np.arange(count.sum()) + np.repeat(at - (np.cumsum(count) - count), count)
        x = flat.chain(h, starts, SHINGLE) >> np.uint64(32)
        cut = np.cumsum(count) - count
        keys = np.zeros((n, BANDS), np.uint64)
        for k in range(ROWS * BANDS):
            least_of = np.minimum.reduceat(x * a[k] + b[k], cut)
            keys[:, k // ROWS] = flat.mix(keys[:, k // ROWS] * np.uint64(0x9FB21C651E98DF25) + (least_of >> np.uint64(32)) + np.uint64(k + 1))
        order = np.lexsort((x, np.repeat(np.arange(n), count)))
        group, value = np.repeat(np.arange(n), count)[order], x[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (value[1:] != value[:-1])]
        sizes = np.bincount(group[new], minlength=n)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(value[new].astype(np.uint32).view(np.int32)))
        banks = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
        return pa.RecordBatch.from_arrays([*cols, banks, lists], names)

    names = ["doc_id", "variant", "unit", "first", "words", "keys", "shingles"]
    return rows.mapInArrow(run, UNITS)


def windows(h: np.ndarray, rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, place in the anchors, anchors) of every window of length words; equal windows have equal anchors."""
    k = min(ANCHOR, length)
    at = np.arange(max(0, len(h) - length + 1))
    at = at[rows[at] == rows[at + length - 1]]
    if not len(at):
        return at, at, np.zeros(0, np.int64)
    starts = np.arange(len(h) - k + 1)
    x = sequence_hashes(h, starts, starts + k)
    chosen = at.copy()
    least = x[at]
    for j in range(1, length - k + 1):
        now = x[at + j]
        less = np.flatnonzero(now < least)
        least[less] = now[less]
        chosen[less] = at[less] + j
    new = np.r_[True, chosen[1:] != chosen[:-1]]  # the places ascend, as leftmost least values do
    return at, np.cumsum(new) - 1, x[chosen[new]].view(np.int64)


def _texts(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """(doc_id, text, variant); variant is 0 but for ids with several texts, where it is a hash of the text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    sizes = rows.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
    several = stored(sizes.where("a <> b").select("doc_id"), "passages")
    if several.isEmpty():
        return rows.withColumn("variant", F.lit(0).cast("long"))
    return rows.join(several.withColumn("several", F.lit(True)), "doc_id", "left").select("doc_id", "text", F.when(F.col("several"), F.xxhash64("text")).otherwise(0).alias("variant"))


def _sentences(data: np.ndarray, s: np.ndarray, e: np.ndarray, rows: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    to = np.flatnonzero(breaks(data, s, e, rows, h)[1]) + 1
    at = np.r_[0, to[:-1]]
    keep = to - at >= MIN_SENTENCE
    at, to = at[keep], to[keep]
    return at, to, sequence_hashes(h, at, to).view(np.int64)


def shared_keys(rows: DataFrame, length: int, hot: int = HOT) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the sentences and anchors that several documents have, and of those that occur more than hot times, if any.

    Their size is bounded; they let others pass, too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, data, _, s, e, rows, h in _words(batch.column(1)):
                if not len(s):
                    continue
                at, _, unit = _sentences(data, s, e, rows, h)
                w, index, anchor = windows(h, rows, length)
                owner = np.zeros(len(anchor), np.int64)
                owner[index] = ids[i + rows[w]]
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[unit, anchor]), pa.array(np.r_[ids[i + rows[at]], owner])], ["unit", "doc_id"])

    keys = rows.mapInArrow(run, "unit long, doc_id long").groupBy("unit").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n"))
    seen = stored(keys.where("least < most").select("unit", (F.col("n") > hot).alias("hot")), "passages")
    bits = min(FILTER_BITS, max(15, (8 * seen.count()).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags: dict[int, np.ndarray] = {}  # as many as the task has blocks, however many keys come
        for batch in batches:
            places = np.sort(batch.column(0).to_numpy())
            used, begin = np.unique(places // (8 * BLOCK), return_index=True)
            for u, own in zip(used.tolist(), np.split(places, begin[1:])):
                flags.setdefault(u, np.zeros(8 * BLOCK, bool))[own % (8 * BLOCK)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(flags), pa.int64()), pa.array([np.packbits(f).tobytes() for f in flags.values()], pa.binary())], ["block", "bits"])

    out = []
    often = seen.where("hot")
    for part in (seen, often) if not often.isEmpty() else (seen,):
        place = part.select(F.col("unit").bitwiseAND((1 << bits) - 1).alias("bit"))
        flags = np.zeros(((1 << bits) // 8 // BLOCK, BLOCK), np.uint8)
        for r in place.repartition(partitions(rows.sparkSession), F.floor(F.col("bit") / (8 * BLOCK))).mapInArrow(mark, "block long, bits binary").toLocalIterator():
            flags[r["block"]] |= np.frombuffer(r["bits"], np.uint8)
        out.append(flags.ravel())
    return out[0], out[1] if len(out) > 1 else np.zeros(0, np.uint8)


FOUND = "unit long, salt int, doc_id long, variant long, first int, words int"


def repeated_words(rows: DataFrame, length: int = WINDOW, hot: int = HOT) -> DataFrame:
    """(doc_id, variant, keeper, first, words) of sentences and of windows of length words that a document with a smaller id has, too.

    A key's rows go to one task, as a stream. Those of keys that may have more than hot rows are salted by their document; a pass before,
    where there are such keys, finds their least documents by partial aggregation, which go as rows of no words to the salts
    that have any. A word that repeats on and on gives one row, not one for each window.
    """
    spark = rows.sparkSession
    bitmaps = spark.sparkContext.broadcast(shared_keys(rows, length, hot))
    names = [x.split()[0] for x in FOUND.split(", ")]

    def rows_of(only_hot: bool):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shared, common = bitmaps.value

            def has(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
                bit = keys & np.int64(max(len(bitmap), 1) * 8 - 1)
                return (bitmap[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 > 0 if len(bitmap) else np.zeros(len(keys), bool)

            for batch in batches:
                ids, variants = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                for i, _, data, _, s, e, owner, h in _words(batch.column(1)):
                    if not len(s):
                        continue
                    at, to, unit = _sentences(data, s, e, owner, h)
                    often = has(common, unit)
                    keep = has(shared, unit) & (often | (not only_hot))
                    at, to, unit, often = at[keep], to[keep], unit[keep], often[keep]
                    w, index, anchor = windows(h, owner, length)
                    many = has(common, anchor)
                    keep = (has(shared, anchor) & (many | (not only_hot)))[index]
                    w, many = w[keep], many[index][keep]
                    named = sequence_hashes(h, w, w + length).view(np.int64)
                    begin = np.flatnonzero(np.r_[True, (named[1:] != named[:-1]) | (w[1:] != w[:-1] + 1)]) if len(w) else w
                    ends = w[np.r_[begin[1:], len(w)] - 1] + length if len(w) else w
                    at, to, unit, often = np.r_[at, w[begin]], np.r_[to, ends], np.r_[unit, named[begin]], np.r_[often, many[begin]]
                    first, row = at - np.searchsorted(owner, owner[at]), i + owner[at]
                    salt = np.where(often, 1 + np.abs(ids[row] % SALTS), 0).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(unit), pa.array(salt), pa.array(ids[row], pa.int64()), pa.array(variants[row], pa.int64()), pa.array(first.astype(np.int32)), pa.array((to - at).astype(np.int32))], names)

        return run

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = keeper = None
        for batch in batches:
            if not batch.num_rows:
                continue
            unit, salt, doc = (batch.column(i).to_numpy() for i in range(3))
            begin = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]) | (salt[1:] != salt[:-1])])
            of = doc[begin]
            if (unit[0], salt[0]) == key:
                of[0] = keeper
            key, keeper = (unit[-1], salt[-1]), of[-1]
            of = np.repeat(of, np.diff(np.r_[begin, len(unit)]))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(of), batch.column(4), batch.column(5)], ["doc_id", "variant", "keeper", "first", "words"]).filter(pa.array(doc > of))

    found = rows.mapInArrow(rows_of(False), FOUND)
    if len(bitmaps.value[1]):
        each = rows.mapInArrow(rows_of(True), FOUND).groupBy("unit", "salt").agg(F.min("doc_id").alias("doc_id")).where("salt > 0")
        firsts = stored(each.groupBy("unit").agg(F.min("doc_id").alias("doc_id"), F.collect_list("salt").alias("salts")).where(F.size("salts") > 1), "passages")
        zero = F.lit(0)
        found = found.unionByName(firsts.select("unit", F.explode("salts").alias("salt"), "doc_id", zero.cast("long").alias("variant"), zero.alias("first"), zero.alias("words")))
    dealt = found.repartition(partitions(spark), "unit", "salt").sortWithinPartitions("unit", "salt", "doc_id")
    return dealt.mapInArrow(least, MARKED)


def similar_paragraphs(paragraphs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, variant, keeper, first, words) of paragraphs equal to or like one of a document with a smaller id."""
    entries = stored(paragraphs.groupBy("unit").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.first("keys").alias("keys")), "passages")
    sets_of = lambda used: paragraphs.join(used, "unit", "left_semi").select("unit", "shingles").dropDuplicates(["unit"])
    links = bands.links(entries.select(F.explode("keys").alias("key"), "unit"), sets_of, similarity)
    comp = connected_components(links, "a", "b")
    keepers = stored(comp.join(entries, comp.node == entries.unit).groupBy("component").agg(F.min("least").alias("keeper")), "passages")
    of = comp.join(keepers, "component").select(F.col("node").alias("unit"), "keeper")
    # a paragraph whose copies are all exact has no links and so no component
    alone = entries.where("least < most").join(of, "unit", "left_anti").select("unit", F.col("least").alias("keeper"))
    of = stored(of.unionByName(alone), "passages")
    return paragraphs.select("unit", "doc_id", "variant", "first", "words").join(of, "unit").where("doc_id > keeper").select("doc_id", "variant", "keeper", "first", "words")


SPANS = "array<struct<first int, words int>>"


def repeats(rows: DataFrame, similarity: float = SIMILARITY, min_run: int = MIN_RUN) -> DataFrame:
    """(doc_id, variant, spans, keepers) of _texts rows: runs to remove, as (first word, words), and the documents that keep them; only documents with any."""
    paragraphs = similar_paragraphs(stored(units(rows), "passages"), similarity).withColumn("whole", F.lit(True))
    marked = paragraphs.unionByName(stored(repeated_words(rows, min(WINDOW, min_run)), "passages").withColumn("whole", F.lit(False)))
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())])), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = [np.zeros(0, np.int64)] * 6
        for batch in batches:
            if batch.num_rows:
                now = [np.r_[c, batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64)] for k, c in enumerate(carry)]
                new = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1]))
                cut = int(new[-1]) + 1 if len(new) else 0
                yield out(*[c[:cut] for c in now])
                carry = [c[cut:] for c in now]
        yield out(*carry)

    def out(doc: np.ndarray, variant: np.ndarray, first: np.ndarray, words: np.ndarray, keeper: np.ndarray, whole: np.ndarray) -> pa.RecordBatch:
        made: list[tuple] = []
        if len(doc):
            new = np.r_[True, (doc[1:] != doc[:-1]) | (variant[1:] != variant[:-1])]
            base = np.cumsum(new) << 32  # keeps the running ends of documents apart
            end = np.maximum.accumulate(base + first + words)
            begin = np.flatnonzero(new | np.r_[True, base[1:] + first[1:] - end[:-1] >= MIN_SENTENCE])
            last = np.r_[begin[1:], len(doc)]
            start, size = first[begin], end[last - 1] - base[begin] - first[begin]
            enough = (size >= min_run) | (np.maximum.reduceat(whole, begin) > 0)
            for k in np.flatnonzero(enough).tolist():
                span = {"first": int(start[k]), "words": int(size[k])}
                keepers = np.unique(keeper[begin[k] : last[k]]).tolist()
                of = (int(doc[begin[k]]), int(variant[begin[k]]))
                if made and made[-1][:2] == of:
                    made[-1][2].append(span)
                    made[-1][3].update(keepers)
                else:
                    made.append((*of, [span], set(keepers)))
        cols = zip(*[(d, v, s, sorted(k)) for d, v, s, k in made]) if made else ([], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "variant", "spans", "keepers"])

    each = marked.select("doc_id", "variant", "first", "words", "keeper", "whole").repartition(partitions(rows.sparkSession), "doc_id").sortWithinPartitions("doc_id", "variant", "first")
    return each.mapInArrow(run, f"doc_id long, variant long, spans {SPANS}, keepers array<long>")


def report(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """(doc_id, class_id, removed_words, n_spans, spans, keepers) of every row: class_id is the smallest doc_id that shared passages connect."""
    texts = _texts(docs, text, id_col)
    found = stored(repeats(texts, **options), "passages")
    comp = stored(connected_components(found.select("doc_id", F.explode("keepers").alias("keeper")), "doc_id", "keeper"), "passages")
    rows = texts.select("doc_id", "variant").unionByName(docs.where(F.col(id_col).cast("long").isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("variant")))
    rows = rows.join(found, ["doc_id", "variant"], "left").join(comp.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    none = F.array().cast(SPANS)
    spans = F.coalesce("spans", none)
    text_of = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["first"], s["first"] + s["words"])), ",")
    removed = F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["words"])
    return rows.select("doc_id", F.coalesce("component", "doc_id").alias("class_id"), removed.alias("removed_words"), F.size(spans).cast("long").alias("n_spans"), text_of.alias("spans"), F.coalesce(F.array_join("keepers", ","), F.lit("")).alias("keepers"))


def removed(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the repeated passages; a document of which no word is left goes."""
    key, cut, kind, own = (unused(docs, n) for n in ("_id", "_spans", "_variant", "_own"))
    texts = _texts(docs, text, id_col)
    found = stored(repeats(texts, **options).select(F.col("doc_id").alias(key), F.col("variant").alias(kind), F.col("spans").alias(cut)), "passages")
    # texts are dealt by id at every size; the hint keeps them unsorted
    same = F.col(kind).isin(0) | (F.col(kind) == F.col(own))
    hashed = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    rows = hashed.join(found.hint("shuffle_hash"), (F.col(id_col).cast("long") == F.col(key)) & same, "left").select(*docs.columns, cut)
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, PART) for b in batches for k in range(0, b.num_rows, PART)):
            texts, spans, gone = batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), []
            for k, (t, runs) in enumerate(zip(texts, spans)):
                if not runs:
                    continue
                raw = t.encode()
                s, e, _ = flat.word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                out, last = [], 0
                for r in runs:
                    out.append(raw[last : s[r["first"]]])
                    end = r["first"] + r["words"]
                    last = int(s[end]) if end < len(s) else len(raw)
                out.append(raw[last:])
                texts[k] = b"".join(out).decode().rstrip(" ")
                if not texts[k].strip(" \t\n\r\x0b\x0c"):
                    gone.append(k)
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            keep = np.ones(batch.num_rows, bool)
            keep[gone] = False
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    return rows.mapInArrow(run, docs.schema)
