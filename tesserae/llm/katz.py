"""Katz backoff: Good-Turing discounted n-gram counts, exactly normalised backoff weights, scores of whole texts by recursion.

A text's tokens are its lower-cased (A-Z) words and one end; ends also stand before the first word. For a history h of k - 1
tokens, P_k(w | h) is d_k(c) * c(h, w) / c(h) where training has the n-gram, else alpha(h) * P_{k-1}(w | h'), h' being h without
its first token; a history that training doesn't have backs off wholly. P_1 is discounted in the same way, and what it leaves
belongs to the unknown word. alpha(h) is what the seen words of h leave, over what P_{k-1} leaves that they haven't used, so
that P_k(. | h) sums to 1. Counts up to CUT are discounted by Good-Turing from the counts of counts of their order; where those
don't give discounts between 0 and 1 (tiny corpora), absolute discounts n1 / (n1 + 2 * n2) stand in. A history without a
count to discount leaves 1 / (c + 1).

1. Texts are coded once, in chunks, and stored: every later step reads the same coded chunks, whatever is lost or run again.
2. Order by order, a chunk sends its distinct n-grams with their training counts, as one block for each bucket of histories. A
   bucket's blocks meet in one task, which sums them into that bucket's part of the table of the order and answers each
   block: the number and count of each n-gram, and what the histories' weights need. An n-gram's number names it as a
   history of the next order. N-grams of which training has no shorter form are not sent.
3. With the discounts, from all counts of counts, and the answers of all orders a chunk evaluates its tokens recursively, from
   the unigram up, and adds up its texts.

With keep the buckets' tables are stored, and tables() gives the n-grams, with counts and probabilities, and the histories, with
backoff weights. Without, a table lives as long as its bucket's task, whose answers hold all that the chunks need of it.

Blocks are compressed columns, so that what is shuffled for a token is a few bytes. There is a bucket for about TARGET tokens of
the corpus, so tasks stay as large as they are when the corpus grows. A history of more than a quarter of TARGET tokens is split
over several buckets by its next word; its sums (at most four for each bucket) are added up and sent to all.

Defined cases: null counts as an empty text, whose only token is the end; a null id is held out; repeated rows count and are
scored row by row; without training texts every score is log10 of the unknown word's probability, 1; an empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import flat
from tesserae.llm.blobs import blob_rows, bucket_of, pack, per_chunk, unpack
from tesserae.llm.common import bucketed, fresh_path, partitions, release, stored, stored_at

ORDER, CUT = 3, 5
FOLDS, FOLD = 7, 2
END = np.int64(0x51A7E0F1E57)  # stands for the end among word hashes
CHUNK_TOKENS = 1_000_000
#: Tokens of a bucket; the bits of a number that count rows in a bucket, above them is the bucket.
TARGET, ROW_BITS = 1_000_000, 40


def held_out(ids: list[int | None], folds: int = FOLDS, fold: int = FOLD) -> np.ndarray:
    return np.array([i is None or zlib.crc32(str(i).encode()) % folds == fold for i in ids], bool)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes with an end after each text, tokens of each text) of a slab."""
    lower = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint8)
    s, e, rows = flat.word_spans(lower, offsets)
    n = np.bincount(rows, minlength=len(offsets) - 1) + 1
    out = np.full(int(n.sum()), END, np.int64)
    if len(s):
        out[np.arange(len(s)) + rows] = flat.span_hashes(lower, s, e).view(np.int64)
    return out, n


def discounts(n: dict[int, int], cut: int = CUT) -> np.ndarray:
    """d[r] for r up to cut (d[0] is unused): Good-Turing as Katz has it, else absolute discounts."""
    d = np.ones(cut + 1)
    if n.get(1):
        top = (cut + 1) * n.get(cut + 1, 0) / n[1]
        if top < 1 and all(n.get(r) for r in range(1, cut + 1)):
            d[1:] = [((r + 1) * n.get(r + 1, 0) / (r * n[r]) - top) / (1 - top) for r in range(1, cut + 1)]
            if np.all((d[1:] > 0) & (d[1:] < 1)):
                return d
    absolute = n.get(1, 0) / (n.get(1, 0) + 2 * n.get(2, 0)) if n.get(1) and n.get(2) else 0.5
    d[1:] = [(r - absolute) / r for r in range(1, cut + 1)]
    return d


class Unigrams:
    """Discounted probabilities by count; what they leave is the unknown word's."""

    def __init__(self, total: int, kinds: int, low: dict[int, int]) -> None:
        self.total, self.kinds, self.d = total, kinds, discounts(low)
        left = sum(low.get(r, 0) * r * (1 - self.d[r]) for r in range(1, CUT + 1))
        if total == 0:
            self.scale, self.unknown = 1.0, 1.0
        elif left <= 0:
            self.scale, self.unknown = total + 1.0, 1 / (total + 1.0)
        else:
            self.scale, self.unknown = float(total), left / total

    def p(self, c: np.ndarray) -> np.ndarray:
        d = np.where(c <= CUT, self.d[np.minimum(c, CUT)], 1.0)
        return np.where(c > 0, d * c / self.scale, self.unknown)



def gaps(x: np.ndarray) -> np.ndarray:
    """Ascending numbers as differences."""
    return np.diff(x, prepend=x[:0].dtype.type(0)) if len(x) else x


def wide(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64)


CODED = "chunk long, tokens long, blob binary, hashes binary"


def coded(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """A row for each chunk of texts: its ids, training flags, lengths and word codes, and its ascending word hashes with training counts."""
    names = [x.split()[0] for x in CODED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for batch in batches:
            data, offsets = flat.flat(batch.column(2))
            ids, parts, sizes, lo = batch.column(0).to_pylist(), [], [], 0
            for i, j in flat.slabs(np.diff(offsets)):
                at = offsets[i : j + 1]
                h, n = tokens(data[at[0] : at[-1]], at - at[0])
                parts.append(h)
                sizes.append(n)
                if j == len(ids) or sum(map(len, parts)) >= CHUNK_TOKENS:
                    chunk, seq = batch.column(1)[0].as_py() * (1 << 32) + seq, seq + 1
                    yield out(chunk, ids[lo:j], np.concatenate(sizes), np.concatenate(parts))
                    parts, sizes, lo = [], [], j

    def out(chunk: int, ids: list, n: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
        train = ~held_out(ids)
        d = pc.dictionary_encode(pa.array(hashes.view(np.uint64)))
        words = d.dictionary.to_numpy()
        order = np.argsort(words)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        codes = rank[d.indices.to_numpy()]
        counts = np.bincount(codes[np.repeat(train, n)], minlength=len(words))
        null = np.array([x is None for x in ids], np.uint8)
        end = rank[np.flatnonzero(words == np.uint64(END))]
        blob = pack(np.array([0 if x is None else x for x in ids], np.int64), null, train.astype(np.uint8), n, codes, end, np.array([len(words)]))
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([int(n.sum())], pa.int64()), pa.array([blob], pa.binary()), pa.array([pack(words[order].view(np.int64), counts)], pa.binary())], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.spark_partition_id().alias("part"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, CODED)


class Chunk:
    """A chunk's n-grams of each order: for every token's place the n-gram that ends there.

    Of order k: at (n-gram of each token), ctx (history, an n-gram of order k - 1), word, low (the n-gram without its first
    token), first (the n-gram of ends alone, history of first words), trained (its count in the chunk), and from the answers
    number and count of each n-gram and, by history, scale, lows and used. Words are in the order of their numbers.
    """

    def __init__(self, blob: bytes) -> None:
        self.ids, self.null, train, n, codes, end, number, count = unpack(blob)
        self.n = wide(n)
        self.doc = np.repeat(np.arange(len(self.n), dtype=np.int32), self.n)
        self.train = train.astype(bool)[self.doc]
        self.starts = np.cumsum(self.n) - self.n
        self.end, self.size = int(end[0]), len(number)
        self.orders = [{"at": codes.astype(np.int32), "first": self.end, "number": np.cumsum(wide(number)), "count": wide(count)}]

    def extend(self) -> None:
        """The n-grams of the next order."""
        last = self.orders[-1]
        ctx = np.empty(len(last["at"]), np.int64)
        ctx[1:] = last["at"][:-1]
        ctx[self.starts] = last["first"]
        key = np.append(ctx * self.size + self.orders[0]["at"], last["first"] * self.size + self.end)
        del ctx
        grams, at = np.unique(key, return_inverse=True)
        del key
        at = at.astype(np.int32)
        low = np.empty(len(grams), np.int64)
        low[at[:-1]], low[at[-1]] = last["at"], last["first"]
        ctx, word = grams // self.size, grams % self.size
        begin = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]])
        self.orders.append({"at": at[:-1], "first": int(at[-1]), "ctx": ctx, "word": word, "low": low, "begin": begin, "of": np.cumsum(np.r_[0, ctx[1:] != ctx[:-1]]), "trained": np.bincount(at[:-1], self.train, minlength=len(grams)).astype(np.int64)})
        top, histories = self.orders[-1], ctx[begin]
        times = last["count"][histories].copy()
        times[histories == last["first"]] = self.orders[0]["count"][self.end]
        top["times"] = times

    def deal(self, buckets: int, hot: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(bucket, places of n-grams, places of histories, n-grams of each) of the last order, by number of the history and word."""
        top, last = self.orders[-1], self.orders[-2]
        histories, times = top["ctx"][top["begin"]], top["times"]
        known = times > 0
        number = last["number"][histories]
        send = last["count"][top["low"]] > 0
        send[top["first"]] = True
        send &= known[top["of"]]
        top["split"] = times > hot
        parts = np.maximum(np.ceil(times / hot), 1).astype(np.int64)
        # a history goes to its own bucket, or some after it by the next word
        home = number >> ROW_BITS if len(self.orders) > 2 else number
        bucket = home[top["of"]]
        some = top["split"][top["of"]]
        spread = flat.mix(self.orders[0]["number"][top["word"][some]].view(np.uint64)).view(np.int64) & np.int64((1 << 62) - 1)
        bucket[some] += spread % parts[top["of"]][some]
        bucket %= buckets
        # histories without an n-gram to send, whose weight is needed, go to their own bucket
        bare = np.setdiff1d(np.flatnonzero(known), top["of"][send])
        rank = np.empty(len(histories), np.int64)
        rank[np.argsort(number)] = np.arange(len(histories))
        grams = np.flatnonzero(send)
        rows = np.r_[grams, np.full(len(bare), -1)]
        own = np.r_[top["of"][grams], bare]
        to = np.r_[bucket[grams], home[bare] % buckets]
        key = np.sort((to * len(histories) + rank[own]) * len(rows) + np.arange(len(rows)))  # words ascend as their numbers do
        rows, own, to = (x[key % max(len(rows), 1)] for x in (rows, own, to))
        cut = np.searchsorted(to, np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cut)).tolist():
            r, o = rows[cut[b] : cut[b + 1]], own[cut[b] : cut[b + 1]]
            begin = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
            yield b, r[r >= 0], o[begin], np.add.reduceat((r >= 0).astype(np.int64), begin)

    def blocks(self, buckets: int, hot: float) -> Iterator[tuple[int, bytes]]:
        """The blocks of the last order."""
        top, last, trained = self.orders[-1], self.orders[-2], self.orders[-1]["trained"]
        lower = last["count"][top["low"]]
        wanting = np.bincount(top["of"][lower == 0], minlength=len(top["begin"])) > 0
        histories = top["ctx"][top["begin"]]
        number, words = last["number"][histories], self.orders[0]["number"]
        scale = last["scale"][last["low"][histories]] if "scale" in last else np.zeros(len(histories), np.int64)
        for b, grams, own, n in self.deal(buckets, hot):
            yield b, pack(gaps(number[own]), n, scale[own], wanting[own].astype(np.uint8), top["split"][own].astype(np.uint8), words[top["word"][grams]], trained[grams], lower[grams])

    def answered(self, blobs: list[bytes], buckets: int, hot: float, sums: dict[int, tuple]) -> None:
        """Takes the answers to blocks(), one for each bucket that had one."""
        top, last = self.orders[-1], self.orders[-2]
        size = len(top["low"])
        top |= {"number": np.full(size, -1), "count": np.zeros(size, np.int64)}
        k = len(last["number"])
        top |= {"scale": np.zeros(k, np.int64), "lows": np.zeros((k, CUT)), "used": np.zeros(k)}
        histories = top["ctx"][top["begin"]]
        for blob, (_, grams, own, _) in zip(blobs, self.deal(buckets, hot), strict=True):
            row, count, scale, weighted, lows, used = unpack(blob)
            top["count"][grams] = count
            if len(row):  # the last order's n-grams are no histories
                top["number"][grams] = np.cumsum(wide(row))
            at = histories[own]
            top["scale"][at] = scale
            some = at[weighted.astype(bool)]
            top["lows"][some], top["used"][some] = lows.reshape(-1, CUT), used
        if sums:
            for h in np.flatnonzero(top["split"]).tolist():
                total, lows, used = sums[int(last["number"][histories[h]])]
                top["scale"][histories[h]], top["lows"][histories[h]], top["used"][histories[h]] = scales(total, lows.sum()), lows, used

    def scores(self, uni: Unigrams, ds: list[np.ndarray]) -> np.ndarray:
        """log10 of each text's probability, from the unigrams up."""
        logs = np.log10(uni.p(self.orders[0]["count"]))
        for top, d in zip(self.orders[1:], ds):
            logs = logs[top["low"]]
            scale, seen = top["scale"][top["ctx"]], top["count"] > 0
            logs[seen] = np.log10(discounted(top["count"][seen], d) / scale[seen])
            off = np.flatnonzero(~seen & (scale > 0))
            by = top["ctx"][off]
            logs[off] += np.log10(weights(scale[off], top["lows"][by], top["used"][by], d))
        return np.bincount(self.doc, logs[self.orders[-1]["at"]], minlength=len(self.n))


def scales(total, low):
    """What counts of a history are divided by: their sum, and one more where none of them is discounted."""
    return total + ((low == 0) & (total > 0))


def discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(count <= CUT, d[np.minimum(count, CUT)], 1.0) * count


def weights(scale: np.ndarray, lows: np.ndarray, used: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Backoff weights of histories that training has."""
    left = lows @ (np.arange(1, CUT + 1) * (1 - d[1:]))
    return np.where(left > 0, left, 1.0) / scale / (1 - used)


ROW = "chunk long, place long, blob binary"
#: Chunk numbers of what isn't a chunk's: counts of counts, sums of split histories, parts of the table.
COUNTS, SPLIT, TABLE = -1, -2, -3


def unigram_blocks(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, chunk, blob): buckets are ranges of word hashes, which ascend."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, counts = unpack(blob)
                to = bucket_of(words.view(np.uint64), buckets)
                cut = np.searchsorted(to, np.arange(buckets + 1))
                rows = [(b, chunk, pack(words[cut[b] : cut[b + 1]], counts[cut[b] : cut[b + 1]])) for b in np.flatnonzero(np.diff(cut)).tolist()]
                yield blob_rows(rows, "bucket, chunk, blob")

    return texts.select("chunk", "hashes").mapInArrow(run, "bucket long, chunk long, blob binary")


def unigram_table(dealt: DataFrame, buckets: int) -> DataFrame:
    """From blocks, a bucket per partition: the answers, counts of counts and the bucket's part of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [x for b in batches for x in zip(*(c.to_pylist() for c in b.columns))]
        if not found:
            return
        bucket, blocks = found[0][0], [unpack(x[2]) for x in found]
        words, at = np.unique(np.concatenate([x[0].view(np.uint64) for x in blocks]), return_inverse=True)
        count = np.bincount(at, np.concatenate([x[1] for x in blocks])).astype(np.int64)
        # frequent words have small numbers, whatever their bucket
        number = np.empty(len(words), np.int64)
        number[np.argsort(-count, kind="stable")] = np.arange(len(words)) * buckets + bucket
        begin = 0
        for (_, chunk, _), block in zip(found, blocks):
            own = at[begin : begin + len(block[0])]
            begin += len(own)
            yield blob_rows([(chunk, (1 << ROW_BITS) + bucket, pack(number[own], count[own]))])
        yield blob_rows([(COUNTS, bucket, counts_of(count)), (TABLE, bucket, pack(words.view(np.int64), number, count))])

    return dealt.mapInArrow(run, ROW)


def counts_of(count: np.ndarray) -> bytes:
    return pack(np.array([np.count_nonzero(count == r) for r in range(1, CUT + 2)] + [np.count_nonzero(count), count.sum()], np.int64))


def gram_table(dealt: DataFrame, order: int, lower, last: bool, keep: bool) -> DataFrame:
    """From blocks, a bucket per partition: the answers, counts of counts, sums of split histories and the bucket's part of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [x for b in batches for x in zip(*(c.to_pylist() for c in b.columns))]
        if not found:
            return
        bucket, blocks = found[0][0], [[wide(x) for x in unpack(f[2])] for f in found]
        of = [np.cumsum(x[0]) for x in blocks]
        numbers, history = np.unique(np.concatenate(of), return_inverse=True)
        take = lambda i: np.concatenate([x[i] for x in blocks])
        scale, split = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), bool)
        scale[history], split[history] = take(2), take(4) > 0
        words, word = np.unique(take(5), return_inverse=True)
        grams, at = np.unique(np.repeat(history, take(1)) * len(words) + word, return_inverse=True)
        count = np.bincount(at, take(6), minlength=len(grams)).astype(np.int64)
        short = np.zeros(len(grams), np.int64)
        short[at] = take(7)
        own = grams // max(len(words), 1)
        seen, n = count > 0, len(numbers)
        total = np.bincount(own, count, minlength=n).astype(np.int64)
        lows = np.stack([np.bincount(own[count == r], minlength=n) for r in range(1, CUT + 1)], 1)
        used = np.bincount(own[seen], lower(short[seen], scale[own[seen]]), minlength=n)
        divide = scales(total, lows.sum(1))
        yield blob_rows([(COUNTS, bucket, counts_of(count))])
        if keep:
            yield blob_rows([(TABLE, bucket, pack(gaps(numbers), scale, np.bincount(own, minlength=n), words[grams % max(len(words), 1)], count, short))])
        if split.any():
            yield blob_rows([(SPLIT, bucket, pack(numbers[split], total[split], lows[split].ravel(), used[split]))])
        begin = first = 0
        for (_, chunk, _), block in zip(found, blocks):
            mine, rows = history[first : first + len(block[0])], at[begin : begin + len(block[5])]
            first, begin = first + len(mine), begin + len(rows)
            off = block[3] > 0
            off |= np.bincount(np.repeat(np.arange(len(mine)), block[1])[count[rows] == 0], minlength=len(mine)) > 0
            back = mine[off]
            yield blob_rows([(chunk, (order << ROW_BITS) + bucket, pack(gaps((bucket << ROW_BITS) + rows) if not last else rows[:0], count[rows], divide[mine], off.astype(np.uint8), lows[back].ravel(), used[back]))])

    return dealt.mapInArrow(run, ROW)


class Model:
    """What the orders so far have given: discounts, sums of split histories, and stored answers and tables."""

    def __init__(self, buckets: int, hot: float) -> None:
        self.texts, self.buckets, self.hot = None, buckets, hot
        self.uni, self.ds, self.sums, self.found = None, [], [], []

    def take(self, found: DataFrame) -> dict[int, int]:
        """Counts of counts (and, at 0, the n-grams and their tokens) of an order's stored rows."""
        self.found.append(found)
        counts = np.zeros(CUT + 3, np.int64)
        for r in found.where(F.col("chunk") == COUNTS).select("blob").toLocalIterator():  # eight numbers for each bucket
            counts += wide(unpack(r["blob"])[0])
        sums: dict[int, tuple] = {}
        for r in found.where(F.col("chunk") == SPLIT).select("blob").toLocalIterator():  # four histories for each bucket at most
            number, total, lows, used = unpack(r["blob"])
            for i, t, l, u in zip(number.tolist(), total.tolist(), wide(lows).reshape(-1, CUT), used.tolist()):
                was = sums.get(i, (0, np.zeros(CUT, np.int64), 0.0))
                sums[i] = (was[0] + t, was[1] + l, was[2] + u)
        self.sums.append(sums)
        return {r + 1: int(x) for r, x in enumerate(counts[: CUT + 1])} | {0: (int(counts[-2]), int(counts[-1]))}

    def chunks(self, run, schema: str) -> DataFrame:
        """run(chunk, Chunk with all answers so far) in a task for each chunk."""
        buckets, hot, sums = self.buckets, self.hot, self.sums

        def each(chunk: int, blob: bytes, found: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            answers: dict[int, list] = {}
            for place, b in found:
                answers.setdefault(place >> ROW_BITS, []).append(b)
            c = Chunk(blob)
            for order in range(2, len(sums) + 1):
                c.extend()
                c.answered(answers.get(order, []), buckets, hot, sums[order - 1])
            yield from run(chunk, c)

        rows = self.found[0].limit(0) if len(self.found) == 1 else reduce(DataFrame.unionByName, self.found[1:])
        return per_chunk(self.texts, rows.where("chunk >= 0"), each, schema)

    def grow(self, last: bool, keep: bool) -> None:
        """The next order."""
        buckets, hot = self.buckets, self.hot

        def blocks(chunk: int, c: Chunk) -> Iterator[pa.RecordBatch]:
            c.extend()
            rows = [(b, chunk, blob) for b, blob in c.blocks(buckets, hot)]
            for lo in range(0, len(rows), 64):
                yield blob_rows(rows[lo : lo + 64], "bucket, chunk, blob")

        uni, d, order = self.uni, self.ds[-1] if self.ds else None, len(self.sums) + 1
        lower = (lambda count, scale: uni.p(count)) if d is None else (lambda count, scale: discounted(count, d) / scale)
        dealt = self.chunks(blocks, "bucket long, chunk long, blob binary").repartitionById(buckets, F.col("bucket").cast("int"))
        self.ds.append(discounts(self.take(stored(gram_table(dealt, order, lower, last, keep), "grams"))))


def numbered(chunk: int, blob: bytes, found: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """A coded chunk with its words in the order of their numbers, and with the answers to its words."""
    ids, null, train, n, codes, end, _ = unpack(blob)
    answers = [unpack(b) for _, b in found]
    number, count = (np.concatenate([wide(x[i]) for x in answers]) for i in (0, 1))
    order = np.argsort(number)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    yield blob_rows([(chunk, 0, pack(ids, null, train, n, rank[codes], rank[end], gaps(number[order]), count[order]))])


def trained(docs: DataFrame, text: str = "text", id_col: str = "doc_id", order: int = ORDER, target: int = TARGET, keep: bool = True) -> Model:
    """The model of the training texts among docs, with what their chunks need to be scored."""
    spark = docs.sparkSession
    raw, first = fresh_path(spark, "texts"), fresh_path(spark, "grams")
    texts = stored_at(coded(docs, text, id_col), raw)
    buckets = max(partitions(spark), -(-texts.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0] // target))
    model = Model(buckets, target / 4)
    dealt = unigram_blocks(texts, buckets).repartitionById(buckets, F.col("bucket").cast("int"))
    found = stored_at(unigram_table(dealt, buckets), first)
    low = model.take(found)
    kinds, total = low.pop(0)
    model.uni = Unigrams(total, kinds, low)
    model.texts = bucketed(per_chunk(texts, found.where("chunk >= 0"), numbered, ROW).drop("place"), "texts", "chunk")
    if keep:
        model.found[0] = stored(found.where(F.col("chunk") == TABLE), "grams")
    release(spark, raw, first)
    for k in range(2, order + 1):
        model.grow(k == order, keep)
    return model


def scored(docs: DataFrame, text: str = "text", id_col: str = "doc_id", order: int = ORDER, target: int = TARGET, keep: bool = False) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    model = trained(docs, text, id_col, order, target, keep)
    uni, ds = model.uni, model.ds
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def out(chunk: int, c: Chunk) -> Iterator[pa.RecordBatch]:
        count, word, n = c.orders[0]["count"], c.orders[0]["at"], len(c.n)
        base = np.bincount(c.doc, np.log10((count + 1.0) / (uni.total + uni.kinds + 1.0))[word], minlength=n)
        known = np.bincount(c.doc, (count > 0)[word], minlength=n).astype(np.int64)
        held = ~c.train[c.starts]
        arrays = [pa.array(wide(c.ids), pa.int64(), mask=c.null.astype(bool)), pa.array(held), pa.array(c.n), pa.array(known), pa.array(np.full(n, uni.total, np.int64)), pa.array(base), pa.array(c.scores(uni, ds))]
        yield pa.RecordBatch.from_arrays(arrays, names)

    return model.chunks(out, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


GRAMS = "history long, word long, count long, probability double"
WEIGHTS = "history long, backoff double"


def tables(model: Model, order: int) -> tuple[DataFrame, DataFrame | None]:
    """The n-grams of an order, as (history, word, count, probability), and (history, backoff) of its histories.

    Numbers of order 1, which also name the words of all orders, are in the first table's column word, whose history is the hash of the word.
    A history's number is that of an n-gram of the order below: its bucket (the place) in the upper bits and its row in order of
    history and word below them. The model must be one that keeps its tables.
    """
    uni, sums, ds = model.uni, model.sums, model.ds
    split = np.array(sorted(sums[order - 1]), np.int64)
    stored_parts = model.found[order - 1].where(F.col("chunk") == TABLE).select("blob")
    gram_names, weight_names = ([x.split()[0] for x in t.split(", ")] for t in (GRAMS, WEIGHTS))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                word, number, count = unpack(blob)
                have = count > 0
                yield pa.RecordBatch.from_arrays([pa.array(wide(word)[have]), pa.array(wide(number)[have]), pa.array(wide(count)[have]), pa.array(uni.p(wide(count)[have]))], gram_names)

    if order == 1:
        return stored_parts.mapInArrow(words, GRAMS), None
    d, below = ds[order - 2], ds[order - 3] if order > 2 else None

    def parts(blob: bytes) -> tuple:
        numbers, under, n, words, count, short = (wide(x) for x in unpack(blob))
        numbers, own, seen = np.cumsum(numbers), np.repeat(np.arange(len(n)), n), count > 0
        lows = np.stack([np.bincount(own[count == r], minlength=len(n)) for r in range(1, CUT + 1)], 1)
        total = np.bincount(own, count, minlength=len(n)).astype(np.int64)
        p = uni.p(short[seen]) if below is None else discounted(short[seen], below) / under[own[seen]]
        used = np.bincount(own[seen], p, minlength=len(n))
        for i in np.flatnonzero(np.isin(numbers, split)).tolist():
            total[i], lows[i], used[i] = sums[order - 1][int(numbers[i])]
        return numbers, scales(total, lows.sum(1)), lows, used, own[seen], words[seen], count[seen]

    def grams(numbers, scale, lows, used, own, words, count) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(numbers[own]), pa.array(words), pa.array(count), pa.array(discounted(count, d) / scale[own])], gram_names)

    def backoffs(numbers, scale, lows, used, *_) -> pa.RecordBatch:
        have = scale > 0
        return pa.RecordBatch.from_arrays([pa.array(numbers[have]), pa.array(weights(scale[have], lows[have], used[have], d))], weight_names)

    def of_buckets(rows_of):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob in batch.column(0).to_pylist():
                    yield rows_of(*parts(blob))

        return run

    backoff = stored_parts.mapInArrow(of_buckets(backoffs), WEIGHTS).dropDuplicates(["history"])  # a split history is in several parts
    return stored_parts.mapInArrow(of_buckets(grams), GRAMS), backoff
