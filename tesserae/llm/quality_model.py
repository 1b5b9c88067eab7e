"""Quality classifier: Bradley-Terry scores from preference pairs, thresholded by score quantile.

Each text becomes a vector of shares of its own bytes and words (case, digits, symbols, bars, repeats, lengths).
All labelled texts are put into pairs (good, bad), each at least once; weights minimise the logistic loss of the
pairs' feature differences, which is the Bradley-Terry likelihood of "good beats bad". The raw scores of all labelled texts
are cut at the quantile that is their share of bad texts, and the logistic curve is shifted so that this
cut has score THRESHOLD: predicted is 1 from there on.

Features come from one pass over the texts and are stored; labels meet them by doc_id, so texts aren't shuffled.
Rows are dealt to groups by a hash of themselves and paired within, so pairs don't depend on partitions; the rarer label's rows
go to several groups, so that none lacks a partner. Equal rows of an id count as one with a weight. Each step of the fit is a sum over the stored pairs.

Defined cases: null counts as an empty text, whose features are all 0; it gets a score like any other. Without bad
labels every score is 1, without good ones 0. Null ids are scored and never trained on; a repeated label row
counts again; repeated rows are scored row by row; empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm import flat
from tesserae.llm.common import stored, unused

#: PAIRS: pairs at least, for small tables; GROUP: rows of a group, about.
PAIRS, GROUP, THRESHOLD, SEED = 60_000, 1024, 0.7, 9
#: Byte classes: lower, upper, digit, white, line end, symbols, bars, stops, other ASCII, beyond ASCII.
_CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b"#*$%&", b"|<>", b".,;:!?")
FEATURES = ("f_lower", "f_upper", "f_digit", "f_white", "f_line", "f_symbol", "f_bar", "f_stop", "f_other", "f_wide", "f_words", "f_word_length", "f_same_next", "f_distinct", "f_same_pair", "f_bang", "f_upper_bytes_root", "f_symbol_root", "f_bar_root")


def _table() -> np.ndarray:
    t = np.full(256, 8, np.int64)
    t[128:] = 9
    for i, chars in enumerate(_CLASSES):
        t[list(chars)] = i
    return t


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text of a slab."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    counts = np.bincount(row * 10 + _table()[data], minlength=10 * n).reshape(n, 10).astype(float)
    bangs = np.bincount(row[data == 33], minlength=n)
    s, e, at = flat.word_spans(data, offsets)
    words = np.bincount(at, minlength=n).astype(float)
    h = flat.span_hashes(data, s, e) if len(s) else np.zeros(0, np.uint64)
    same = np.zeros(n)
    pairs = np.zeros(n)
    distinct = np.zeros(n)
    if len(h):
        same += np.bincount(at[1:][(h[1:] == h[:-1]) & (at[1:] == at[:-1])], minlength=n)
        order = np.lexsort((h, at))
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (at[order][1:] != at[order][:-1])]
        distinct += np.bincount(at[order][new], minlength=n)
        two, where = flat.shingles(h, at, 2)
        order = np.lexsort((two, where))
        again = (two[order][1:] == two[order][:-1]) & (where[order][1:] == where[order][:-1])
        pairs += np.bincount(where[order][1:][again], minlength=n)
    some, several = np.maximum(size, 1), np.maximum(words, 1)
    share = counts / some[:, None]
    more = [np.log1p(words) / 10, np.log1p(np.bincount(at, e - s, minlength=n) / several), same / several, distinct / several * (words > 0), pairs / several, bangs / several]
    return np.column_stack([share, *more, np.sqrt(share[:, 1]), np.sqrt(share[:, 5]), np.sqrt(share[:, 6])])


def featured(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and the FEATURES of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat.flat(batch.column(1))
            parts = [features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in flat.slabs(np.diff(offsets))]
            x = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in x.T]], ["doc_id", *FEATURES])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


def bradley_terry(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, seed: int = SEED, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights by Newton steps on the logistic loss of feature differences of drawn pairs."""
    rng = np.random.default_rng(seed)
    d = good[rng.integers(0, len(good), pairs)] - bad[rng.integers(0, len(bad), pairs)]
    return _newton(lambda w: _sums(d, np.ones(pairs), w), d.shape[1], ridge, rounds)


def _sums(d: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The pairs' weight, gradient and Hessian of the loss at w, one after the other."""
    p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
    return np.r_[weight.sum(), -d.T @ (p * weight), ((d * (p * (1 - p) * weight)[:, None]).T @ d).ravel()]


def _newton(sums: Callable[[np.ndarray], np.ndarray], n: int, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    w = np.zeros(n)
    for _ in range(rounds):
        total = sums(w)
        gradient = ridge * w + total[1 : n + 1] / total[0]
        hessian = total[n + 1 :].reshape(n, n) / total[0] + ridge * np.eye(n)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def paired(rows: DataFrame, n0: int, n1: int) -> DataFrame:
    """(FEATURES, weight): differences of pairs of (label, FEATURES, weight, h); n0 and n1 are the rows of either label, at least one each.

    A group takes as many pairs as its more frequent label has rows, in turns, or several such turns where the table is small.
    """
    groups = max(1, (n0 + n1) // GROUP)
    turns = -(-PAIRS // max(n0, n1))
    copies = [min(groups, -(-GROUP * groups // (4 * n))) for n in (n0, n1)]
    times = F.when(F.col("label") == 0, copies[0]).otherwise(copies[1])
    dealt = rows.select("*", F.explode(F.sequence(F.lit(0), times - 1)).alias("copy")).withColumn("grp", F.pmod(F.pmod("h", F.lit(groups)) + F.col("copy"), F.lit(groups)))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["h", *FEATURES], kind="stable")
        (bad, wb), (good, wg) = ((x[list(FEATURES)].to_numpy(), x["weight"].to_numpy()) for x in (g[g["label"] == v] for v in (0, 1)))
        if not len(bad) or not len(good):
            raise RuntimeError("a group has one label only")
        k = np.arange(max(len(bad), len(good)) * turns)
        i, j = k % len(good), (k + k // max(len(bad), len(good))) % len(bad)
        return pd.DataFrame(good[i] - bad[j], columns=list(FEATURES)).assign(weight=(wg[i] * wb[j]).astype(float))

    return dealt.groupBy("grp").applyInPandas(run, ", ".join(f"{f} double" for f in (*FEATURES, "weight")))


def _fitted(pairs: DataFrame, scale: np.ndarray) -> np.ndarray:
    """Weights of the standardised features by Newton steps; a step sums over the pairs where they lie, and only sums come to the driver."""

    def sums(w: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + len(w) + len(w) ** 2)
            for b in batches:
                x = np.column_stack([c.to_numpy() for c in b.columns])
                total += _sums(x[:, :-1] / scale, x[:, -1], w)
            yield pa.RecordBatch.from_arrays([pa.array([total])], ["total"])

        return np.sum([r["total"] for r in pairs.mapInArrow(run, "total array<double>").collect()], axis=0)

    # the order of sums doesn't show
    return np.round(_newton(sums, len(scale)), 9)


def at_rank(rows: DataFrame, value: str, weight: str, rank: int, near: int = 10_000) -> float:
    """The value at a rank, from 0 on, of rows that count weight times: by counts in ever narrower bins, of any number of rows."""
    low, high, n = rows.agg(F.min(value), F.max(value), F.count("*")).first()
    v, before = F.col(value), 0
    while low < high and n > near:
        place = F.least(F.floor((v - low) / ((high - low) / 256)), F.lit(255))
        for b in rows.where(v.between(low, high)).groupBy(place.alias("bin")).agg(F.sum(weight).alias("w"), F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).orderBy("bin").collect():
            if before + b["w"] > rank:
                low, high, n = b["low"], b["high"], b["n"]
                break
            before += b["w"]
    if low == high:
        return low
    for r in rows.where(v.between(low, high)).orderBy(v).collect():
        before += r[weight]
        if before > rank:
            return r[value]
    raise ValueError("no such rank")


def fit(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality") -> dict:
    """The model from stored features and all labels: weights and bias of a logistic score, or a constant one."""
    y = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    own = ["doc_id", "label", *FEATURES]
    known = rows.join(y, "doc_id").groupBy(*own).agg(F.count("*").alias("weight"))
    known = stored(known.select("label", *FEATURES, "weight", F.xxhash64(*own).alias("h")), "labelled")
    found = {r["label"]: r for r in known.groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    if len(found) < 2:
        return {"constant": 0.0 if 0 in found else 1.0}
    scale = np.array(known.agg(*[F.stddev_pop(f) for f in FEATURES]).first(), float)
    scale[scale < 1e-9] = 1.0
    w = _fitted(stored(paired(known, found[0]["n"], found[1]["n"]), "pairs"), scale) / scale
    raw = known.select(_linear(w.tolist(), [F.col(f) for f in FEATURES]).alias("raw"), "weight")
    bad, all_ = found[0]["w"], found[0]["w"] + found[1]["w"]
    cut = (at_rank(raw, "raw", "weight", bad - 1) + at_rank(raw, "raw", "weight", min(bad, all_ - 1))) / 2
    return {"weights": w.tolist(), "bias": math.log(THRESHOLD / (1 - THRESHOLD)) - cut}


def _linear(weights: list[float], values: list[Column], start: float = 0.0) -> Column:
    out = F.lit(start)
    for x, w in zip(values, weights):
        out = out + x * w
    return out


def score(model: dict, values: list[Column] | None = None) -> Column:
    """The score from the columns of FEATURES, or from these values of them."""
    if "constant" in model:
        return F.lit(model["constant"])
    raw = _linear(model["weights"], values or [F.col(f) for f in FEATURES], model["bias"])
    return 1 / (1 + F.exp(-F.greatest(F.least(raw, F.lit(500.0)), F.lit(-500.0))))


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id as text leaves the remainder fold; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % folds == fold, F.lit(True))


def classified(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", train: Column | None = None) -> DataFrame:
    """(doc_id, score, predicted) of every row; train says which rows of labels the model may learn from."""
    rows = stored(featured(docs, text, id_col), "features")
    model = fit(rows, labels if train is None else labels.where(train), id_col, label)
    return rows.select("doc_id", score(model).alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def _array():
    """The Arrow function from texts to arrays of FEATURES."""

    def run(texts: pa.Array) -> pa.Array:
        data, offsets = flat.flat(texts)
        parts = [features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in flat.slabs(np.diff(offsets))]
        x = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))

    return F.arrow_udf(run, "array<double>")


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", train: Column | None = None) -> DataFrame:
    """The documents that are predicted good, each row by its own text; a row without an id can't be judged and stays.

    Texts are judged where they lie: features are made once for the model, once more for the verdict, and no text is shuffled.
    """
    rows = stored(featured(docs, text, id_col), "features")
    model = fit(rows, labels if train is None else labels.where(train), id_col, label)
    x = unused(docs, "_features")
    found = docs.withColumn(x, _array()(F.col(text).cast("string")))
    good = score(model, [F.get(x, F.lit(i)) for i in range(len(FEATURES))]) >= THRESHOLD
    return found.where(good | F.col(id_col).isNull()).select(docs.columns)
