"""Whitening of embeddings by a randomised range finder and Rayleigh-Ritz, over all centred rows.

Entries become integers, so that counts and sums are exact and rows are centred before anything is multiplied. A random basis of some more
columns than components is multiplied by the covariance, one pass over all rows each time: tasks give the products' cells,
Spark sums them, and the driver, which holds nothing larger than dimension times dimension, makes the basis orthonormal again. After each
pass Rayleigh-Ritz gives components, and their residuals tell whether they are eigenvectors to double precision. If they
aren't after the last pass, the basis is expanded to the full dimension, where Rayleigh-Ritz is exact. A last pass measures what is whitened.

Defined cases: rows whose vector is null or has null or non-finite entries are left out, as are vectors shorter than the
longest of the others, which lack entries. Entries beyond 2**55 count as that, with their sign. Repeated rows count as often as
they occur, and a row without an id comes back without one. Components whose eigenvalue is at most 1e-11 of the largest have nothing to divide
by and aren't returned; where all vectors are equal there are none, and whitened is an empty array. An empty table gives an empty result; extra
columns are ignored. Components of equal eigenvalues are any basis of their space, the same for all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components, columns beyond them, passes before the basis is expanded, and the residual allowed, relative to the largest eigenvalue.
COMPONENTS, OVERSAMPLING, PASSES, RESIDUAL = 32, 10, 4, 1e-14
#: Fixed values of the contract: how an entry becomes an integer.
SCALE, SHIFT = 64, 1_000_000
LEAST, MOST = 1e-11, 1 << 61


@dataclass(frozen=True)
class Whitening:
    """n rows with these sums for each dimension; unit components as columns, by falling eigenvalue; the covariance's trace; passes over the rows."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if len(self.values) else self.values


def usable(rows: DataFrame, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(vec_id, vector) of rows with finite entries alone, as doubles."""
    v = F.col(vector).cast("array<double>")
    return rows.select(F.col(id_col).alias("vec_id"), v.alias("vector")).where(F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))


def integers(vectors: pa.Array, d: int) -> np.ndarray:
    """A row of integers for each vector of d entries."""
    c = vectors.flatten().to_numpy().reshape(len(vectors), d)
    return np.clip(np.floor(SCALE * c), -float(MOST), float(MOST)).astype(np.int64) + SHIFT


def _center(n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Whole parts and remainders of the means."""
    return np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)


def sums_of(rows: DataFrame, d: int) -> tuple[int, tuple[int, ...]]:
    """How many rows there are, and the exact sum of their integers for each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = integers(batch.column(0), d)
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], ["dim", "n", "high", "low"])

    parts = rows.select("vector").mapInArrow(run, "dim long, n long, high long, low long")
    total = lambda c: F.sum(F.col(c).cast("decimal(28,0)")).alias(c)
    found = sorted(parts.groupBy("dim").agg(F.sum("n").alias("n"), total("high"), total("low")).collect())  # a row for each dimension
    return found[0]["n"], tuple((int(r["high"]) << 32) + int(r["low"]) for r in found)


def summed(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], size: int, d: int) -> np.ndarray:
    """The sum over all rows of a function that gives an array of so many cells for the integers of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += of(integers(batch.column(0), d)) if batch.num_rows else 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["cell", "value"])

    cells = rows.select("vector").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    out = np.zeros(size)
    for cell, value in cells.collect():  # at most dimension times dimension, whatever the number of rows
        out[cell] = value
    return out


def _dimension(rows: DataFrame) -> int:
    return rows.agg(F.max(F.size("vector"))).first()[0] or 0


def fit(rows: DataFrame, vector: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS, oversampling: int = OVERSAMPLING, passes: int = PASSES, seed: int = 1) -> Whitening | None:
    """Mean and components of all usable rows; None if there are none."""
    rows = usable(rows, vector, id_col)
    d = _dimension(rows)
    if not d:
        return None
    rows = rows.where(F.size("vector") == d)
    n, sums = sums_of(rows, d)
    whole, rest = _center(n, sums)
    k, width = min(components, d), min(d, components + oversampling)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0] if width < d else np.eye(d)
    for done in range(1, passes + 3):

        def products(x: np.ndarray, basis: np.ndarray = basis) -> np.ndarray:
            c = (x - whole) - rest / n
            return np.r_[(c.T @ (c @ basis)).ravel(), np.square(c).sum()]

        *image, trace = summed(rows, products, d * basis.shape[1] + 1, d) / n
        image = np.array(image).reshape(d, -1)
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
        residual = np.linalg.norm(image @ turn - basis @ turn * values, axis=0)
        if basis.shape[1] == d or (residual <= RESIDUAL * values[0]).all():
            break
        basis = np.linalg.qr(image)[0] if done < passes else np.eye(d)
    kept = values > LEAST * max(values[0], 0)
    vectors = (basis @ turn)[:, kept]
    largest = np.abs(vectors).argmax(0)
    vectors = vectors * np.where(vectors[largest, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return Whitening(n, sums, vectors, values[kept], float(trace), done)


def _projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    whole, rest = _center(model.n, model.sums)
    return ((x - whole) - rest / model.n) @ (model.vectors / np.sqrt(model.values))


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """The exact sum over dimensions of (n*x - sum)**2 of each row."""
    whole, rest = _center(n, sums)
    c = x - whole
    most = (int(np.abs(c).max(initial=0)) + 1) * n  # rests are below n
    if most * most * len(sums) < 1 << 63:
        return np.square(n * c - rest).sum(1).tolist()
    return np.square(n * c.astype(object) - rest.astype(object)).sum(1).tolist()


def transform(rows: DataFrame, model: Whitening | None, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(vec_id, deviation, whitened) of usable rows of the model's dimension; deviation is null where 38 digits don't hold it."""
    schema = f"vec_id {dict(rows.dtypes)[id_col]}, deviation decimal(38,0), whitened array<double>"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    d = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(batch.column(1), d)
            far = [Decimal(v) if v < 10**38 else None for v in deviations(x, model.n, model.sums)]
            white = _projected(x, model)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * white.shape[1], pa.int32()), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(far, pa.decimal128(38, 0)), lists], ["vec_id", "deviation", "whitened"])

    return usable(rows, vector, id_col).where(F.size("vector") == d).mapInArrow(run, schema)


def identity_error(rows: DataFrame, model: Whitening | None, vector: str = "embedding", id_col: str = "vec_id") -> float | None:
    """The largest absolute entry of the whitened rows' covariance minus the identity; rows are those that the model was fitted to.

    The projections are centred already: their mean is the projection of zero.
    """
    if model is None or not len(model.values):
        return None
    d, k = len(model.sums), len(model.values)

    def products(x: np.ndarray) -> np.ndarray:
        w = _projected(x, model)
        return (w.T @ w).ravel()

    own = usable(rows, vector, id_col).where(F.size("vector") == d)
    return float(np.abs(summed(own, products, k * k, d).reshape(k, k) / model.n - np.eye(k)).max())
