"""Whitening against a full eigendecomposition, with exact sums, and on odd rows."""

import math

import numpy as np
import pytest

from tesserae.llm import queries, whitening

DATA = "/root/testdata/sf0.001"


def whole(vectors):
    """(x, sums, covariance) by plain Python integers and numpy."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], object)
    s, n = x.sum(0), len(x)
    c = np.array((n * x - s).tolist(), float) / n
    return x, s, c.T @ c / n, c


def check(spark, vectors, k, **options):
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    model = whitening.fit(rows, components=k, **options)
    x, s, v, c = whole(vectors)
    values = np.linalg.eigvalsh(v)[::-1][: len(model.values)]
    assert model.n == len(x) and list(model.sums) == s.tolist()
    assert np.allclose(model.values, values, rtol=1e-10) and model.trace == pytest.approx(np.trace(v), rel=1e-12)
    assert np.allclose(v @ model.vectors, model.vectors * model.values, atol=1e-12 * values[0]) and np.allclose(model.vectors.T @ model.vectors, np.eye(len(values)), atol=1e-12)
    got = {r["vec_id"]: r for r in whitening.transform(rows, model).collect()}
    for i in range(len(x)):
        assert int(got[i]["deviation"]) == sum(int(len(x) * a - b) ** 2 for a, b in zip(x[i], s))
        assert np.allclose(got[i]["whitened"], c[i] @ model.vectors / np.sqrt(model.values), atol=1e-9)
    assert whitening.identity_error(rows, model) < 1e-8
    return model


def test_falling_spectrum_needs_no_full_basis(spark):
    r = np.random.default_rng(1)
    turn = np.linalg.qr(r.standard_normal((40, 40)))[0]
    fast = check(spark, r.standard_normal((500, 40)) * (1000.0 * 0.2 ** np.arange(40) + 0.05) @ turn, 3)
    assert fast.passes <= whitening.PASSES and len(fast.values) == 3


def test_flat_spectrum_goes_to_the_full_dimension(spark):
    r = np.random.default_rng(2)
    model = check(spark, r.standard_normal((300, 40)), 8)
    assert model.passes == whitening.PASSES + 1 and len(model.values) == 8
    assert len(check(spark, r.standard_normal((300, 5)), 32).values) == 5


def test_equal_values_and_low_rank(spark):
    r = np.random.default_rng(3)
    line = np.outer(np.arange(50), np.ones(12))
    assert len(check(spark, line, 8).values) == 1
    pair = np.c_[np.repeat([1.0, -1.0], 50), np.tile([1.0, -1.0], 50)]
    assert len(check(spark, pair, 2).values) == 2
    big = r.standard_normal((60, 4)) * [1e13, 1e13, 2e13, 3e13]
    check(spark, big, 4)  # deviations of more than 64 bits


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, -4.0]), (2, None), (3, [1.0, None]), (4, [nan, 0.0]), (5, [inf, 1.0]), (6, [-inf, 1.0]), (7, []), (8, [5.0]), (9, [0.1, 0.7])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, n string, vector int")
    model = whitening.fit(df)
    assert model.n == 4
    out = whitening.transform(df, model).collect()
    assert sorted(str(r["vec_id"]) for r in out) == ["1", "1", "9", "None"] and {len(r["whitened"]) for r in out} == {2}
    none = df.limit(0)
    assert whitening.fit(none) is None and whitening.transform(none, None).collect() == [] and whitening.identity_error(none, None) is None
    same = df.where("vec_id = 1")
    model = whitening.fit(same)
    assert len(model.values) == 0 and [r["whitened"] for r in whitening.transform(same, model).collect()] == [[], []]


def test_query(spark):
    rows = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect())
    x, s, v, c = whole([e for _, e in rows])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = c @ vectors[:, :32] / np.sqrt(values[:32])
    got = {}
    for r in queries.op13_whitening(spark, DATA).collect():
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(got) == len(rows) and all(sorted(g) == list(range(1, 33)) for g in got.values())
    signs = np.sign([sum(got[i][k + 1]["whitened"] * want[j, k] for j, (i, _) in enumerate(rows)) for k in range(32)])
    for j, (i, _) in enumerate(rows):
        assert np.allclose([got[i][k + 1]["whitened"] for k in range(32)], want[j] * signs, atol=1e-8)
        one = got[i][1]
        assert one["n"] == len(rows) and one["deviation"] == sum(int(len(x) * a - b) ** 2 for a, b in zip(x[j], s)) and one["identity_error"] < 1e-4
        assert one["explained"] == pytest.approx(values[0] / np.trace(v), rel=1e-9)
