"""Whitening against a dense solver and exact whole-number arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendcloud.llm.queries import op12_whitening
from trendcloud.llm.whitening import eigenvalues_above, ldlt, leading_spectrum, solve_shifted, whitened

VECTORS = "vec_id long, embedding array<float>, label int"


def symmetric(n, seed):
    a = np.random.default_rng(seed).standard_normal((n, n))
    return a + a.T


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_factors_give_the_matrix_back_and_count_its_eigenvalues(n):
    for seed in range(5):
        a = symmetric(n, seed)
        order, f, blocks = ldlt(a)
        lower, d = np.eye(n), np.zeros((n, n))
        for k, end in blocks:
            d[k:end, k:end] = f[k:end, k:end]
            lower[end:, k:end] = f[end:, k:end]
        assert np.allclose(lower @ d @ lower.T, a[np.ix_(order, order)], atol=1e-10)
        values = np.linalg.eigvalsh(a)
        for shift in (-1.0, 0.0, 0.7, values.mean() + 0.01):
            assert eigenvalues_above(a, shift) == (values > shift).sum()
        b = np.arange(n) + 1.0
        assert np.allclose((a - 0.3 * np.eye(n)) @ solve_shifted(a, 0.3, b), b, atol=1e-7)


def spectra():
    q, _ = np.linalg.qr(symmetric(20, 8))
    yield "plain", q @ np.diag(np.arange(20.0, 0, -1)) @ q.T
    yield "equal values", q @ np.diag([5.0, 5, 5, 5, 5, *[1.0] * 15]) @ q.T
    yield "all equal", 3 * np.eye(20)
    yield "close values", q @ np.diag([2 + 2e-9, 2 + 1e-9, 2.0, 1.0, *[0.5] * 16]) @ q.T
    yield "far apart", q @ np.diag([1e6, 1.0, 1e-1, 1e-2, *[1e-3] * 16]) @ q.T
    yield "low rank", q @ np.diag([7.0, 2.0, *[0.0] * 18]) @ q.T
    yield "zero", np.zeros((20, 20))
    yield "one", np.array([[4.0]])


@pytest.mark.parametrize("name,v", list(spectra()))
def test_leading_values_and_vectors(name, v):
    v = (v + v.T) / 2
    values, vectors = np.linalg.eigh(v)
    found = leading_spectrum(v)
    wide = values[-1] * 1e-12
    expect = [x for x in values[::-1][:4] if x > wide]
    assert len(found.values) == len(expect) and all(found.certified)
    assert np.allclose(found.values, expect, rtol=1e-12, atol=wide)
    k = len(expect)
    assert np.allclose(found.vectors @ found.vectors.T, np.eye(k), atol=1e-10)
    assert np.abs(v @ found.vectors.T - found.vectors.T * found.values).max(initial=0) <= 1e-11 * max(values[-1], 1e-300)


def steps(vector):
    return [math.floor(256 * float(np.float32(c))) for c in vector]


def brute(rows):
    """What the operator should give, by a dense solver."""
    usable = [(i, steps(v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in usable}), float)
    n, sums = len(fit), fit.sum(axis=0).astype(int).tolist()
    y = fit - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(y.T @ y / n)
    out = []
    for i, x in usable:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        z = np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, sums)])
        for k in range(1, min(4, len(values)) + 1):
            out.append((i, k, n, deviation, z @ vectors[:, -k] / math.sqrt(values[-k]), values[-k] / values.sum()))
    return out


def same(got, expect):
    got = sorted(got, key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0, r["component"]))
    expect = sorted(expect, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"]) for r in got] == [r[:4] for r in expect]
    signs = {}
    for r, e in zip(got, expect):
        if abs(e[4]) > 1e-6:
            sign = signs.setdefault(e[1], math.copysign(1, r["whitened"] * e[4]))
            assert math.isclose(r["whitened"], sign * e[4], rel_tol=1e-8, abs_tol=1e-9)
        assert math.isclose(r["explained"], e[5], rel_tol=1e-9)
        assert r["identity_error"] < 1e-10


def vectors(n, seed=1, d=6):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, d)) * np.arange(1, d + 1)).astype(np.float32).tolist()


def test_equals_a_dense_solver_on_odd_rows(spark):
    rows = list(enumerate(vectors(200)))
    hot = rows[3][1]
    rows += [(1000 + i, hot) for i in range(150)] + [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1])]
    odd = [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, [float("nan")] * 6), (904, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0]), (905, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + odd], VECTORS).repartition(5)
    df = df.withColumns({c: F.lit("x") for c in ("id", "x", "component", "n", "whitened", "i", "d", "count")})
    got = whitened(df)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    same(got.collect(), brute(rows))


def test_small_and_empty_tables(spark):
    one = [1.0, 2.0, 3.0]
    for rows in ([], [(1, None)], [(1, one)], [(1, one), (2, one)]):
        assert whitened(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)).collect() == []
    rows = [(1, one), (2, [1.0, 2.5, 3.0]), (3, [1.0, 2.5, 3.0])]
    got = whitened(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)).collect()
    # Two distinct vectors span one component; the others' eigenvalues are zero.
    assert [(r["vec_id"], r["component"], r["n"]) for r in sorted(got)] == [(1, 1, 2), (2, 1, 2), (3, 1, 2)]
    assert {abs(round(r["whitened"], 9)) for r in got} == {1.0} and {round(r["explained"], 9) for r in got} == {1.0}


def test_great_entries_neither_fail_nor_overflow(spark):
    rows = [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 4.0])]
    got = whitened(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)).collect()
    assert {r["vec_id"] for r in got} == {1, 2, 3} and all(math.isfinite(r["whitened"]) for r in got)
    assert [r["deviation"] for r in got if r["vec_id"] == 1] == [None] * len([r for r in got if r["vec_id"] == 1])


def test_registered_query_over_the_whole_table(spark):
    path = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{path}/embeddings.parquet")
    same(op12_whitening(spark, path).collect(), brute([(r["vec_id"], r["embedding"]) for r in table.collect()]))
