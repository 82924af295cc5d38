"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendcloud.llm import neighbours
from trendcloud.llm.neighbours import fit_forest, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, is_query):
    usable = [
        (i, np.array(v, np.float32).astype(float)) for i, v in rows
        if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)
    ]
    out = {}
    for q, x in usable:
        if is_query(q):
            scored = sorted((-float(sum(a * b for a, b in zip(x, y))), i) for i, y in usable if i != q)
            out[q] = scored[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)


def vectors(seed, n, d=8, scale=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    if scale:
        x *= rng.random((n, 1)).astype(np.float32) * 9
    return [(i, v.tolist()) for i, v in enumerate(x)]


def close(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], rtol=1e-12)


def test_everything_searched_equals_brute_force(spark):
    """Vectors of all lengths: the nearest by inner product, not by angle."""
    rows = vectors(1, 300, scale=True)
    got = found(nearest(table(spark, rows), F.col("vec_id") % 20 == 0, share=1e9))
    close(got, brute(rows, 20, lambda i: i % 20 == 0))


@pytest.mark.parametrize("bucket", [8192, 40])
def test_recall_when_few_leaves_are_searched(spark, monkeypatch, bucket):
    monkeypatch.setattr(neighbours, "BUCKET_ROWS", bucket)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 3
    x = centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16))
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    got = found(nearest(table(spark, rows), F.col("vec_id") % 50 == 0, share=0.4, sample_size=1500))
    want = brute(rows, 20, lambda i: i % 50 == 0)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert all(len(got[q]) == 20 for q in want) and hits / (20 * len(want)) > 0.9


def test_ties_go_to_smaller_ids_and_repeated_vectors_are_no_burden(spark):
    """A vector held by most rows, queries among them."""
    rows = vectors(3, 60)
    rows += [(100 + i, rows[7][1]) for i in range(200)] + [(400 + i, [-x for x in rows[9][1]]) for i in range(30)]
    got = found(nearest(table(spark, rows), F.col("vec_id") % 10 == 0, share=1e9))
    close(got, brute(rows, 20, lambda i: i % 10 == 0))


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(4, 12, d=3)
    odd = [(20, None), (40, [0.0, 0.0, 0.0]), (60, [1.0, None, 2.0]), (80, [nan, 1.0, 1.0]), (100, [inf, 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    other = [(120, [1.0, 2.0])]
    got = found(nearest(table(spark, rows + odd + other), F.col("vec_id") % 20 == 0))
    close(got, brute(rows, 20, lambda i: i % 20 == 0))
    assert len(got[0]) == 11


def test_one_vector_and_none(spark):
    assert nearest(table(spark, [(0, [1.0, 0.0])]), F.lit(True)).collect() == []
    empty = nearest(table(spark, []), F.lit(True))
    assert empty.collect() == [] and empty.columns == ["query_id", "rank", "vec_id", "score"]


def test_repeated_rows_count_once(spark):
    rows = vectors(5, 30)
    got = found(nearest(table(spark, rows + rows), F.col("vec_id") % 10 == 0))
    close(got, brute(rows, 20, lambda i: i % 10 == 0))


def test_a_shared_queue_takes_leaves_by_distance():
    points = np.random.default_rng(6).normal(size=(500, 5))
    forest = fit_forest(points, 3, 20)
    q = points[0]
    margins = forest.normals @ q - forest.thresholds
    rows = np.bincount(forest.leaves_of(points).ravel(), minlength=forest.leaves).tolist()
    leaves = forest.search(margins, rows, float("inf"))
    assert sorted(leaves) == list(range(forest.leaves))
    assert set(forest.leaves_of(q[None])[0].tolist()) <= set(leaves[:3])
