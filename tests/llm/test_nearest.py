"""Neighbours against brute force in double precision."""

import numpy as np
from pyspark.sql import functions as F

from corvana.llm import nearest as s


def brute(vectors, queries, k):
    out = []
    for q in queries:
        a = np.array(vectors[q], float)
        found = []
        for i, v in vectors.items():
            b = np.array(v, float)
            if i != q and len(b) == len(a):
                dot, na, nb = (float(s.fold(x[None], y[None])[0]) for x, y in ((a, b), (a, a), (b, b)))
                found.append((-dot / (np.sqrt(na) * np.sqrt(nb)), i))
        out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def test_ties_and_bounds(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16)).astype(np.float32)
    vectors = {i: (base[i % 30] * (1 + i % 4)).tolist() for i in range(300)}  # many equal cosines
    vectors |= {1000 + i: (base[i % 30] + rng.normal(size=16) * 1e-3).astype(np.float32).tolist() for i in range(100)}
    vectors[2000] = [1.0, 2.0]
    vectors[2050] = [2.0, 4.0]
    df = spark.createDataFrame([(i, v) for i, v in vectors.items()], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in s.nearest(df, F.col("vec_id") % 50 == 0).collect())
    expected = brute(vectors, [i for i in vectors if i % 50 == 0], 5)
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    assert np.allclose([g[3] for g in got], [e[3] for e in expected], rtol=0, atol=1e-15)


def test_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (None, [1.0, 0.0], 1), (7, [1.0, 1.0], 1), (7, [1.0, 1.0], 1), (0, [2.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in s.nearest(df, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 7), (0, 2, 7)]
    assert s.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_tiles_against_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = {i: rng.normal(size=8).astype(np.float32).tolist() for i in range(700)}
    df = spark.createDataFrame([(i, v) for i, v in vectors.items()], "vec_id long, embedding array<float>")
    monkeypatch.setattr(s, "CHUNK", 64)
    monkeypatch.setattr(s, "QUERY_BLOCK", 8)
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in s.nearest(df, F.col("vec_id") % 20 == 0, k=3).collect())
    assert got == [e[:3] for e in brute(vectors, range(0, 700, 20), 3)]


def test_long_vectors(spark):
    """Beyond 1,040 components the products of codes don't fit single precision any more."""
    rng = np.random.default_rng(8)
    vectors = {i: rng.normal(size=1041 + i % 2 * 300).astype(np.float32).tolist() for i in range(60)}
    df = spark.createDataFrame([(i, v) for i, v in vectors.items()], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in s.nearest(df, F.col("vec_id") % 10 == 0, k=3).collect())
    assert got == [e[:3] for e in brute(vectors, range(0, 60, 10), 3)]
