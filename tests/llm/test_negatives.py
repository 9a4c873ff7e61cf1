"""Hard negatives against brute force in whole numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvana.llm import negatives as s


def brute(rows, anchors, k=5):
    """rows: (id, label, vector), as whole numbers of Python."""
    usable = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows]
    out = []
    for a, label, v in usable:
        if a in anchors:
            score = [(-sum(x * z for x, z in zip(v, w, strict=True)), i, y) for i, y, w in usable if i != a and len(w) == len(v)]
            positives = sorted((p, i) for p, i, y in score if y == label)[:k]
            for p, i in positives:
                found = sorted((n, j) for n, j, y in score if y != label and 80 * -p <= 100 * -n <= 100 * -p)[:k]
                out += [(a, i, r + 1, j, -p, -n) for r, (n, j) in enumerate(found)]
    return sorted(out)


def got(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, y, v) for i, y, v in rows], "vec_id long, label int, embedding array<double>")


def test_ties_copies_and_signs(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 9)) * 0.3
    rows = [(i, int(i * 7 % 5), (base[i % 12] + (i % 3 == 0) * rng.normal(size=9) * 0.05).tolist()) for i in range(260)]
    rows += [(1000, 0, (-base[0]).tolist()), (1001, 9, base[1].tolist()), (1002, 3, [0.0] * 9), (1003, 4, [0.0] * 9), (1004, 3, [0.1] * 4), (1005, 3, [0.2] * 4), (1006, 1, [0.19] * 4)]
    anchors = {i for i, _, _ in rows if i % 10 == 0} | {1002, 1004}
    df = frame(spark, rows)
    expected = brute(rows, anchors)
    assert len(expected) > 200 and got(s.hard_negatives(df, F.col("vec_id").isin(sorted(anchors)))) == expected


def test_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(3)), rng.normal(size=8).tolist()) for i in range(700)]
    for name, value in {"CHUNK": 64, "ANCHOR_BLOCK": 9, "TILE_ANCHORS": 4, "PAIRS": 7}.items():
        monkeypatch.setattr(s, name, value)
    assert got(s.hard_negatives(frame(spark, rows), F.col("vec_id") % 20 == 0, k=3)) == brute(rows, set(range(0, 700, 20)), 3)


def test_scores_beyond_doubles(spark):
    """Products over 2^53 are kept as whole numbers, and order by their last unit."""
    big = float(1 << 22)
    rows = [(0, 0, [big, 1.0]), (1, 0, [big, 3 / 256]), (2, 0, [big, 2 / 256]), (3, 1, [big, 1 / 256]), (4, 1, [big, 2 / 256]), (5, 1, [big, -1 / 256]), (6, 1, [big, 4 / 256])]
    assert got(s.hard_negatives(frame(spark, rows), F.col("vec_id") == 0)) == brute(rows, {0})


@pytest.mark.parametrize("few", [1, 16, 10_000])
def test_planes_narrow_to_scores(monkeypatch, few):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(s, "FEW", few)
    a, x = rng.integers(-300, 300, (6, 11)), rng.integers(-500, 500, (40, 11))
    chunk = s.Chunk(*s.packed(np.arange(40), np.zeros(40, np.int64), x, np.zeros((40, 1), np.int64)).values())
    assert (chunk.numbers() == x).all()
    seen = []

    def alive(low, high, q, c):
        true = (a @ x.T)[q, c]
        assert (low <= true).all() and (true <= high).all()
        seen.append(float(np.mean(high - low)))
        return high >= 50_000

    q, c, score = s.narrowed(a, chunk, np.arange(40), alive)
    assert seen == sorted(seen, reverse=True)
    assert sorted(zip(q.tolist(), c.tolist(), score.tolist(), strict=True)) == sorted((i, j, int(v)) for (i, j), v in np.ndenumerate(a @ x.T) if v >= 50_000)


def test_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.0], 1), (1, 1, None, 1), (2, None, [1.0, 0.0], 1), (3, 2, [nan, 0.0], 1), (4, 2, [inf, 1.0], 1), (5, 2, [None, 1.0], 1), (None, 2, [1.0, 0.0], 1), (6, 1, [1.0, 0.5], 1), (7, 2, [0.9, 0.0], 1), (7, 2, [0.9, 0.0], 1), (0, 2, [0.95, 0.0], 1), (8, 1, [], 1), (9, 2, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, rank int")
    found = got(s.hard_negatives(df, F.col("vec_id").isin(0, 8)))
    assert found == [(0, 6, 1, 7, 65536, 256 * 230), (0, 6, 2, 7, 65536, 256 * 230)]
    assert s.hard_negatives(df.limit(0), F.col("vec_id") == 0).count() == 0
    moved, _ = s.anchors_and_labels(df)
    assert {(r.vec_id, r.label) for r in moved.where("vec_id in (0, 6, 7)").collect()} == {(0, 2), (0, 3), (6, 1), (7, 3)}
