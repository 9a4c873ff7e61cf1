"""Stacked sweeps against single ones, paths over weights and carried timelines against loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvana.functions import signals
from corvana.operators import alignment, warping


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("band", [None, 2, 5])
def test_many_pairs_equal_single_ones(metric, band, monkeypatch):
    rng = np.random.default_rng(4)
    pairs = [(rng.integers(0, 4, (n, d)).astype(float), rng.integers(0, 4, (m, d)).astype(float)) for n, m, d in ((1, 1, 1), (1, 7, 2), (6, 1, 2), (9, 12, 1), (12, 9, 3), (8, 8, 2), (20, 5, 1)) for _ in range(4)]
    pairs += [None, (np.zeros(0), np.zeros(3)), (np.zeros(2), np.zeros(0))]
    expected = [(None, None) if p is None else alignment.dtw(*p, metric, band) for p in pairs]
    for cells in (1 << 21, 50):
        monkeypatch.setattr(alignment, "STACK_CELLS", cells)
        assert alignment.dtw_many(pairs, metric, band) == expected
    monkeypatch.setattr(alignment, "KEPT_CELLS", 20)  # long pairs are swept one by one
    assert alignment.dtw_many(pairs, metric, band) == expected


def best(weights):
    """The largest sum over all monotone paths but for the first pair, cell by cell."""
    n, m = weights.shape
    total = np.full((n, m), -np.inf)
    for i in range(n):
        for j in range(m):
            before = [total[a, b] for a, b in ((i, j - 1), (i - 1, j), (i - 1, j - 1)) if a >= 0 and b >= 0]
            total[i, j] = max(before) + weights[i, j] if before else 0.0
    return total[-1, -1]


def test_weights_against_loop(spark):
    rng = np.random.default_rng(2)
    cubes = [rng.normal(size=(rng.integers(1, 4), rng.integers(1, 6), rng.integers(1, 12))) * 3 for _ in range(40)]
    df = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(cubes)] + [(100, None), (101, []), (102, [[[]]])], "id long, heads array<array<array<double>>>")
    for r in df.select("id", warping.attention_path(F.col("heads")).alias("r")).collect():
        if r.id >= 100:
            assert (r.r is None or r.r.path is None) if r.id == 100 else list(r.r.path) == []
            continue
        cube = cubes[r.id]
        total = np.zeros(cube.shape[1:])
        for head in cube:
            soft = np.array([np.exp(t) / np.exp(t).sum() for t in head])
            soft = (soft - soft.mean()) / (np.sqrt((soft**2).mean()) + 1e-10)
            for t in range(len(soft)):
                total[t] += [sorted(soft[t][f - 2 : f + 3])[2] if 2 <= f < len(soft[t]) - 2 else soft[t][f] for f in range(len(soft[t]))]
        total /= len(cube)
        path = [(p.source, p.dest) for p in r.r.path]
        assert path[0] == (0, 0) and path[-1] == (total.shape[0] - 1, total.shape[1] - 1)
        assert all((c - a, d - b) in ((0, 1), (1, 0), (1, 1)) for (a, b), (c, d) in zip(path, path[1:], strict=False))
        assert abs(-r.r.cost - best(total)) < 1e-4 and abs(sum(total[p] for p in path[1:]) - best(total)) < 1e-4
    part = df.where("id = 0").select(warping.attention_path(F.col("heads"), F.lit(1), F.lit(1)).alias("r")).first().r
    assert part.cost == 0.0 and part.path == []


def test_frames_of_a_part(spark):
    rng = np.random.default_rng(8)
    cube = rng.normal(size=(2, 3, 20))
    df = spark.createDataFrame([(cube.tolist(), cube[:, :, 5:15].tolist())], "whole array<array<array<double>>>, part array<array<array<double>>>")
    r = df.select(warping.attention_path(F.col("whole"), F.lit(5), F.lit(15)).alias("a"), warping.attention_path(F.col("part")).alias("b"), warping.attention_path(F.col("whole"), selected=[1]).alias("c"), warping.attention_path(F.slice("whole", 2, 1)).alias("d")).first()
    assert r.a.cost == r.b.cost and [(p.source, p.dest) for p in r.a.path] == [(p.source, p.dest + 5) for p in r.b.path]
    assert r.c == r.d


def test_cropped(spark):
    df = spark.createDataFrame([([[float(i) for i in range(10)], [float(-i) for i in range(10)]], [(-1.0, 0.25), (0.5, 0.5), (0.6, 9.0), (0.2, 0.4)])], "c array<array<double>>, e array<struct<start_time:double,end_time:double>>")
    x, y = df.select(warping.cropped(F.col("c"), F.col("e"), 10.0)).first()[0]
    assert x == [0, 1, 6, 7, 8, 9, 2, 3] and y == [-v for v in x]
    assert df.select(warping.cropped(F.col("c"), F.slice("e", 1, 0), 10.0)).first()[0] == [[], []]


def test_segments_equal_one_by_one(spark):
    """Words of three segments of a signal, each moved along its own path, against aligning each alone."""
    rng = np.random.default_rng(6)
    rate, options = 8000.0, {"rate": 8000, "window": 200, "hop": 80, "order": 256, "high": 3900.0}
    parts = [np.sin(np.arange(2400) * rng.uniform(0.05, 0.6)) * np.hanning(2400) + rng.normal(size=2400) * 0.01 for _ in range(3)]
    signal = np.concatenate(parts)
    said = [("a", 0.0, 0.1), ("b", 0.1, 0.28)]
    rows = [(1, n, n * 0.3, n * 0.3 + 0.3, np.interp(np.linspace(0, 2399, 2000), np.arange(2400), p).tolist(), said) for n, p in enumerate(parts)]
    rows += [(1, 9, 5.0, 6.0, [0.0], said), (2, 0, 0.0, 1.0, [0.0], said)]
    segments = spark.createDataFrame(rows, "id long, segment int, start_time double, end_time double, reference array<double>, words array<struct<text:string,start_time:double,end_time:double>>")
    found = warping.align_segments(spark.createDataFrame([(1, signal.tolist())], "id long, samples array<double>"), segments, "id", rate, **options).collect()
    got = sorted((r.segment, r.text, round(r.start_time, 6), round(r.end_time, 6)) for r in found)
    expected, hop = [], 80 / 8000
    for n in range(3):
        own = signal[int(rows[n][2] * rate) : int(rows[n][3] * rate)]
        _, path = alignment.dtw(signals.mfcc(np.array(rows[n][4]), **options), signals.mfcc(own, **options))
        for word, a, b in said:
            first, last = (min(int(np.floor(t / hop)), path[-1][0]) for t in (a, b))
            expected.append((n, word, round(n * 0.3 + min(j for i, j in path if i == first) * hop, 6), round(n * 0.3 + max(j for i, j in path if i == last) * hop, 6)))
    assert got == sorted(expected)


def mapped(source, mapping, target):
    groups = {}
    for a, b in mapping:
        groups.setdefault(a, [])
        if b not in groups[a]:
            groups[a].append(b)
    slices = {}
    for a, targets in groups.items():
        start, end = source[a]
        width = (end - start) / len(targets)
        for i, b in enumerate(targets):
            slices.setdefault(b, []).append((start + i * width, start + (i + 1) * width))
    return sorted((b, target[b], round(x[0][0], 9), round(x[-1][1], 9)) for b, x in slices.items())


def test_mapping_against_loop(spark):
    rng = random.Random(3)
    source = [(round(i + rng.random() / 2, 3), i + 1.0) for i in range(12)]
    target = [f"t{i}" for i in range(15)]
    mapping = [(rng.randrange(12), rng.randrange(15)) for _ in range(40)]
    expected = mapped(source, mapping, target)
    frames = (
        spark.createDataFrame([("k", i, a, b) for i, (a, b) in enumerate(source)], "key string, source int, start_time double, end_time double"),
        spark.createDataFrame([("k", n, a, b) for n, (a, b) in enumerate(mapping)] + [("k", 99, None, 1)], "key string, ord int, source int, target int"),
        spark.createDataFrame([("k", i, t) for i, t in enumerate(target)], "key string, target int, text string"),
    )
    found = warping.timeline_by_mapping(*frames, "key").collect()
    assert sorted((r.target, r.text, round(r.start_time, 9), round(r.end_time, 9)) for r in found) == expected


def test_timeline_by_words(spark):
    """Whole rows give what pairs of words give, also for repeated, missing and no words, and for a line of several turns."""
    from corvana.plans.carried import shared_lines

    texts = [(1, "a b a c", "A x b a a"), (2, "one", "two"), (3, "", "a"), (4, "b b b", "B"), (5, "c a", "a c a c d")]
    met = spark.createDataFrame([(n, [a], [b]) for n, a, b in texts], "line long, a array<string>, b array<string>")
    split = lambda t: t.split()
    rows = [(n, [i * 0.5 for i in range(len(split(a)))], [i * 0.5 + 0.4 for i in range(len(split(a)))], split(a.lower()), split(b), split(b.lower())) for n, a, b in texts]
    pairs = spark.createDataFrame(rows, "line long, start_times array<double>, end_times array<double>, source_words array<string>, words array<string>, target_words array<string>")
    found = warping.timeline_by_words(pairs, "line")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    told = lambda df: sorted((r.line, r.target, r.text, round(r.start_time, 9), round(r.end_time, 9)) for r in df.collect())
    assert told(found) == told(shared_lines(met)) and len(told(found)) == 4 + 0 + 0 + 1 + 4
    twice = spark.createDataFrame([(1, ["a", "a b"], ["b a"])], met.schema)
    assert [r[:3] for r in told(shared_lines(twice))] == [(1, 0, "b"), (1, 1, "a")]
