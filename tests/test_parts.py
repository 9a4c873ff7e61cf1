"""State machines in parts against one task, and against plain loops."""

import math

import numpy as np
import pytest

from corvana.functions.signals import filter_coefficients
from corvana.operators import gate, parts


@pytest.fixture(scope="module")
def signals(spark):
    """A long signal, some short ones, one under a null key, nulls among the samples."""
    rng = np.random.default_rng(3)
    rows = [(7, i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.normal(size=4000) * (np.sin(np.arange(4000) / 150) ** 4), rng.normal(size=4000) * 0.001, strict=True))]
    rows += [(k, i, float(rng.normal()), 0.3) for k in range(20) for i in range(int(rng.integers(1, 40))) if k != 7]
    rows += [(None, i, 0.1 * i, 0.2) for i in range(30)]
    rows = [(k, i, None if i % 501 == 500 else x, y) for k, i, x, y in rows]
    order = rng.permutation(len(rows))
    return spark.createDataFrame([rows[i] for i in order], "key long, at long, x double, y double")


def signal(df, key):
    return [(r["at"], r["x"], r["y"]) for r in df.where("key = 7" if key == 7 else "key is null").orderBy("at").collect()]


MACHINES = {
    "cascade": lambda: parts.Cascade(filter_coefficients("highpass", 8000.0, 100.0, 0.7071), filter_coefficients("lowpass", 8000.0, 900.0, 0.7071)),
    "smoother": lambda: parts.Smoother(0.01, 0.0001, least=1e-6),
    "damped": lambda: parts.Smoother(0.3, 0.01, damping=(0.5, 2.0)),
    "counter": lambda: parts.Each((0.0,), lambda s, x: ((s[0] + 1,), s[0] + 1)),  # never forgets
    "meter": lambda: gate.Meter(8000.0, 1, sections=gate.k_weighting(8000.0)),
}


@pytest.mark.parametrize("name", list(MACHINES))
@pytest.mark.parametrize("n_parts", [1, 7])
def test_parts_equal_one_pass(signals, name, n_parts):
    machine = MACHINES[name]()
    out = machine.outputs[0]
    found = {(r["key"], r["at"]): r[out] for r in parts.in_parts(signals, "key", ["at"], "x", machine, n_parts).collect()}
    assert len(found) == signals.count()
    for key in (7, None):
        rows = [(at, x) for at, x, _ in signal(signals, key)]
        there = [x for _, x in rows if x is not None]
        _, y = machine.run(machine.first, np.array(there)[:, None])
        expected = iter(y[:, 0])
        for at, x in rows:
            got = found[(key, at)]
            assert got is None if x is None else math.isclose(got, next(expected), rel_tol=1e-9, abs_tol=1e-12)
    by_key = {(r["key"], r["at"]): r[out] for r in parts.by_key(signals, "key", ["at"], "x", machine).collect()}
    assert all((v is None) == (by_key[k] is None) and (v is None or math.isclose(v, by_key[k], rel_tol=1e-9, abs_tol=1e-12)) for k, v in found.items())


def test_cascade_against_loop():
    rng = np.random.default_rng(1)
    c, d = filter_coefficients("peaking", 8000.0, 700.0, 2.0, 5.0), filter_coefficients("lowpass", 8000.0, 900.0, 0.7071)
    machine, x = parts.Cascade(c, d), rng.normal(size=1000)
    expected = parts.Cascade.recursion(d, (0.0,) * 4, parts.Cascade.recursion(c, (0.0,) * 4, x.tolist()))
    state, found, at = machine.first, [], 0
    for n in (0, 1, 2, 127, 128, 300, 442):  # handed on at any place
        state, y = machine.run(state, x[at : at + n][:, None])
        found += y[:, 0].tolist()
        at += n
    assert at == 1000 and np.allclose(found, expected, rtol=0, atol=1e-10)


def brute(rows, rate, o):
    """The adaptive gate, sample by sample."""
    sections = [[[filter_coefficients(k, rate, f, 0.7071), [0.0] * 4] for k, f in (("highpass", o.low), ("lowpass", o.high))] for _ in range(2)]
    level, low, high, frames, last = [1e-6, 1e-6], -60.0, -60.0, [], None
    for i, row in enumerate(rows):
        for c in (0, 1):
            v = row[c]
            for k, s in sections[c]:
                y = k["b0"] * v + k["b1"] * s[0] + k["b2"] * s[1] - k["a1"] * s[2] - k["a2"] * s[3]
                s[:] = [v, s[0], y, s[2]]
                v = y
            rest = v * v - level[c]
            level[c] = max(level[c] + rest * (o.up if rest >= 0 else o.down) / (rate * 2), 1e-6)
            loud = 20 * math.log10(math.sqrt(sum(level) / 2))
            low = min(loud, low + o.decay / (rate * 2))
            if loud >= -60:
                high = max(loud, high - o.decay / (rate * 2))
        if last is None or i / rate > last + 0.01:
            last = i / rate
            frames.append([last, loud, low, high])
    active, until = [False] * len(frames), len(frames)
    for i in range(len(frames) - 1, -1, -1):
        active[i] = i >= until
        if frames[i][1] >= max(frames[i][3], -30) + o.threshold:
            active[i], until = True, max(i - math.floor(o.backward / 0.01), 0)
    out = []
    for (start, *_), a in zip(frames, active, strict=True):
        end = min(start + 0.01, len(rows) / rate)
        if out and out[-1][0] == a:
            out[-1][2] = end
        else:
            out.append([a, start, end])
    return frames, [tuple(x) for x in out]


@pytest.mark.parametrize(("n_parts", "block"), [(None, 4096), (1, 64), (9, 16)])
def test_gate_against_loop(signals, n_parts, block):
    rate, options = 2000.0, gate.GateOptions(low=60.0, high=700.0, down=90.0, decay=8.0, backward=0.03, threshold=-3.0)
    df = signals.withColumnRenamed("x", "left").withColumnRenamed("y", "right")
    got = {}
    for r in gate.voice_activity(df, "key", ["at"], ["left", "right"], rate, options, n_parts, block).collect():
        got.setdefault(r.key, []).append((r.segment, r.active, r.start_time, r.end_time))
    for key in (7, None):
        rows = [(x, y) for _, x, y in signal(signals, key) if x is not None]
        _, expected = brute(rows, rate, options)
        found = sorted(got[key])
        assert [s[0] for s in found] == list(range(len(expected)))
        assert [s[1] for s in found] == [e[0] for e in expected]
        assert np.allclose([s[2:] for s in found], [e[1:] for e in expected], rtol=0, atol=1e-9)
    assert len(got[7]) > 4 and len(got) == 21


def test_no_samples(spark):
    df = spark.createDataFrame([(1, 0, None)], "key long, at long, x double")
    assert gate.voice_activity(df, "key", ["at"], ["x"], 1000.0).count() == 0
    assert gate.voice_activity(df.limit(0), "key", ["at"], ["x"], 1000.0, parts=3).count() == 0
    assert parts.in_parts(df, "key", ["at"], "x", parts.Smoother(1.0, 1.0), 3).first()["y"] is None


def test_windows_in_parts(spark):
    """Islands, as-of joins and running means are the same when a key is too long for a task."""
    from pyspark.sql import functions as F

    from corvana.operators import timeline, vector_sets
    from corvana.plans.islands import state_islands

    rng = np.random.default_rng(5)
    rows = [(k, i, None if rng.random() < 0.05 else float(rng.integers(0, 4))) for k, n in ((1, 900), (2, 30), (None, 50)) for i in range(n)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "key long, at long, value double").repartition(3)

    def same(found, *columns):
        a, b = (sorted((tuple(r[c] for c in columns) for r in x.collect()), key=repr) for x in found)
        assert len(a) == len(b)
        for x, y in zip(a, b, strict=True):
            assert all(p == q or math.isclose(p, q, rel_tol=1e-12) for p, q in zip(x, y, strict=True))

    same([state_islands(df, "key", ["at"], F.col("value") > 1, most) for most in (1 << 20, 10)], "key", "at", "state", "island")
    same([vector_sets.running_mean(df, "key", ["at"], "value", most) for most in (1 << 20, 10)], "key", "at", "mean")
    left = df.select("key", F.when(F.col("at") % 40 != 7, F.col("at") + 0.5).alias("t"), "value")
    right = df.where("value = 2").select("key", F.col("at").cast("double").alias("other"))
    found = [timeline.nearest_times(left, right, "key", "t", "other", most) for most in (1 << 20, 10)]
    same(found, "key", "t", "value", "matched")
    assert found[1].where("matched is not null").count() > 500
