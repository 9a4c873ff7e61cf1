"""The plan against a slot-by-slot simulation, and its bound on deviation."""

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvana.llm import mixing as m


def simulated(weights, blocks):
    """Slots in order, one block at a time."""
    left, done, t0, t, out = dict(blocks), dict.fromkeys(blocks, 0), 0, 0, []
    left = {s: n for s, n in left.items() if n}
    while left:
        total = sum(weights[s] for s in left)
        ready = [s for s in left if done[s] * total // weights[s] <= t - t0]
        s = min(ready, key=lambda s: (-(-(done[s] + 1) * total // weights[s]), s))
        out.append(s)
        done[s] += 1
        left[s] -= 1
        t += 1
        if not left[s]:
            del left[s]
            done, t0 = dict.fromkeys(blocks, 0), t
    return out


MIXES = st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.integers(1, 12), st.integers(0, 25)), min_size=1)


@settings(max_examples=200, deadline=None)
@given(MIXES)
def test_plan(mix):
    weights, blocks = {s: w for s, (w, _) in sorted(mix.items())}, {s: n for s, (_, n) in sorted(mix.items())}
    slots = {}
    for p in m.phases(weights, blocks):
        for c in range(p["last"] - p["first"]):
            slot = p["start"] + c // p["share"] * p["period"] + p["slots"][c % p["share"]]
            assert slot not in slots
            slots[slot] = p["pool"]
    assert [slots[n] for n in range(len(slots))] == simulated(weights, blocks)
    assert len(slots) == sum(blocks.values())


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.integers(1, 40), min_size=1))
def test_less_than_one_block_off(weights):
    total, slots = sum(weights.values()), m.pattern(weights)
    for s, w in weights.items():
        assert len(slots[s]) == w
        for t in range(total + 1):
            assert abs(sum(x < t for x in slots[s]) * total - t * w) < total


def test_rows(spark):
    rows = [(n, "a" if n % 3 else "b", n, "x") for n in range(400)] + [(5, "a", 5, "x")] * 3 + [(None, None, 0, None), (900, "zzz", 1, "y")]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot long, pool string")
    got = m.mix(df, {"a": 3, "b": 1, "none": 2}, 1, 4).collect()
    assert len(got) == len(rows)
    assert len({r.mix_position for r in got}) == len(rows)
    assert {r.pool for r in got if r.doc_id in (None, 900)} == {m.OTHER}
    assert all(r.release <= r.slot < r.deadline for r in got)
    assert m.mix(df.limit(0), {"a": 3}, 1, 4).count() == 0
    for weights in ({"a": 0}, {"a": m.MAX_WEIGHT}):
        with pytest.raises(ValueError):
            m.mix(df, weights, 1, 4)


def test_rows_without_id_are_spread(spark):
    df = spark.createDataFrame([(None, "a", n) for n in range(3000)] + [(n, "a", n) for n in range(100)], "doc_id long, source string, n long")
    got = m.mix(df, {"a": 3}, 1, 4).collect()
    assert sorted(r.mix_position for r in got) == list(range(3100))
    places = sorted(r.mix_position for r in got if r.doc_id is not None)
    assert places[0] < 200 and places[-1] > 2900  # between the others, not before or behind them


def test_against_sql(spark):
    rows = [(n * 7 % 501, f"s{n % 5}" if n % 4 else None) for n in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    weights = {"s0": 5, "s1": 2, "s3": 1}
    con = duckdb.connect()
    frame = df.toPandas()
    con.register("documents", frame)
    expected = con.execute(m.oracle(weights, 3, 8)).fetchall()
    got = [tuple(r) for r in m.mix(df, weights, 3, 8).collect()]
    key = lambda r: (r[8], r[0])
    assert sorted(got, key=key) == sorted(expected, key=key)
