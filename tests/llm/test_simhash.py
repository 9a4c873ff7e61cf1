"""Fingerprints and components against brute force."""

import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from corvana.llm import components
from corvana.llm import simhash as s


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab C\n\té "), max_size=8))
def test_fingerprints(texts):
    assert s.fingerprints(texts).tolist() == [plain_fingerprint(t) for t in texts]


def test_long_text():
    text = " ".join(f"w{n % 977} x{n % 31}" for n in range(3000))
    assert s.fingerprints([text, None, ""]).tolist() == [plain_fingerprint(text), 0, 0]


def near(rng, fp, n):
    for b in rng.sample(range(64), n):
        fp ^= 1 << b
    return fp


def roots(fps):
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= s.TAU:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {x: find(x) for x in fps}


def test_links_connect_all(spark):
    rng = random.Random(7)
    fps = {0, (1 << 64) - 1}
    for _ in range(60):
        centre = rng.getrandbits(64)
        fps.add(centre)
        fps.update(near(rng, centre, rng.randint(1, 6)) for _ in range(6))
    centre = rng.getrandbits(64)
    fps.update(near(rng, centre, rng.randint(1, 3)) for _ in range(400))  # one large group under shared keys
    signed = [(int(np.uint64(x).astype(np.int64)),) for x in fps]
    df = spark.createDataFrame(signed, "fp long")
    found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in s.fingerprint_links(df).collect()]
    assert all((a ^ b).bit_count() <= s.TAU for a, b in found)
    expected = roots(sorted(fps))
    own = {r.node % (1 << 64): r.root % (1 << 64) for r in s.components(s.fingerprint_links(df)).collect()}
    groups = lambda m: sorted(sorted(x for x in fps if m.get(x, x) == r) for r in {m.get(x, x) for x in fps})
    assert groups(own) == groups(expected)
    assert len(found) < 3 * len(fps) * s.SEGMENTS
    for full in (20, 150):  # most keys are filed anew twice and dealt in blocks; some are filed anew
        again = {r.node % (1 << 64): r.root % (1 << 64) for r in s.components(s.fingerprint_links(df, full=full)).collect()}
        assert groups(again) == groups(expected)


def test_keys_of_full_keys():
    rng = random.Random(9)
    a = np.array([rng.getrandbits(64) for _ in range(4000)], np.uint64)
    low = [sum(1 << bit for bit in rng.sample(range(32), rng.randint(0, 3))) for _ in a]  # up to TAU bits of the other half
    for start in range(s.SEGMENTS):
        turned = [x if not start else (x >> 16 * start | x << 64 - 16 * start) & (1 << 64) - 1 for x in low]
        b = a ^ np.array(turned, np.uint64)
        key = s.rotated(a, start) >> np.uint64(32) | np.uint64(start << 32)
        assert (key == s.rotated(b, start) >> np.uint64(32) | np.uint64(start << 32)).all()
        bytes_a, bytes_b = s.by_byte(key, a), s.by_byte(key, b)
        assert np.any([x == y for x, y in zip(bytes_a, bytes_b, strict=True)], axis=0).all()
        for x, y in zip(bytes_a, bytes_b, strict=True):
            same = x == y
            quarters = zip(s.by_quarter(x[same], a[same]), s.by_quarter(y[same], b[same]), strict=True)
            assert np.any([p == q for p, q in quarters], axis=0).all()
            assert (s.start_of(s.by_quarter(x, a)[3]) == start).all()
        assert len({k.tobytes() for k in [*bytes_a, *(q for x in bytes_a for q in s.by_quarter(x, a))]}) == 20


def test_blocks_meet_once_each(spark):
    rows = [(5 << 40 | 2 << 32 | 7, n, n % 3 == 0) for n in range(100)] + [(9, 1000, False), (9, 1001, True)]
    df = spark.createDataFrame(rows, "key long, fp long, probe boolean")
    crowded = df.groupBy("key").agg(s.F.count("*").alias("n")).where("n > 10")
    groups = {}
    for r in s.blocks_met(df, crowded, 10).collect():
        groups.setdefault(r.key, ([], []))[r.probe].append(r.fp)
    assert all(k >> 32 & 255 == 2 for k in groups)
    met = sorted((a, b) for filed, asking in groups.values() for a in filed for b in asking)
    assert met == sorted((a, b) for a in range(100) if a % 3 for b in range(100))
    assert max(len(x) + len(y) for x, y in groups.values()) < 60


def test_rows(spark):
    text = "one two three four five six"
    rows = [(5, text, "x"), (3, text, "y"), (3, text, "y"), (9, None, None), (8, "", None), (None, "other words here now", None), (7, "Other WORDS here now", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in s.near_duplicates(df).collect())
    ids = [(i, c) for i, _, c in got]
    assert ids == [(-1, 7), (3, 3), (3, 3), (5, 3), (7, 7), (8, 8), (9, 8)]
    assert {f for i, f, _ in got if i in (8, 9)} == {"0" * 16}
    kept = s.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 8]
    assert s.near_duplicates(df.limit(0)).count() == 0 == s.keep_first(df.limit(0)).count()
    only_null = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert [r.component_id for r in s.near_duplicates(only_null).collect()] == [None, None]
    assert s.keep_first(only_null).count() == 1


def test_keep_first_by_component(spark):
    first, other, third = "alpha beta gamma delta epsilon", "nine entirely different words stand in this one here", "and a last text about something else again"
    rows = [(None, first), (None, other), (None, other), (1, third), (1, "some more words under a repeated number"), (2, third)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id or -1, r.text) for r in s.keep_first(df).collect())
    assert kept == sorted([(-1, first), (-1, other), (1, third), (1, rows[4][1])])


def test_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT_ROWS", 20)
    monkeypatch.setattr(components, "FEW_ROWS", 0)
    left = spark.createDataFrame([(n % 7 if n % 3 else 1, n) for n in range(200)] + [(None, 500)], "k long, x long")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (9, "c")], "k long, y string")
    for how in ("inner", "left"):
        got = sorted(components.joined(left, right, "k", how).collect(), key=str)
        assert got == sorted(left.join(right, "k", how).collect(), key=str)
    edges = [(0, n) for n in range(1, 60)] + [(100, n) for n in range(101, 120)] + [(59, 200), (200, 201), (119, 119)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {n: 0 if n < 60 or n >= 200 else 100 for n in [*range(60), *range(100, 120), 200, 201]}


def test_keep_first_without_broadcast(spark):
    rows = [(n % 40, f"text number {n % 25} with some words of its own {n % 25}", n % 2) for n in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, other int")
    found = s.fingerprint_rows(df, "doc_id", "text", keyed=True)
    few, many = (sorted(map(tuple, s.first_rows(df, "doc_id", "text", found, s.labelled(found), n).collect())) for n in (1000, 0))
    assert few == many and len(few) == len({t for _, t, _ in few})


def test_few_edges_stay_in_one_task(spark):
    """Small tables of a round aren't dealt over all shuffle partitions, which would write a file for each."""
    edges = spark.createDataFrame([(n, n + 1) for n in range(300)] + [(1000, 1001)], "a long, b long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = components.components(edges)
        assert found.rdd.getNumPartitions() == 1
        assert {r.node: r.root for r in found.collect()} == {n: 0 for n in range(301)} | {1000: 1000, 1001: 1000}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
