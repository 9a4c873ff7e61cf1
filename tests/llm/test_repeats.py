"""Removal against a dictionary of all 50-byte strings."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvana.llm import repeats as s


def brute(rows):
    key = lambda i: (i is None, i or 0)
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - 49):
            x = b[j : j + 50]
            least[x] = min(least.get(x, key(i)), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if least[b[j : j + 50]] < key(i):
                gone[j : j + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for p, c in zip(b"\0" + gone, gone, strict=False) if c and not p)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: (key(r[0]), r[1:]))


def got(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_bytes string")
    found = [tuple(r) for r in s.remove_repeats(df, **sizes).drop("kept").collect()]
    return sorted(found, key=lambda r: ((r[0] is None, r[0] or 0), r[1:]))


def test_rows(spark):
    rng = random.Random(11)
    passage = "".join(rng.choice("abcdefghij klmnop") for _ in range(160))
    fill = lambda n: "".join(rng.choice("qrstuvwxyz é") for _ in range(n))
    rows = [(n * 3 % 40, fill(rng.randint(0, 80)) + passage[rng.randint(0, 60) : rng.randint(80, 160)] + fill(rng.randint(0, 80))) for n in range(40)]
    rows += [(50, passage + passage), (51, passage + "x" + passage), (51, passage), (None, passage), (None, passage), (52, None), (53, ""), (54, "a" * 49), (55, "a" * 50), (56, "a" * 500), (57, "ab" * 200), (58, "ba" * 200), (2, passage)]
    rows += [(60, passage[:49]), (61, passage[:50]), (62, "x" * 30 + passage[100:150])]
    assert got(spark, rows) == brute(rows)
    assert s.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_small_chunks(spark):
    rng = random.Random(2)
    lines = ["".join(rng.choice("abcd ") for _ in range(70)) for _ in range(12)]
    rows = [(n, "\n".join(rng.sample(lines, 4))) for n in range(60)]
    rows += [(100, "".join(rng.choice("abcd ") for _ in range(3000)) + lines[3]), (101, lines[3] * 40)]  # longer than a chunk
    assert got(spark, rows, chunk_bytes=700, part_bytes=900) == brute(rows)


def test_hot_anchor(spark):
    """One 24-gram, the least of all, in many contexts; and blanks."""
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("ghij") for _ in range(n))
    grams = [letters(24) for _ in range(400)]
    buf = np.frombuffer("".join(grams).encode() + bytes(32), np.uint8)[:-32]
    hashes = [int(s.runs(np.frombuffer((g * 3).encode() + bytes(32), np.uint8)[:-32], np.array([0, 72]))[2].min()) for g in grams]
    gram = grams[int(np.argmin(hashes))]
    rows = [(n, letters(30) + gram + letters(30)) for n in range(3 * s.HOT)]
    rows += [(1000 + n, rows[n][1][5:75] + letters(20)) for n in range(0, 3 * s.HOT, 3)]
    rows += [(2000 + n, letters(26) + " " * (20 + n) + letters(26)) for n in range(s.HOT)]
    assert len(buf) and got(spark, rows) == brute(rows) == got(spark, rows, chunk_bytes=2000)


def test_text_longer_than_a_tile(spark):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh ") for _ in range(s.TILE + 5000))
    rows = [(1, text), (2, text[s.TILE - 100 : s.TILE + 100] + "x" * 60), (3, text[: s.TILE + 10])]
    assert got(spark, rows, chunk_bytes=1000) == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=60, max_size=300), st.integers(1, 3))
def test_buckets(letters, period):
    text = bytes(97 + x for x in letters) + (b"ab" * 80)[: 90 * period] + bytes(97 + x for x in letters)
    strings = np.arange(len(text) - 49)
    bucket = s.buckets(text, strings).tolist()
    seen = {}
    for i, b in zip(strings.tolist(), bucket, strict=True):
        assert seen.setdefault(text[i : i + 50], b) == b
    assert len(set(bucket)) == len(seen)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=200), max_size=6))
def test_runs_cover_every_string(texts):
    buf = np.frombuffer(b"".join(texts) + bytes(32), np.uint8)[:-32]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    for tile in (64, 100, 1 << 18):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(s, "TILE", tile)
            start, count, _ = s.runs(buf, first)
        check_cover(texts, first, start, count)


def check_cover(texts, first, start, count):
    covered = sorted(s.ranges(start, count).tolist())
    assert covered == [a + j for a, t in zip(first.tolist(), texts, strict=False) for j in range(len(t) - 49)]
