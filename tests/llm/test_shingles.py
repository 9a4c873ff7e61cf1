"""Near-duplicates by shingle sets against brute force."""

import random

import corpus_pipeline
import numpy as np
from corvana.llm import shingles as s


def plain(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def expected(rows):
    sets, root = [plain(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and similar(sets[i], sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    return sorted(min(rows[n][0] for n in range(len(rows)) if root[n] == r) for r in set(root))


def test_stage(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(200, 300))]
        rows.append((len(rows), " ".join(words)))
        for changes in (1, 2, 4, 5, 6, 9, 15):
            copy = list(words)
            for n in rng.sample(range(len(copy)), changes):
                copy[n] = "other"
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000, None), (1001, ""), (1002, "few words"), (1003, "Few  words"), (1004, "few words more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    full = df.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "0L as n_chars")
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, full, "").collect())
    assert kept == expected(rows)
    assert s.keep_first(df.limit(0)).count() == 0


def test_groups_of_many_blocks(spark):
    """A group whose sets fill many blocks keeps its links, also those of chains and of several components."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(5000)}" for _ in range(250)]
    rows = []
    for n in range(60):  # one group of near copies, each from the first
        copy = list(words)
        copy[rng.randrange(250)] = f"x{n}"
        rows.append((len(rows), " ".join(copy)))
    chain = [f"v{rng.randrange(5000)}" for _ in range(250)]
    for n in range(60):  # each a near copy of the one before only
        at = rng.randrange(len(chain) - 8)
        chain[at : at + 4] = [f"y{n}_{k}" for k in range(4)]
        rows.append((len(rows), " ".join(chain)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = expected(rows)
    assert 2 <= len(whole) < 12
    for size in (1 << 20, 20_000, 5_000, 1):
        assert sorted(r.doc_id for r in s.keep_first(df, block_bytes=size).collect()) == whole


def test_links_between_sides_and_trees():
    sets = [s.shingle_set(" ".join("abcdefghij" + x)) for x in ("", "k", "l", "m")]
    sides = np.array([0, 0, 1, 1])
    assert s.similar_links(sets[:1] * 4, 0.8, np.arange(4), sides) == [(0, 2), (0, 3), (1, 2)]
    assert s.similar_links(sets[:1] * 4, 0.8, np.array([0, 1, 0, 0]), sides) == [(1, 2)]


def test_similar_links():
    rng = random.Random(3)
    sets = [s.shingle_set(" ".join(rng.choice("abc") for _ in range(rng.randint(5, 12)))) for _ in range(60)]
    found = s.similar_links(sets, 0.8)
    plain_sets = [set(x.tolist()) for x in sets]
    assert all(similar(plain_sets[a], plain_sets[b]) for a, b in found)
    group = lambda pairs: {frozenset(c) for c in closed(pairs)}
    assert group(found) == group([(a, b) for a in range(60) for b in range(a) if similar(plain_sets[a], plain_sets[b])])


def closed(pairs):
    root = list(range(60))
    for a, b in pairs:
        root = [root[b] if r == root[a] else r for r in root]
    return [[n for n in range(60) if root[n] == r] for r in set(root)]
