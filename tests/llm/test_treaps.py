"""Rankings against DuckDB and against full scoring; the treaps' two orders."""

import random

import duckdb
import numpy as np
import pytest

from corvana.llm import treaps as s


def sql(documents, benchmark):
    con = duckdb.connect()
    frames = {"documents": documents.toPandas(), "benchmark": benchmark.toPandas()}
    for name, frame in frames.items():
        con.register(name, frame)
    return sorted(tuple(r) for r in con.execute(s.oracle()).fetchall())


def rows(df):
    return sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def drawn(spark):
    rng = random.Random(4)
    words = [f"w{n}" for n in range(60)] + ["É", "éa", "ÀB", "x_y", "Mixed", "mixed"]
    docs = [(n, " ".join(rng.choice(words[: rng.choice((5, 20, 66))]) for _ in range(rng.randint(0, 40)))) for n in range(400)]
    docs += [(500 + n, "w1 w2 copy,copy") for n in range(150)]  # equal scores, more than are returned
    docs += [(400, None), (450, "Solo!"), (401, docs[0][1]), (402, docs[0][1])]
    items = [(n, " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))) for n in range(30)]
    items += [(30, "copy"), (31, None), (32, "absent terms"), (33, "w1 w1 w1 w59"), (34, "solo éA")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_against_sql(drawn):
    docs, items = drawn
    assert rows(s.ranked(docs, items)) == sql(docs, items)


@pytest.mark.parametrize("sizes", [{"shard_docs": 7}, {"shard_docs": 40, "query_rows": 9}, {"shard_postings": 50, "vocabulary": 3}, {"query_terms": 60}])
def test_sizes_change_nothing(drawn, sizes):
    """Several shards to a task, several blocks of queries, more asked terms than texts are sifted by."""
    docs, items = drawn
    assert rows(s.ranked(docs.repartition(3), items, **sizes)) == sql(docs, items)


def test_pruned_equals_full():
    rng = np.random.default_rng(1)
    docs = []
    for n in range(3000):
        terms = np.unique(rng.zipf(1.3, 60) % 5000).astype(np.int64)
        docs.append((n * 3, terms, rng.integers(1, 1_000_000, len(terms)) if n % 3 else np.full(len(terms), 500)))
    row = {n: x.astype(t).tobytes() for n, x, t in zip(s.INDEX, s.built(docs), s.INDEX_TYPES, strict=True)}
    shard, scored = s.Shard(**row), []
    for _ in range(20):
        terms = np.unique(rng.zipf(1.3, 12) % 5000).astype(np.int64)
        weights = rng.integers(1, 9000, len(terms))
        heap = []
        scored.append(shard.search(terms, weights, 10, heap))
        full = [(int((weights[np.searchsorted(terms, own[both])] * impact[both]).sum()), -i) for i, own, impact in docs if (both := np.isin(own, terms)).any()]
        assert sorted(heap, reverse=True) == sorted((x for x in full if x[0] > 0), reverse=True)[:10]
    assert np.mean(scored) < 1500  # most documents are pruned unseen


@pytest.mark.parametrize("impacts", ["drawn", "equal", "rising", "falling"])
def test_treap_orders(impacts):
    """In order the nodes are a list's documents; no node has a larger impact than its parent; equal impacts don't make a chain."""
    n = 2000
    value = {"drawn": np.random.default_rng(2).integers(1, 50, n), "equal": np.full(n, 7), "rising": np.arange(1, n + 1), "falling": np.arange(n, 0, -1)}[impacts]
    docs = [(i, np.array([4, 9]), np.array([value[i], 1])) for i in range(n)]
    ids, terms, sizes, doc, impact, left, right, roots = s.built(docs)
    assert terms.tolist() == [4, 9] and sizes.tolist() == [n, n] and ids.tolist() == list(range(n))
    for root in roots.tolist():
        order, depth, stack, at, level = [], 0, [], root, 0
        while stack or at != 2 * n:
            while at != 2 * n:
                for child in (left[at], right[at]):
                    assert child == 2 * n or impact[child] <= impact[at]
                stack.append((at, level))
                depth = max(depth, level)
                at, level = left[at], level + 1
            at, level = stack.pop()
            order.append(int(doc[at]))
            at, level = right[at], level + 1
        assert order == list(range(n))
        if root >= n or impacts in ("drawn", "equal"):
            assert depth < 60


def test_text_parts():
    text = "Ab, cdÉf  12x é" * 50
    whole = [w for part in s.terms_of(text.encode()) for w in part]
    for size in (1, 3, 16, 100):
        assert [w for part in s.terms_of(text.encode(), size) for w in part] == whole
    assert whole[:4] == [b"ab", "cdÉf".encode(), b"12x", "éab".encode()]


def test_rows(spark):
    docs = spark.createDataFrame([(0, "a b", 1), (0, "a b", 1), (1, "b c", 1), (None, "a b", 1), (2, None, 1), (3, "", 1), (4, "d " * 30_000 + "c", 1)], "doc_id long, text string, score int")
    items = spark.createDataFrame([(7, "A c", 1), (7, "z", 1), (None, "a", 1), (8, "", 1)], "item_id long, text string, rank int")
    got = rows(s.ranked(docs, items))
    assert [r[:3] for r in got] == [(7, 1, 0), (7, 2, 0), (7, 3, 1), (7, 4, 4)] and got[0][3] == got[1][3]
    assert s.ranked(docs.limit(0), items).count() == 0 and s.ranked(docs, items.limit(0)).count() == 0
