"""Rankings against DuckDB, and pruning against full scoring."""

import random

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corvana.llm import search as s


def test_against_sql(spark):
    rng = random.Random(4)
    words = [f"w{n}" for n in range(60)]
    rows = [(n, " ".join(rng.choice(words[: rng.choice((5, 20, 60))]) for _ in range(rng.randint(0, 40)))) for n in range(400)]
    rows += [(400, None), (450, "Solo"), (401, rows[0][1]), (402, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    frame = df.toPandas()
    con.register("documents", frame)
    expected = sorted(con.execute(s.oracle()).fetchall())
    assert sorted(tuple(r) for r in s.top_k(df, F.col("doc_id") % 50 == 0).collect()) == expected
    # several shards to a tile, several tiles, several blocks of queries by number and by bytes; a shard of one block and of many
    for sizes in ({"shard_docs": 30}, {"shard_docs": 90, "query_rows": 3}, {"shard_docs": 70, "query_bytes": 500}):
        assert sorted(tuple(r) for r in s.top_k(df.repartition(5), F.col("doc_id") % 50 == 0, **sizes).collect()) == expected


def test_long_texts(spark):
    rng = random.Random(6)
    rows = [(n, " ".join(f"w{rng.randrange(3000)}" for _ in range(20_000 if n % 50 == 0 else 300))) for n in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    frame = df.toPandas()
    con.register("documents", frame)
    expected = sorted(con.execute(s.oracle()).fetchall())
    assert sorted(tuple(r) for r in s.top_k(df, F.col("doc_id") % 50 == 0, shard_docs=50, query_bytes=40_000).collect()) == expected


def test_pruned_equals_full():
    rng = np.random.default_rng(1)
    docs = []
    for n in range(3000):
        terms = np.unique(rng.zipf(1.3, 60) % 5000).astype(np.int64)
        tf = rng.integers(1, 5, len(terms)).astype(np.int32)
        docs.append((n, int(tf.sum()), terms.tobytes(), tf.tobytes()))
    shard = s.Shard(docs, 100.0)
    for _ in range(20):
        terms = np.unique(rng.zipf(1.3, 40) % 5000).astype(np.int64)
        weights = rng.random(len(terms)) * 5
        heap = []
        shard.search(terms, weights, 10, heap)
        full = np.zeros(len(docs))
        for n, (_, length, own, tf) in enumerate(docs):
            own, tf = np.frombuffer(own, np.int64), np.frombuffer(tf, np.int32).astype(float)
            both = np.isin(own, terms)
            impact = tf[both] * (s.K1 + 1) / (tf[both] + s.K1 * (1 - s.B + s.B * length / 100.0))
            full[n] = (weights[np.searchsorted(terms, own[both])] * impact).sum()
        full = np.round(full, 6)
        best = sorted(zip((-full).tolist(), range(len(docs)), strict=True))[:10]
        assert sorted(heap, reverse=True) == [(-x, -i) for x, i in best]


def test_scores_that_round_to_zero_count():
    rng = np.random.default_rng(2)
    docs, holds = [], []
    for n in range(400):
        terms = np.unique(rng.integers(1, 30, 3)).astype(np.int64) if n % 3 else np.array([50 + n], np.int64)
        holds.append(7 in terms)
        docs.append((n, len(terms), terms.tobytes(), np.ones(len(terms), np.int32).tobytes()))
    for part in (docs, docs[:40]):
        heap = []
        s.Shard(part, 3.0).search(np.array([7]), np.array([1e-9]), 10, heap)
        assert sorted(heap, reverse=True) == [(0.0, -n) for n in range(len(part)) if holds[n]][:10]
    heap = []
    s.Shard(docs, 3.0).search(np.array([7, 49]), np.array([1e-9, 1.0]), 1000, heap)
    assert len(heap) == sum(holds)


def test_rows(spark):
    df = spark.createDataFrame([(0, "a b", 1), (0, "a b", 1), (1, "b c", 1), (None, "a b", 1), (50, None, 1)], "doc_id long, text string, score int")
    got = sorted((r.query_id, r["rank"], r.doc_id) for r in s.top_k(df, F.col("doc_id") % 50 == 0).collect())
    assert got == [(0, 1, 0), (0, 2, 0), (0, 3, 1)]
    assert s.top_k(df.limit(0), F.col("doc_id") % 50 == 0).count() == 0


def test_no_document_is_shuffled(spark):
    """Neither documents go once for each block of queries through a shuffle, nor queries once for each block of documents."""
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("w"), F.col("id") % 7, F.col("id") % 11).alias("text"))
    found = s.top_k(df, F.col("doc_id") % 50 == 0, shard_docs=50, query_rows=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan
    assert not any(name in line for line in plan.splitlines() if "Exchange" in line for name in ("terms", "qb", "db"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, s.top_k(df, F.col("doc_id") % 50 == 0).collect()))


def test_tasks_return_what_is_above_the_floor(spark, monkeypatch):
    """Rows that the search makes follow the queries, not the queries times the tasks; copies and ties stay as SQL has them."""
    rng = random.Random(8)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(rng.randint(3, 40))) for _ in range(1500)]
    rows = [(n, texts[n % 1500] if n % 3 else texts[7]) for n in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(64).cache()
    con = duckdb.connect()
    frame = df.toPandas()
    con.register("documents", frame)
    expected = sorted(con.execute(s.oracle()).fetchall())
    made, searched = spark.sparkContext.accumulator(0), s.searched

    def counted(k, mean_length):
        run = searched(k, mean_length)

        def count(batches):
            for batch in run(batches):
                made.add(batch.num_rows)
                yield batch

        return count

    monkeypatch.setattr(s, "searched", counted)
    found = s.top_k(df, F.col("doc_id") % 50 == 0, shard_docs=40)
    assert sorted(tuple(r) for r in found.collect()) == expected
    assert 80 * 10 <= made.value < 80 * 10 * 30  # of the 64 tasks' 80 * 10 * 64


def test_copies_beyond_k_leave_the_shard():
    rows = [(n, 2, b"terms", b"freqs" if n % 2 else b"other") for n in range(9, -1, -1)]
    assert [r[0] for r in s.without_copies(rows, 3)] == [0, 1, 2, 3, 4, 5]


def test_queries_together_equal_alone():
    rng = np.random.default_rng(5)
    docs = []
    for n in range(2000):
        terms = np.unique(rng.zipf(1.2, 80) % 3000 + 3000 * (n % 3)).astype(np.int64)
        docs.append((n, len(terms), terms.tobytes(), rng.integers(1, 4, len(terms)).astype(np.int32).tobytes()))
    shard = s.Shard(docs, 60.0)
    queries = [(np.frombuffer(docs[n][2], np.int64), rng.random(len(docs[n][2]) // 8) * 5) for n in range(0, 2000, 50)]
    queries += [(np.zeros(0, np.int64), np.zeros(0)), (np.array([-5]), np.ones(1))]
    both = [(t, w, []) for t, w in queries]
    for part in s.together(both, 16, 500):
        shard.search_all(part, 10)
    for terms, weights, heap in both:
        alone = []
        shard.search(terms, weights, 10, alone)
        assert sorted(heap) == sorted(alone)
    assert sum(len(p) for p in s.together(both, 16, 500)) == len(both)


def test_work_of_a_shard(monkeypatch):
    """A pack's terms are looked up once in a shard, not by each run of queries; a posting is laid out or in its term's list, and only full rows are laid out."""
    rng = np.random.default_rng(9)
    docs, queries = [], []
    for n in range(700):
        terms = np.unique(rng.zipf(1.3, 50) % 2000).astype(np.int64)
        docs.append((n, len(terms), terms.tobytes(), np.ones(len(terms), np.int32).tobytes()))
        queries.append((n, -1.0, 0, terms.tobytes(), (1 + terms % 7).astype(float).tobytes()))
    shard = s.Shard(docs, 30.0)
    assert (shard.laid > 0).sum(axis=1).min() >= s.LAID
    assert (shard.laid > 0).sum() + shard.size.sum() == sum(d[1] for d in docs)

    def pack(rows, names, side, numbers):
        columns = [pa.array(list(x), pa.binary() if isinstance(x[0], bytes) else None) for x in zip(*rows, strict=True)]
        return next(s.packs(10_000, 1 << 30, side, numbers)(iter([pa.RecordBatch.from_arrays(columns, names=names)])))

    d = pack(docs, ["id", "length", "terms", "freqs"], "d", s.DOC)
    q = pack(queries, ["id", "floor", "floor_id", "terms", "freqs"], "q", s.QUERY)
    looked, places = [], s.Shard.places
    monkeypatch.setattr(s.Shard, "places", lambda self, terms: looked.append(len(terms)) or places(self, terms))
    (found,) = s.searched(10, 30.0)(iter([pa.RecordBatch.from_arrays([*d.columns, *q.columns], names=[*d.schema.names, *q.schema.names])]))
    assert looked == [len(set().union(*(np.frombuffer(x[2], np.int64).tolist() for x in docs)))]
    got = {}
    for r in found.to_pylist():
        got.setdefault(r["query_id"], []).append((r["score"], -r["id"]))
    for n, _, _, terms, weights in queries[::35]:
        heap = []
        shard.search(np.frombuffer(terms, np.int64), np.frombuffer(weights), 10, heap)
        assert sorted(got[n]) == sorted(heap)
