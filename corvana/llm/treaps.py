"""Ranked lexical search over inverted treaps.

1. One pass over all texts keeps each document's number of terms and the frequencies of the terms that any
   query asks for, as a small table. Document counts, lengths and document frequencies are taken over all documents.
2. Neighbouring documents form shards, without a shuffle. In a shard each term's postings are a treap:
   a search tree by document, a heap by impact (the integer saturation of frequency and length, which
   needs no query). Equal impacts are ordered by a mixed number of the document, so that copies don't
   make a chain. The index is written once, a row for each shard.
3. A query goes down the treaps of its terms together. Its states are intervals of documents with, for each
   term, the highest node inside: by heap order the largest impact there. The weighted sum of these
   maxima bounds every document of the interval; intervals whose bound can't reach the k-th best
   score so far are pruned with all their subtrees. Of the others those of highest bound are split at the
   root that adds most: that document is looked up in all treaps and scored, and the nodes of both sides are found by
   walking down. The k-th best score is carried from shard to shard of a task; the tasks' results are
   merged exactly.

Queries are answered in blocks of bounded size, all on the same index.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvana.llm.batches import mapper
from corvana.session import cut

SHARD_DOCS, SHARD_POSTINGS = 65_536, 1 << 20
QUERY_ROWS, QUERY_TERMS = 16_384, 1 << 20  # of a block of queries
VOCABULARY = 200_000  # asked terms by which the texts' are sifted; beyond, every term is kept
TEXT_PART = 4 << 20
FIRST_SPLIT, SHARE_SPLIT = 32, 4  # states that are split at once: so many at least, of all a share
UNIT, LENGTH_SHARE = 1_000_000_000, 75

#: Letters and digits in lower case and all bytes beyond ASCII stay; the others separate terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes, part: int = TEXT_PART) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of bounded size."""
    folded, at = text.translate(FOLD), 0
    while at < len(folded):
        end = at + part
        if end < len(folded):
            end = folded.rfind(b" ", at, end) if folded.rfind(b" ", at, end) > at else folded.find(b" ", end)
            end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def vector(text: bytes | None, asked: dict[bytes, int] | None) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of terms, and hashes and frequencies of those asked for (None: of all)."""
    n, counts = 0, Counter()
    for words in terms_of(text or b""):
        n += len(words)
        counts.update(words if asked is None else [w for w in words if w in asked])
    h = xxhash.xxh3_64_intdigest
    terms = np.fromiter((h(w) if asked is None else asked[w] for w in counts), np.uint64, len(counts)).view(np.int64)
    tf = np.fromiter(counts.values(), np.int64, len(counts))
    order = np.argsort(terms)
    return n, terms[order], tf[order]


VECTORS = "id long, n long, terms binary, freqs binary"


def vectors(asked: dict[bytes, int] | None):
    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [vector(t, asked) for t in batch.column("t").cast(pa.large_binary()).to_pylist()]
        binary = lambda k: pa.array([x[k].tobytes() for x in found], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x[0] for x in found], pa.int64()), binary(1), binary(2)], names=["id", "n", "terms", "freqs"])

    return mapper(kernel, "t")


def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) counts of each batch."""
    for batch in batches:
        terms, df = np.unique(np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(df.astype(np.int64))], names=["term", "df"])


def nearest_greater(rank: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each entry the last one before it in its list that has a larger rank, -1 if none; first: where lists begin."""
    at = np.arange(len(rank)) - 1
    at[first] = -1
    left = np.flatnonzero(at >= 0)
    while len(left := left[(at[left] >= 0) & (rank[at[left]] < rank[left])]):
        at[left] = at[at[left]]
    return at


INDEX = ("ids", "terms", "sizes", "docs", "impacts", "left", "right", "roots")
INDEX_SCHEMA = ", ".join(f"{n} binary" for n in INDEX)
INDEX_TYPES = (np.int64, np.int64, np.int32, np.int32, np.int32, np.int32, np.int32, np.int32)


def built(docs: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """The arrays of INDEX from (id, terms, impacts) of each document. Nodes are numbered by term, then document; the number of all nodes stands for none."""
    docs = sorted(docs, key=lambda d: d[0])
    every = np.concatenate([d[1] for d in docs])
    doc = np.repeat(np.arange(len(docs)), [len(d[1]) for d in docs])
    impact = np.concatenate([d[2] for d in docs])
    order = np.argsort(every, kind="stable")
    every, doc, impact = every[order], doc[order], impact[order]
    n = len(every)
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if n else np.zeros(0, np.int64)
    last = np.concatenate([first[1:], [n]])[: len(first)] - 1
    rank = impact.astype(np.int64) << 32 | (doc * 2_654_435_761 & 0xFFFFFFFF)  # an odd factor: no two documents mix to one number
    before = nearest_greater(rank, first)
    after = n - 1 - nearest_greater(rank[::-1], n - 1 - last)[::-1]  # n: none
    over = np.append(rank, np.iinfo(np.int64).max)
    by_left = over[np.where(before < 0, n, before)] < over[after]  # the smaller of the two greater neighbours is the parent
    left, right, node = np.full(n + 1, n), np.full(n + 1, n), np.arange(n)
    is_root = (before < 0) & (after == n)
    right[before[by_left & ~is_root]] = node[by_left & ~is_root]
    left[after[~by_left & ~is_root]] = node[~by_left & ~is_root]
    ids = np.array([d[0] for d in docs], np.int64)
    return ids, every[first], last - first + 1, doc, impact, left, right, node[is_root]


def shards(n: int, length: int, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS):
    """For mapInArrow over VECTORS: a row of the index for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, held = [], 0

        def row() -> pa.RecordBatch:
            arrays = [pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in zip(built(docs), INDEX_TYPES, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=list(INDEX))

        for batch in batches:
            for i, size, terms, freqs in zip(*(batch.column(k).to_pylist() for k in ("id", "n", "terms", "freqs")), strict=True):
                if not terms:
                    continue
                tf = np.frombuffer(freqs, np.int64)
                long = 100 - LENGTH_SHARE + LENGTH_SHARE * size * n // length
                docs.append((i, np.frombuffer(terms, np.int64), UNIT * tf // (1000 * tf + 8 * long)))
                held += len(tf)
                if len(docs) >= shard_docs or held >= shard_postings:
                    yield row()
                    docs, held = [], 0
        if docs:
            yield row()

    return run


class Shard:
    def __init__(self, **row: bytes):
        ids, terms, sizes, docs, impacts, left, right, roots = (np.frombuffer(row[n], t) for n, t in zip(INDEX, INDEX_TYPES, strict=True))
        self.ids, self.terms, self.left, self.right, self.roots = ids, terms, left, right, roots
        self.none = len(docs)
        self.doc, self.impact = np.append(docs, -1), np.append(impacts, 0).astype(np.int64)

    def within(self, node: np.ndarray, low: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The highest node at or under each that lies in [low, end): the one of largest impact there."""
        node = node.copy()
        left = np.flatnonzero(node != self.none)
        while len(left):
            at = node[left]
            doc = self.doc[at]
            over, under = doc >= end[left], doc < low[left]
            at = np.where(over, self.left[at], np.where(under, self.right[at], at))
            node[left] = at
            left = left[(over | under) & (at != self.none)]
        return node

    def found(self, node: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The node of the document at or under each."""
        node = node.copy()
        left = np.flatnonzero(node != self.none)
        while len(left):
            at = node[left]
            own, sought = self.doc[at], doc[left]
            at = np.where(own > sought, self.left[at], np.where(own < sought, self.right[at], at))
            node[left] = at
            left = left[(own != sought) & (at != self.none)]
        return node

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, heap: list[tuple[int, int]]) -> int:
        """Into the heap of (score, -id), the worst on top, what of this shard belongs to the k best; the number of documents scored."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        own = self.terms[at] == terms
        at, weights = at[own], weights[own]
        n, scored = len(at), 0
        low, end, node = np.zeros(1, np.int64), np.full(1, len(self.ids)), self.roots[at].reshape(1, n)
        bound = self.impact[node] @ weights
        while True:
            least = heap[0][0] if len(heap) == k else 1
            if not (alive := bound >= least).all():
                low, end, node, bound = low[alive], end[alive], node[alive], bound[alive]
            if not len(bound):
                return scored
            size = min(len(bound), max(FIRST_SPLIT, len(bound) // SHARE_SPLIT))
            best = np.argpartition(-bound, size - 1)[:size]
            top, start, stop = node[best], low[best], end[best]
            pivot = self.doc[top[np.arange(size), np.argmax(self.impact[top] * weights, axis=1)]].astype(np.int64)
            score = self.impact[self.found(top.ravel(), np.repeat(pivot, n))].reshape(size, n) @ weights
            scored += size
            good = np.flatnonzero(score >= least)
            if len(good) > k:  # of these only the k best, and their equals, can stay
                good = good[score[good] >= np.partition(score[good], -k)[-k]]
            for i in good.tolist():
                hit = (int(score[i]), -int(self.ids[pivot[i]]))
                if len(heap) < k:
                    heapq.heappush(heap, hit)
                elif hit > heap[0]:
                    heapq.heapreplace(heap, hit)
            rest = np.ones(len(bound), bool)
            rest[best] = False
            low2, end2 = np.concatenate([start, pivot + 1]), np.concatenate([pivot, stop])
            open_ = low2 < end2
            low2, end2, both = low2[open_], end2[open_], np.concatenate([top, top])[open_]
            both = self.within(both.ravel(), np.repeat(low2, n), np.repeat(end2, n)).reshape(len(low2), n)
            bound2 = self.impact[both] @ weights
            low, end, node, bound = (np.concatenate(x) for x in ((low[rest], low2), (end[rest], end2), (node[rest], both), (bound[rest], bound2)))


def searched(k: int, queries: list[tuple[int, np.ndarray, np.ndarray]]):
    """For mapInArrow over the index: the k best of a task's shards for each query (id, terms, weights)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[tuple[int, int]]] = [[] for _ in queries]
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(**row)
                for (_, terms, weights), heap in zip(queries, heaps, strict=True):
                    shard.search(terms, weights, k, heap)
        flat = [(q[0], -i, s) for q, heap in zip(queries, heaps, strict=True) for s, i in heap]
        columns = zip(*flat, strict=True) if flat else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in columns], names=["item_id", "id", "score"])

    return run


def ranked(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text",
    query_rows: int = QUERY_ROWS, query_terms: int = QUERY_TERMS, vocabulary: int = VOCABULARY, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS,
) -> DataFrame:
    """(item_col, rank, id_col, score): the k best documents with a score above 0 for each item, equal scores by the smaller id.

    Rows without an id take no part, neither as items nor as documents. A null or empty text has no
    term: as a document it isn't counted, as an item it has no rows. Where an item's id repeats, its smallest text is
    the query; documents that repeat an id count each, those that repeat a text too. Texts are taken whole, in parts of
    bounded size. Terms are known by their 64-bit hash. Only the id and text columns are read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where("id is not null")
    asked = items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("t")).where("item is not null").groupBy("item").agg(F.min("t").alias("t"))

    def query_terms_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [Counter(w for words in terms_of(t or b"") for w in words) for t in batch.column("t").cast(pa.large_binary()).to_pylist()]
        words = [w for x in found for w in x]
        item = np.repeat(batch.column("item").to_numpy(zero_copy_only=False), [len(x) for x in found])
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(words, pa.binary()), pa.array(hashes), pa.array([c for x in found for c in x.values()], pa.int64())], names=["item", "word", "term", "times"])

    wanted = cut(asked.mapInArrow(mapper(query_terms_of, "t"), "item long, word binary, term long, times long"))
    words = wanted.select("word", "term").distinct().limit(vocabulary + 1).collect()
    known = {bytes(r["word"]): r["term"] & 0xFFFFFFFFFFFFFFFF for r in words} if len(words) <= vocabulary else None
    held = cut(rows.mapInArrow(vectors(known), VECTORS))
    total = held.where("n > 0").agg(F.count("*").alias("n"), F.sum("n").alias("length")).first()
    n, length = total["n"], total["length"] or 1

    df = held.select("terms").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1)))
    weighted = cut(wanted.join(df, "term").select("item", "term", (weight * F.col("times")).alias("weight")).where("weight > 0"))
    size = weighted.agg(F.count("*").alias("terms"), F.countDistinct("item").alias("rows")).first()
    blocks = max(1, -(-size["rows"] // query_rows), -(-size["terms"] // query_terms))
    index = cut(held.select("id", "n", "terms", "freqs").mapInArrow(shards(n, length, shard_docs, shard_postings), INDEX_SCHEMA))

    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "id")
    best = None
    for block in range(blocks):
        own = weighted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).groupBy("item").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("pairs"))
        queries = [(r["item"], np.array([p["term"] for p in r["pairs"]], np.int64), np.array([p["weight"] for p in r["pairs"]], np.int64)) for r in own.collect()]  # a block is bounded
        found = index.mapInArrow(searched(k, queries), "item_id long, id long, score long").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = found if best is None else cut(best).unionByName(cut(found))
    return best.select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def oracle(k: int = 10) -> str:
    """DuckDB SQL for ranked() over documents and benchmark."""
    return f"""
WITH words AS (
  SELECT kind, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL
    UNION ALL SELECT 'q', item_id, min(text) FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id)
), tf AS (
  SELECT id, term, count(*) AS tf FROM words WHERE kind = 'd' GROUP BY ALL
), lengths AS (
  SELECT id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY id
), whole AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM lengths
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term, docs
), scores AS (
  SELECT q.id AS item_id, t.id AS doc_id,
    CAST(sum(q.times * w * (({UNIT} * t.tf) // (1000 * t.tf + 8 * ({100 - LENGTH_SHARE} + ({LENGTH_SHARE} * n * docs) // length)))) AS BIGINT) AS score
  FROM (SELECT id, term, count(*) AS times FROM words WHERE kind = 'q' GROUP BY ALL) q
    JOIN tf t USING (term) JOIN weights USING (term) JOIN lengths l ON l.id = t.id, whole
  GROUP BY q.id, t.id
)
SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= {k}
"""
