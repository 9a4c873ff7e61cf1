"""Exact BM25 top-k: a block-max inverted index for each shard, pruned as in WAND, merged exactly.

Document frequencies, the number of documents and their mean length are counted over all documents
first, so scores are the same in every shard and the shards' results merge exactly. A shard's
documents are laid out by their most frequent term and length, so that neighbours are alike, and cut
into blocks; each posting list of a frequent term keeps its largest impact in each block it stands in.
For a query the postings of its other terms are added up for each document: few, as a pair of texts
shares few of them. The largest sum in a block and the block maxima of the frequent terms, weighted,
are an upper bound of every document in the block. The blocks to visit, the pivots, are those whose
bound can reach the k-th best score so far, which is carried from shard to shard and from level to
level of documents, and the frequent terms' postings, laid out by blocks, are read in these only: the
others are skipped. Queries visit a block together. Unlike WAND's, pivots are blocks and not
documents: with the hundreds of terms of a whole text as query, a pivot document found by the lists'
global maxima would be nearly each one.

score = sum over distinct query terms of ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean length)),
rounded to 6 decimals; equal scores rank by the smaller id. A document that shares a term is found
even if its score rounds to 0. Terms are runs of letters and digits in
lower case, known by their 64-bit hash.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvana.llm.batches import give_back, mapper
from corvana.session import cut

K1, B = 1.2, 0.75
SHARD_DOCS = 8_192
SHARD_POSTINGS = 2_000_000
BLOCK = 64
QUERY_BLOCK, QUERY_BYTES = 16_384, 64 << 20
FIRST, STEP = 4, 8  # shards that are searched first; then this many times as many documents again and again
TOGETHER = (128, 40_000)  # queries, or terms of theirs, that read a block together
FREQUENT, FREQUENT_SHARE = 1536, 48
LAID = 4
READ = 1 << 17
SLACK = 1e-5
TERMS = re.compile(r"[^\W_]+").findall


def vector(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Term hashes in order, their frequencies, and the length in terms."""
    counts = Counter(TERMS(text.lower())) if text else {}
    h = xxhash.xxh3_64_intdigest
    terms = np.fromiter((h(w) for w in counts), np.uint64, len(counts)).view(np.int64)
    tf = np.fromiter(counts.values(), np.int32, len(counts))
    order = np.argsort(terms)
    return terms[order], tf[order], int(tf.sum())


def doc_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [vector(t) for t in batch.column("t").to_pylist()]
    binary = lambda n: pa.array([x[n].tobytes() for x in found], pa.binary())
    return pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x[2] for x in found], pa.int64()), binary(0), binary(1)], names=["id", "length", "terms", "freqs"])


def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df, length) partial counts of doc_rows(); the null term has the number of documents and their length."""
    for batch in batches:
        terms, df = np.unique(np.frombuffer(joined(batch.column("terms")), np.int64), return_counts=True)
        length = int(batch.column("length").to_numpy(zero_copy_only=False).sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *terms.tolist()], pa.int64()), pa.array([batch.num_rows, *df.tolist()], pa.int64()), pa.array([length] + [0] * len(terms), pa.int64())],
            names=["term", "df", "length"],
        )
    batch = terms = df = None  # noqa: F841  what is held can't be given back
    give_back()


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The whole numbers of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Shard:
    """Posting lists by term, those of frequent terms laid out by blocks of documents, with each list's largest impact in each block.

    What LAID documents of a block hold of a frequent term is a row with a place for each document of
    the block; all else are (document, impact) pairs, term by term. Both are in single precision: they
    find the documents, whose own terms give the score in double precision.
    """

    def __init__(self, docs: list[tuple[int, int, bytes, bytes]], mean_length: float):
        terms = [np.frombuffer(t, np.int64) for _, _, t, _ in docs]
        freqs = [np.frombuffer(f, np.int32) for _, _, _, f in docs]
        lead = [int(t[np.argmax(f)]) if len(t) else 0 for t, f in zip(terms, freqs, strict=True)]
        order = sorted(range(len(docs)), key=lambda n: (lead[n], docs[n][1], docs[n][0]))
        self.blocks = -(-len(order) // BLOCK)
        self.ids = np.array([docs[n][0] for n in order], np.int64)
        length = np.array([docs[n][1] for n in order], np.float64)
        self.doc_size = np.array([len(terms[n]) for n in order], np.int64)
        self.doc_start = np.cumsum(self.doc_size) - self.doc_size
        doc = np.repeat(np.arange(len(order), dtype=np.int32), self.doc_size)
        tf = np.concatenate([freqs[n] for n in order]).astype(np.float64)
        every = np.concatenate([terms[n] for n in order])
        impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / mean_length))
        del terms, freqs, tf
        by_term = np.argsort(every, kind="stable")
        every = every[by_term]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        self.terms, size = every[first], np.diff(np.concatenate([first, [len(every)]]))
        term = np.repeat(np.arange(len(first), dtype=np.int32), size)
        self.doc_terms, self.doc_impacts = np.empty(len(term), np.int32), impact
        self.doc_terms[by_term] = term
        del every, term
        doc, impact = doc[by_term], impact[by_term].astype(np.float32)
        del by_term
        frequent = np.flatnonzero(size >= max(2, len(order) // FREQUENT_SHARE))
        frequent = frequent[np.argsort(-size[frequent], kind="stable")[:FREQUENT]]
        self.column = np.full(len(first), -1, np.int32)
        self.column[frequent] = np.arange(len(frequent))
        # an entry for each block that a frequent term stands in
        at = ranges(first[frequent], size[frequent])
        block = np.repeat(np.arange(len(frequent)) * self.blocks, size[frequent]) + doc[at] // BLOCK
        start = np.flatnonzero(np.concatenate([np.ones(min(1, len(at)), bool), block[1:] != block[:-1]]))
        entry_size = np.diff(np.concatenate([start, [len(at)]]))
        laid_out = np.flatnonzero(entry_size >= LAID)
        self.block_max = np.zeros((len(frequent), self.blocks), np.float32)
        rest = np.ones(len(doc), bool)
        if len(laid_out):
            self.block_max.ravel()[block[start[laid_out]]] = np.maximum.reduceat(impact[at], start)[laid_out]
            laid_out = laid_out[np.argsort(block[start[laid_out]] % self.blocks, kind="stable")]
        entry = block[start[laid_out]]
        self.laid_columns, self.laid_ends = entry // self.blocks, np.searchsorted(entry % self.blocks, np.arange(self.blocks + 1)).tolist()
        row, at = np.repeat(np.arange(len(laid_out)), entry_size[laid_out]), at[ranges(start[laid_out], entry_size[laid_out])]
        self.laid = np.zeros((len(laid_out), BLOCK), np.float32)
        self.laid[row, doc[at] % BLOCK] = impact[at]
        self.above = 1 + 2 * (len(frequent) + 8) * 2.0**-24  # a sum in single precision times this isn't below the exact one
        # all other postings, (document, impact), as one binary value for each term: Arrow takes them whole
        rest[at] = False
        postings = np.empty((int(rest.sum()), 2), np.int32)
        postings[:, 0], postings[:, 1] = doc[rest], impact[rest].view(np.int32)
        self.size = np.add.reduceat(rest, first, dtype=np.int64)
        at = np.concatenate([[0], 8 * np.cumsum(self.size)]).astype(np.int32)
        self.postings = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at), pa.py_buffer(postings)])

    def places(self, terms: np.ndarray) -> np.ndarray:
        """The terms' numbers here, or -1."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == terms, at, -1).astype(np.int32)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, heap: list[tuple[float, int]]) -> None:
        """Into the heap of (score, -id), the worst on top, what of this shard belongs to the k best."""
        self.search_all([(terms, weights, heap)], k)

    def search_all(self, queries: list[tuple[np.ndarray, np.ndarray, list[tuple[float, int]]]], k: int, places: np.ndarray | None = None) -> None:
        """search() for (terms, weights, heap) of several queries, which read a block together; each has its own pivots. places: what terms, then numbers in it, stand for."""
        heaps = [h for _, _, h in queries]
        query = np.repeat(np.arange(len(queries)), [len(t) for t, _, _ in queries])
        terms, weights = (np.concatenate([q[n] for q in queries]) for n in (0, 1))
        at = self.places(terms) if places is None else places[terms]
        own = at >= 0
        at, weights, query = at[own], weights[own], query[own]
        ends = np.searchsorted(query, np.arange(len(queries) + 1)).tolist()
        column = self.column[at]
        own = column >= 0
        laid = np.zeros((len(self.block_max), len(queries)), np.float32)
        laid[column[own], query[own]] = weights[own]
        score = self.rest(ends, at, weights)
        bound = (score.reshape(len(queries), self.blocks, BLOCK).max(axis=2) + laid.T @ self.block_max) * self.above
        least = np.array([h[0][0] if len(h) == k else 0.0 for h in heaps])
        pivots = (bound > 0) & (bound >= least[:, None] - SLACK)  # the others hold no term at all, or can't reach the k-th score
        blocks = score.reshape(len(queries), self.blocks, BLOCK)
        for block in np.flatnonzero(pivots.any(axis=0)).tolist():
            rows = slice(self.laid_ends[block], self.laid_ends[block + 1])
            reads, asked = np.flatnonzero(pivots[:, block]), laid[self.laid_columns[rows]]
            if 3 * len(reads) > 2 * len(queries):  # as fast for all
                blocks[:, block] += asked.T @ self.laid[rows]
            elif len(asked):
                blocks[reads, block] += asked[:, reads].T @ self.laid[rows]
        floors = np.nextafter((np.maximum(least - SLACK, 0.0) / self.above).astype(np.float32), np.float32(0))
        found = np.flatnonzero(score > floors[:, None])  # what rounds to 0 shares a term, and counts
        rows, docs = np.divmod(found, score.shape[1])
        for q, good in self.grouped(rows, docs):
            if len(good) > k:  # of these only the k best, and what may be their equal, can stay
                found = score[q, good].astype(np.float64)
                good = good[found * self.above >= np.partition(found, -k)[-k] / self.above - SLACK]
            own, heap = slice(ends[q], ends[q + 1]), heaps[q]
            exact = [self.score(doc, at[own], weights[own]) for doc in good.tolist()]
            for value, found in zip(np.round(exact, 6).tolist(), self.ids[good].tolist(), strict=True):
                if len(heap) < k:
                    heapq.heappush(heap, (value, -found))
                elif (value, -found) > heap[0]:
                    heapq.heapreplace(heap, (value, -found))

    @staticmethod
    def grouped(rows: np.ndarray, docs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(row, its docs) of rows in order."""
        starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(rows)), bool), rows[1:] != rows[:-1]])).tolist()
        for a, b in zip(starts, [*starts[1:], len(rows)], strict=False):
            yield int(rows[a]), docs[a:b]

    def score(self, doc: int, terms: np.ndarray, weights: np.ndarray) -> float:
        """Of one document, in double precision; the terms' numbers are in order, as the document's are."""
        own = slice(self.doc_start[doc], self.doc_start[doc] + self.doc_size[doc])
        has = self.doc_terms[own]
        at = np.searchsorted(has, terms)
        at[at == len(has)] = 0
        same = np.flatnonzero(has[at] == terms)
        return (weights[same] * self.doc_impacts[own][at[same]]).sum()

    def rest(self, ends: list[int], at: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What the postings that aren't laid out add to the documents' scores, a row for each query; its terms are from ends to ends."""
        width, size = self.blocks * BLOCK, self.size[at]
        score = np.zeros((len(ends) - 1, width), np.float32)
        stops, first = np.concatenate([[0], np.cumsum(size)])[ends], 0
        while first < len(score):  # postings of a few queries at a time, so that they stay in the cache
            last = max(first + 1, int(np.searchsorted(stops, stops[first] + READ, "right")) - 1)
            own, (*cuts, read) = slice(ends[first], ends[last]), (stops[first : last + 1] - stops[first]).tolist()
            if read:
                found = np.frombuffer(self.postings.take(pa.array(at[own])).buffers()[2], np.int32, 2 * read).reshape(-1, 2)
                value = found[:, 1].view(np.float32) * np.repeat(weights[own], size[own])
                for q, (a, b) in enumerate(zip(cuts, [*cuts[1:], read], strict=True), first):
                    score[q] = np.bincount(found[a:b, 0], value[a:b], width)
            first = last
        return score


def without_copies(docs: Iterator[tuple[int, int, bytes, bytes]], k: int) -> list[tuple[int, int, bytes, bytes]]:
    """The rows less those with k equals of smaller ids: equals score alike, so the others can't be among any k best."""
    seen, kept = Counter(), []
    for row in sorted(docs, key=lambda r: r[0]):
        same = (xxhash.xxh3_128_digest(row[2]), xxhash.xxh3_128_digest(row[3]))
        seen[same] += 1
        if seen[same] <= k:
            kept.append(row)
    return kept


NUMBERS = {"id": np.int64, "length": np.int64, "floor": np.float64, "floor_id": np.int64}
DOC, QUERY = ("id", "length"), ("id", "floor", "floor_id")


def pack_names(side: str, numbers: tuple[str, ...]) -> list[str]:
    return [f"{side}_{n}" for n in ("pack", *numbers, "size", "terms", "freqs")]


def pack_schema(side: str, numbers: tuple[str, ...]) -> str:
    return ", ".join(f"{n} {'long' if n.endswith('pack') else 'binary'}" for n in pack_names(side, numbers))


def offsets(column: pa.Array) -> np.ndarray:
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)


def joined(column: pa.Array) -> memoryview:
    """The bytes of all values of a column without nulls, one after the other; they lie so already."""
    at = offsets(column)
    return memoryview(column.buffers()[2] or b"")[int(at[0]) : int(at[-1])]


def one_value(data: np.ndarray | bytes) -> pa.Array:
    """A column of the one binary value, not copied."""
    data = pa.py_buffer(data)
    return pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, data.size], np.int32)), data])


def term_counts(batch: pa.RecordBatch) -> np.ndarray:
    return np.diff(offsets(batch.column("terms"))).astype(np.int64) // 8


def packs(rows: int, size: int, side: str, numbers: tuple[str, ...]):
    """For mapInArrow over (*numbers, terms, freqs): up to so many rows, or terms, as one row of bytes. Rows without terms are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, rows_held, terms_held = 0, [], 0, 0

        def pack() -> pa.RecordBatch:
            found = [np.concatenate([x.column(n).to_numpy(zero_copy_only=False) for x in held]).astype(NUMBERS[n]) for n in numbers]
            found.append(np.concatenate([term_counts(x) for x in held]))
            found += [b"".join([joined(x.column(n)) for x in held]) for n in ("terms", "freqs")]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *[one_value(x) for x in found]], names=pack_names(side, numbers))

        for batch in batches:
            counts = term_counts(batch)
            if not counts.all():
                batch = batch.filter(pa.array(counts > 0))
                counts = counts[counts > 0]
            while batch.num_rows:
                full = int(np.searchsorted(np.cumsum(counts) + terms_held, size)) + 1
                n = min(full, rows - rows_held, batch.num_rows)
                held.append(batch.slice(0, n))
                rows_held, terms_held = rows_held + n, terms_held + int(counts[:n].sum())
                batch, counts = batch.slice(n), counts[n:]
                if rows_held >= rows or terms_held >= size:
                    done = pack()
                    number, held, rows_held, terms_held = number + 1, [], 0, 0
                    give_back()
                    yield done
                    done = None
        if held:
            done, held, batch = pack(), [], None
            give_back()
            yield done
        batch = done = None  # what is held can't be given back
        give_back()

    return run


def unpacked(batch: pa.RecordBatch, row: int, side: str, numbers: tuple[str, ...], width: int) -> Iterator[tuple]:
    """The rows of packs(); width: bytes of a frequency."""
    *found, sizes, terms, freqs = (batch.column(n)[row].as_buffer() for n in pack_names(side, numbers)[1:])
    sizes = np.frombuffer(sizes, np.int64)
    ends, terms, freqs = np.cumsum(sizes), memoryview(terms), memoryview(freqs)
    found = [np.frombuffer(x, NUMBERS[n]).tolist() for n, x in zip(numbers, found, strict=True)]
    for *own, a, b in zip(*found, (ends - sizes).tolist(), ends.tolist(), strict=True):
        yield *own, terms[8 * a : 8 * b], freqs[width * a : width * b]


def together(queries: list[tuple], rows: int, terms: int) -> Iterator[list[tuple]]:
    """Runs of the queries of at most so many rows and about so many terms."""
    start, held = 0, 0
    for n, query in enumerate(queries):
        if n > start and (n - start >= rows or held + len(query[0]) > terms):
            yield queries[start:n]
            start, held = n, 0
        held += len(query[0])
    if start < len(queries):
        yield queries[start:]


def query_rows(batch: pa.RecordBatch, row: int, k: int) -> tuple[np.ndarray, list[tuple]]:
    """The terms of a pack, each once, and its queries: (numbers of their terms, weights, heap, id, floor)."""
    rows = list(unpacked(batch, row, "q", QUERY, 8))
    terms, numbers = np.unique(np.concatenate([np.frombuffer(r[3], np.int64) for r in rows]), return_inverse=True)
    numbers, found, start = numbers.astype(np.int32), [], 0
    for i, floor, floor_id, t, w in rows:
        floor, own = (floor, -floor_id), numbers[start : start + len(t) // 8]
        start += len(own)
        found.append((own, np.frombuffer(w).copy(), [floor] * k if floor[0] >= 0 else [], i, floor))
    found.sort(key=lambda q: int(q[0][q[1].argmin()]))  # those with the same most frequent term read much the same blocks
    return terms, found


def searched(k: int, mean_length: float):
    """For mapInArrow over pairs of packs, those of a shard together: what a task's shards have of each query's k best, above its floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed: dict[int, list] = {}
        at, shard = None, None
        for batch in batches:
            for n in range(batch.num_rows):
                doc_pack, query_pack = batch.column("d_pack")[n].as_py(), batch.column("q_pack")[n].as_py()
                if query_pack not in packed:
                    packed[query_pack] = query_rows(batch, n, k)
                if doc_pack != at:
                    at, shard = doc_pack, None
                    shard = Shard(without_copies(unpacked(batch, n, "d", DOC, 4), k), mean_length)
                    give_back()
                terms, own = packed[query_pack]
                places = shard.places(terms)
                for part in together(own, *TOGETHER):
                    shard.search_all([q[:3] for q in part], k, places)
        flat = [(i, -v, s) for _, own in packed.values() for _, _, heap, i, floor in own for s, v in heap if (s, v) > floor]
        packed = shard = batch = own = part = terms = places = None  # noqa: F841  what is held can't be given back
        columns = zip(*flat, strict=True) if flat else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "id", "score"])
        flat = columns = None
        give_back()

    return run


def packed_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, terms, freqs) of (id, pairs of term and weight), by term."""
    for batch in batches:
        sizes = batch.column("pairs").value_lengths().to_numpy(zero_copy_only=False)
        pairs = batch.column("pairs").flatten()
        terms, weights = (pairs.field(n).to_numpy(zero_copy_only=False) for n in ("term", "weight"))
        order = np.lexsort((terms, np.repeat(np.arange(len(sizes)), sizes)))
        at = pa.py_buffer(np.concatenate([np.zeros(1, np.int32), 8 * np.cumsum(sizes)]).astype(np.int32))
        columns = [pa.Array.from_buffers(pa.binary(), len(sizes), [None, at, pa.py_buffer(x[order].astype(t))]) for x, t in ((terms, np.int64), (weights, np.float64))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", "terms", "freqs"])
    batch = pairs = terms = weights = order = columns = None  # noqa: F841  what is held can't be given back
    give_back()


def top_k(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS, query_rows: int = QUERY_BLOCK, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, id_col, score): the k best of all rows for each query row's whole text, itself among them.

    Rows without an id take no part; a null or empty text is a document of length 0 and a query
    without results; documents that share no term with a query aren't returned. Where a query's id
    repeats, its smallest text is the query; as documents all rows count. Only the two columns and
    those of is_query are read. Texts are taken whole, however long: a task holds the terms of at most
    about query_bytes of queries, and of a shard of shard_docs documents or SHARD_POSTINGS postings.

    All documents are searched, in levels: first those of about FIRST shards, dealt by the hash of
    their ids, then each time those up to STEP times as many. The k-th best so far is a query's floor in
    the next level, whose tasks return only what is better: about k * STEP rows a query and level are
    expected, however many tasks there are.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where("id is not null")
    schema = "id long, length long, terms binary, freqs binary"
    docs = cut(rows.select("id", "t").mapInArrow(mapper(doc_rows, "t"), schema))
    df_rows = docs.select("length", "terms").mapInArrow(frequencies, "term long, df long, length long")
    counted = cut(df_rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length")))
    total = counted.where("term is null").first()
    n, length = (total["df"], total["length"]) if total else (0, 0)
    mean_length = max(length / n, 1e-9) if n else 1.0

    asked = rows.where("is_query").groupBy("id").agg(F.min("t").alias("t"))

    def query_terms(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [vector(t)[0] for t in batch.column("t").to_pylist()]
        ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), [len(x) for x in found])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], names=["id", "term"])

    weight = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = asked.mapInArrow(mapper(query_terms, "t"), "id long, term long").join(counted.select("term", weight.alias("weight")), "term")
    queries = weighted.groupBy("id").agg(F.collect_list(F.struct("term", "weight")).alias("pairs"))  # bounded by a text's distinct terms
    queries = cut(queries.mapInArrow(packed_queries, "id long, terms binary, freqs binary"))
    held = queries.agg(F.count("*").alias("n"), F.sum(2 * F.octet_length("terms")).alias("bytes")).first()
    q_blocks = max(1, -(-held["n"] // query_rows), -(-(held["bytes"] or 0) // query_bytes))
    levels = 0
    while n > FIRST * shard_docs * STEP**levels:
        levels += 1
    dealt, order = F.pmod(F.xxhash64("id"), F.lit(STEP**levels)), Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = None
    for level in range(levels + 1):
        part = docs.where(dealt.between(STEP ** (level - 1) if level else 0, STEP**level - 1)) if levels else docs
        shards = max(1, n // STEP ** (levels - level) // shard_docs)
        # the last level has nearly all documents and isn't shuffled; those before have an eighth at most
        doc_packs = (part.coalesce(shards) if level == levels else part.repartition(shards if level else FIRST)).mapInArrow(packs(shard_docs, SHARD_POSTINGS, "d", DOC), pack_schema("d", DOC))
        if ranked is None:
            asked_rows = queries.withColumns({"floor": F.lit(-1.0), "floor_id": F.lit(0).cast("long")})
        else:
            ranked = cut(ranked)
            floors = ranked.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"), F.col("id").alias("floor_id"))
            asked_rows = queries.join(floors, "id", "left").fillna({"floor": -1.0, "floor_id": 0})
        query_packs = cut(asked_rows.repartition(q_blocks).mapInArrow(packs(query_rows, max(1, query_bytes // 16), "q", QUERY), pack_schema("q", QUERY)))
        pairs = (doc_packs if level == levels else cut(doc_packs)).hint("shuffle_replicate_nl").crossJoin(query_packs)  # a task for each two partitions, without a shuffle
        best = pairs.mapInArrow(searched(k, mean_length), "query_id long, id long, score double")
        if ranked is not None:
            best = best.union(ranked.select("query_id", "id", "score"))
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def oracle(k: int = 10, step: int = 50) -> str:
    """DuckDB SQL for top_k() over documents with every id divisible by step as query."""
    return f"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM documents WHERE doc_id IS NOT NULL
), tf AS (
  SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term
), lengths AS (
  SELECT d.doc_id, coalesce(sum(tf), 0) AS length FROM documents d LEFT JOIN tf USING (doc_id) WHERE d.doc_id IS NOT NULL GROUP BY d.doc_id
), df AS (
  SELECT term, count(*) AS df FROM tf GROUP BY term
), whole AS (
  SELECT count(*) AS n, sum(length) / count(*) AS mean FROM lengths
), scores AS (
  SELECT q.doc_id AS query_id, t.doc_id,
    round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * t.tf * {K1 + 1} / (t.tf + {K1} * (1 - {B} + {B} * length / mean))), 6) AS score
  FROM tf q JOIN tf t USING (term) JOIN df USING (term) JOIN lengths l ON l.doc_id = t.doc_id, whole
  WHERE q.doc_id % {step} = 0 GROUP BY q.doc_id, t.doc_id
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM scores
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= {k}
"""
