"""Nearest neighbours by cosine: a block matrix join with int8 product tiles.

Vectors are packed into chunks that hold, besides the original components, the unit vectors rounded
to int8 with one scale each, and the norm of the rounding error. Query chunks and candidate chunks
meet in a grid of blocks; in each tile the product of the int8 matrices gives every pair's cosine up
to a bound that follows from the two errors: |<a,b> - <a',b'>| <= |a-a'| + |a'||b-b'|. Pairs whose
upper bound can't reach the k-th best so far are dropped; the others are recomputed from the
original vectors in double precision and merged by heaps, first within the tile's block, then over
the blocks. Nothing that could be among the k nearest is dropped, so recall is 1 and no index is
fitted. The int8 product runs in float32, which holds sums of up to 1,040 products exactly; longer
vectors are multiplied in float64.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 16_384
CHUNK = 4_096
TILE_QUERIES = 1_024
EXACT_PAIRS = 1 << 18
SLACK = 1e-6

PACKED = "dim int, ids binary, codes binary, scale binary, error binary, origin binary"
PACKED_SCHEMA = pa.schema([("dim", pa.int32()), *((n, pa.binary()) for n in ("ids", "codes", "scale", "error", "origin"))])


def fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise dot products in double precision, summed from the first component to the last."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def packed(ids: np.ndarray, origin: np.ndarray) -> dict:
    norm = np.sqrt(fold(origin, origin))
    unit = origin / norm[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1))
    return {"dim": origin.shape[1], "ids": ids.tobytes(), "codes": codes.tobytes(), "scale": scale.tobytes(), "error": error.tobytes(), "origin": origin.tobytes()}


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of at most CHUNK usable vectors of one dimension."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            lists = part.column("v")
            sizes = np.diff(lists.offsets.to_numpy())
            ids = part.column("id").to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
            rows = []
            for dim in sorted(set(sizes.tolist())):
                own = np.flatnonzero(sizes == dim)
                origin = flat[starts[own][:, None] + np.arange(dim)]
                with np.errstate(over="ignore"):
                    norm = fold(origin, origin)
                good = np.isfinite(norm) & (norm > 0)
                if good.any():
                    rows.append(packed(ids[own][good].astype(np.int64), origin[good]))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=PACKED_SCHEMA)


class Chunk:
    def __init__(self, dim: int, ids: bytes, codes: bytes, scale: bytes, error: bytes, origin: bytes):
        self.dim, self.ids = dim, np.frombuffer(ids, np.int64)
        kind = np.float32 if dim <= 1040 else np.float64
        self.codes = np.frombuffer(codes, np.int8).reshape(-1, dim).astype(kind)
        self.scale, self.error = np.frombuffer(scale), np.frombuffer(error)
        self.origin = np.frombuffer(origin).reshape(-1, dim)
        self.norm = np.sqrt(fold(self.origin, self.origin))


class Block:
    """The queries of one block, each with a heap of its k best (score, -id), the worst on top."""

    def __init__(self, k: int):
        self.k, self.queries, self.heaps = k, [], []

    def load(self, chunk: Chunk) -> None:
        self.queries.append(chunk)
        self.heaps.append([[] for _ in chunk.ids])

    def meet(self, cand: Chunk) -> None:
        for chunk, heaps in zip(self.queries, self.heaps, strict=True):
            if chunk.dim == cand.dim:
                for at in range(0, len(chunk.ids), TILE_QUERIES):
                    self.tile(chunk, heaps, slice(at, at + TILE_QUERIES), cand)

    def tile(self, chunk: Chunk, heaps: list, rows: slice, cand: Chunk) -> None:
        k, ids = self.k, chunk.ids[rows]
        near = (chunk.codes[rows] @ cand.codes.T).astype(np.float64) * chunk.scale[rows][:, None] * cand.scale[None, :]
        error = chunk.error[rows][:, None] + (1 + chunk.error[rows][:, None]) * cand.error[None, :] + SLACK
        other = ids[:, None] != cand.ids[None, :]
        least = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps[rows]])
        low = np.where(other, near - error, -np.inf)
        if low.shape[1] >= k:
            least = np.maximum(least, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
        q, c = np.nonzero(other & (near + error >= least[:, None]))
        for at in range(0, len(q), EXACT_PAIRS):
            self.merge(chunk, heaps[rows], rows, cand, q[at : at + EXACT_PAIRS], c[at : at + EXACT_PAIRS])

    def merge(self, chunk: Chunk, heaps: list, rows: slice, cand: Chunk, q: np.ndarray, c: np.ndarray) -> None:
        score = fold(chunk.origin[rows][q], cand.origin[c]) / (chunk.norm[rows][q] * cand.norm[c])
        order = np.lexsort((cand.ids[c], -score, q))
        q, c, score = q[order], c[order], score[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.concatenate([first, [len(q)]])))
        keep = place < self.k
        for i, s, v in zip(q[keep].tolist(), score[keep].tolist(), (-cand.ids[c[keep]]).tolist(), strict=True):
            heap = heaps[i]
            if len(heap) < self.k:
                heapq.heappush(heap, (s, v))
            elif (s, v) > heap[0]:
                heapq.heapreplace(heap, (s, v))

    def found(self) -> Iterator[pa.RecordBatch]:
        for chunk, heaps in zip(self.queries, self.heaps, strict=True):
            flat = [(int(i), -v, s) for i, h in zip(chunk.ids, heaps, strict=True) for s, v in h]
            columns = zip(*flat, strict=True) if flat else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])


def joined(k: int):
    """For mapInArrow over rows sorted by block, then query chunks before candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, Block(k)
        for batch in batches:
            for row in batch.to_pylist():
                if (row["qb"], row["cb"]) != key:
                    yield from block.found()
                    key, block = (row["qb"], row["cb"]), Block(k)
                chunk = Chunk(*(row[n] for n in PACKED_SCHEMA.names))
                if row["is_query"]:
                    block.load(chunk)
                elif block.queries:
                    block.meet(chunk)
        yield from block.found()

    return run


def nearest(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each query row, ties to the smaller id.

    Null, empty or zero vectors, those with null or non-finite components and rows without an id
    take no part. Rows of a query's own id are never its neighbours; where an id repeats, its
    smallest vector is the query and each of its rows a candidate for others. Vectors of another
    dimension don't meet. Queries with fewer candidates return them all. Only the two columns and
    those of is_query are read.
    """
    usable = F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where(usable & sound)
    n, n_queries = rows.select(F.count("*"), F.count(F.when(F.col("is_query"), 1))).first()
    q_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    c_blocks = max(1, n // min(max(n // 64, CHUNK), 1 << 20))
    spread = lambda blocks: F.pmod(F.xxhash64("ids"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    names = PACKED_SCHEMA.names
    queries = rows.where("is_query").groupBy("id").agg(F.min("v").alias("v")).mapInArrow(pack, PACKED)
    queries = queries.select(spread(q_blocks).alias("qb"), every(c_blocks).alias("cb"), F.lit(True).alias("is_query"), *names)
    others = rows.select("id", "v").mapInArrow(pack, PACKED)
    others = others.select(spread(c_blocks).alias("cb"), every(q_blocks).alias("qb"), F.lit(False).alias("is_query"), *names).select("qb", "cb", "is_query", *names)
    tiles = queries.union(others).repartition(q_blocks * c_blocks, "qb", "cb").sortWithinPartitions("qb", "cb", F.desc("is_query"))
    best = tiles.mapInArrow(joined(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 5, step: int = 50) -> str:
    """DuckDB SQL for nearest() over embeddings with every id divisible by step as query."""
    dot = "list_reduce(list_prepend(0::DOUBLE, list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i])), lambda x, y: x + y)"
    return f"""
WITH usable AS (
  SELECT vec_id, v, sqrt({dot.format(a="v", b="v")}) AS norm
  FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, {dot.format(a="q.v", b="c.v")} / (q.norm * c.norm) AS score
  FROM usable q, usable c WHERE q.vec_id % {step} = 0 AND c.vec_id <> q.vec_id AND q.norm > 0 AND c.norm > 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM pairs
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= {k}
"""
