"""Hard negatives by bit-sliced integer products.

Components become whole numbers, floor(SCALE * x). Candidates are packed into chunks that keep them as
bit-planes in two's complement, the most significant plane (the sign) first. In a tile of anchors and
candidates the product of the anchors with one plane after the other is added up; what the planes still
to come can add to a pair lies between (2^j - 1) times the sum of the anchor's negative components and as
much of its positive ones, so each plane narrows the interval of each score. A pair whose interval can't
qualify any more is dropped: columns without a living pair are left out of the next product, and where
few pairs live they are followed one by one. After the last plane an interval is the exact score.

Two passes over the tiles, each a block join of the anchors with all rows:
1. positives: the k best of the anchor's own label; an interval qualifies while it reaches the k-th best
   lower end seen. Only rows of one label meet.
2. negatives: for each positive the best of the other labels between FROM / 100 of its score and its score;
   an interval qualifies while it reaches into that window and, where k are surely inside, reaches the k-th of them.
Nothing that could be in the result is dropped, and no index is fitted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvana.session import cut

SCALE, FROM = 256, 80
ANCHOR_BLOCK = 16_384
CHUNK, CHUNK_NUMBERS = 4_096, 2 << 20
TILE_ANCHORS = 512
FEW = 16  # pairs are followed one by one when at most 1 of so many lives
PAIRS = 1 << 16
EXACT = 1 << 53

PACKED = "dim int, width int, ids binary, labels binary, planes binary, windows binary"
PACKED_SCHEMA = pa.schema([("dim", pa.int32()), ("width", pa.int32()), *((n, pa.binary()) for n in ("ids", "labels", "planes", "windows"))])


def packed(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, windows: np.ndarray) -> dict:
    """A chunk, sorted by label; x: whole numbers."""
    order = np.argsort(labels, kind="stable")
    x = x[order]
    width = 1 + max(int(x.max(initial=0)).bit_length(), int(~x.min(initial=0)).bit_length())
    planes = [np.packbits((x >> j & 1).astype(np.uint8), axis=1).tobytes() for j in range(width - 1, -1, -1)]
    return {"dim": x.shape[1], "width": width, "ids": ids[order].tobytes(), "labels": labels[order].tobytes(), "planes": b"".join(planes), "windows": windows[order].tobytes()}


def pack(k: int):
    """For mapInArrow over (id, label, v, windows): chunks of vectors of one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            sizes = np.diff(lists.offsets.to_numpy())
            ids, labels = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("id", "label"))
            windows = np.zeros((batch.num_rows, k), np.int64)
            for n, w in enumerate(batch.column("windows").to_pylist()):
                windows[n, : len(w)] = w
                windows[n, len(w) :] = -1  # no window: nothing lies between 4/5 of -1 and -1
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.cumsum(sizes) - sizes
            for dim in sorted(set(sizes.tolist())):
                every = np.flatnonzero(sizes == dim)
                step = max(1, min(CHUNK, CHUNK_NUMBERS // max(dim, 1)))
                for at in range(0, len(every), step):
                    own = every[at : at + step]
                    x = np.floor(SCALE * flat[starts[own][:, None] + np.arange(dim)])
                    if x.size and np.abs(x).max() >= 2.0**62:
                        raise ArithmeticError(f"a component times {SCALE} doesn't fit 63 bits")
                    yield pa.RecordBatch.from_pylist([packed(ids[own], labels[own], x.astype(np.int64), windows[own])], schema=PACKED_SCHEMA)

    return run


class Chunk:
    def __init__(self, dim: int, width: int, ids: bytes, labels: bytes, planes: bytes, windows: bytes):
        self.dim, self.ids, self.labels = dim, np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        rows, size = len(self.ids), -(-dim // 8)
        self.width = width
        self.planes = np.frombuffer(planes, np.uint8).reshape(width, rows, size)
        self.windows = np.frombuffer(windows, np.int64).reshape(rows, -1)

    def plane(self, n: int, rows: np.ndarray | slice) -> np.ndarray:
        return np.unpackbits(self.planes[n, rows], axis=1, count=self.dim)

    def numbers(self) -> np.ndarray:
        """The vectors themselves."""
        x = np.zeros((len(self.ids), self.dim), np.int64)
        for n in range(self.width):
            x = 2 * x + self.plane(n, slice(None)).astype(np.int64) * (-1 if n == 0 else 1)
        return x


def narrowed(a: np.ndarray, cand: Chunk, cols: np.ndarray, alive: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, scores) of the pairs of anchors a and candidates cols that alive(low, high, row, column) keeps after each plane.

    alive gets the interval's ends either for all pairs, as arrays of two dimensions, or for single ones.
    """
    most = int(np.abs(a).max(initial=0)) * max(cand.dim, 1) << cand.width
    kind = np.float64 if most < EXACT else object  # Python's numbers where doubles would round
    a = a.astype(kind)
    up, down = np.maximum(a, 0).sum(axis=1), np.minimum(a, 0).sum(axis=1)
    total = np.zeros((len(a), len(cols)), kind)
    row = np.arange(len(a))[:, None]
    pairs = None
    for n in range(cand.width):
        j = cand.width - 1 - n
        unit, rest = (-1 if n == 0 else 1) * 2**j, 2**j - 1
        if pairs is None:
            total = total + unit * (a @ cand.plane(n, cols).astype(kind).T)
            keep = alive(total + rest * down[:, None], total + rest * up[:, None], row, cols[None, :])
            living = np.count_nonzero(keep)
            if living * FEW <= keep.size or n == cand.width - 1:
                q, c = np.nonzero(keep)
                pairs = q, cols[c], total[q, c]
            elif np.count_nonzero(some := keep.any(axis=0)) < 0.75 * len(cols):
                cols, total = cols[some], total[:, some]
        else:
            q, c, score = pairs
            for at in range(0, len(q), PAIRS):
                part = slice(at, at + PAIRS)
                score[part] += unit * (a[q[part]] * cand.plane(n, c[part]).astype(kind)).sum(axis=1)
            keep = alive(score + rest * down[q], score + rest * up[q], q, c)
            pairs = q[keep], c[keep], score[keep]
        if pairs is not None and not len(pairs[0]):
            break
    q, c, score = pairs if pairs is not None else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return q, c, score.astype(np.int64)


def at_most(x: np.ndarray) -> np.ndarray:
    """Whole numbers as doubles that aren't larger."""
    x = x.astype(np.float64)
    return np.where(np.abs(x) < EXACT, x, np.nextafter(x, -np.inf))


def kth(low: np.ndarray, k: int) -> np.ndarray:
    """A double that isn't larger than each row's k-th largest number, minus infinity where there are fewer."""
    if low.shape[1] < k:
        return np.full(len(low), -np.inf)
    return at_most(np.partition(low.astype(np.float64), low.shape[1] - k, axis=1)[:, low.shape[1] - k])


class Best:
    """The k best (score, smaller id) of each slot."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(slots, -np.inf)  # the k-th score of full slots

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.concatenate([first, [len(slot)]])))
        self.least[slot[place == self.k - 1]] = at_most(score[place == self.k - 1])
        keep = place < self.k
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]


class Block:
    """The anchors of one block, with the best of each: of the anchor, or of each of its windows."""

    def __init__(self, k: int, negatives: bool):
        self.k, self.negatives, self.anchors = k, negatives, []

    def load(self, chunk: Chunk) -> None:
        x = chunk.numbers()
        slots = len(x) * (chunk.windows.shape[1] if self.negatives else 1)
        self.anchors.append((chunk, x, Best(slots, self.k)))

    def meet(self, cand: Chunk) -> None:
        for chunk, x, best in self.anchors:
            if chunk.dim == cand.dim:
                for at in range(0, len(x), TILE_ANCHORS):
                    rows = slice(at, min(at + TILE_ANCHORS, len(x)))
                    if self.negatives:
                        self.windowed(chunk, x, best, rows, cand)
                    else:
                        self.same(chunk, x, best, rows, cand)

    def same(self, chunk: Chunk, x: np.ndarray, best: Best, rows: slice, cand: Chunk) -> None:
        k = self.k
        for label in np.unique(chunk.labels[rows]).tolist():
            first, end = (rows.start + int(np.searchsorted(chunk.labels[rows], label, side)) for side in ("left", "right"))
            cols = np.arange(*(int(np.searchsorted(cand.labels, label, side)) for side in ("left", "right")))
            if not len(cols):
                continue
            ids, least = chunk.ids[first:end], best.least[first:end].copy()

            def alive(low, high, q, c, ids=ids, least=least):
                other = ids[q] != cand.ids[c]
                if low.ndim == 2:
                    np.maximum(least, kth(np.where(other, low, -np.inf), k), out=least)
                return other & (high >= least[q])

            q, c, score = narrowed(x[first:end], cand, cols, alive)
            best.add(first + q, score, cand.ids[c])

    def windowed(self, chunk: Chunk, x: np.ndarray, best: Best, rows: slice, cand: Chunk) -> None:
        k, ids, labels, most = self.k, chunk.ids[rows], chunk.labels[rows], chunk.windows[rows]
        n_windows = most.shape[1]
        bottom = FROM * (most // 100) - (-FROM * (most % 100)) // 100  # rounded up, in numbers that don't overflow
        least = np.maximum(at_most(bottom), best.least.reshape(-1, n_windows)[rows])
        some = np.flatnonzero((bottom <= most).any(axis=1))  # anchors with a window that isn't empty
        if not len(some):
            return
        ids, labels, most, bottom, least = ids[some], labels[some], most[some], bottom[some], least[some]

        def alive(low, high, q, c):
            other = (labels[q] != cand.labels[c]) & (ids[q] != cand.ids[c])
            if low.ndim == 2:
                for i in range(n_windows):
                    sure = other & (high <= most[:, i : i + 1]) & (low >= least[:, i : i + 1])
                    if np.count_nonzero(sure) >= k:
                        np.maximum(least[:, i], kth(np.where(sure, low, -np.inf), k), out=least[:, i])
            keep = np.zeros(np.broadcast(q, c).shape, bool)
            for i in range(n_windows):
                keep |= (high >= least[q, i]) & (low <= most[q, i])
            return keep & other

        q, c, score = narrowed(x[rows][some], cand, np.arange(len(cand.ids)), alive)
        for i in range(n_windows):
            inside = (score >= bottom[q, i]) & (score <= most[q, i])
            best.add((rows.start + some[q[inside]]) * n_windows + i, score[inside], cand.ids[c[inside]])

    def found(self) -> Iterator[pa.RecordBatch]:
        for chunk, _, best in self.anchors:
            n = chunk.windows.shape[1] if self.negatives else 1
            at, window = best.slot // n, best.slot % n
            yield pa.RecordBatch.from_arrays([pa.array(chunk.ids[at]), pa.array(window + 1, pa.int32()), pa.array(best.id), pa.array(best.score)], names=["anchor_id", "place", "id", "score"])


def joined(k: int, negatives: bool):
    """For mapInArrow over rows sorted by block, then anchor chunks before candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, Block(k, negatives)
        for batch in batches:
            for row in batch.to_pylist():
                if (row["ab"], row["cb"]) != key:
                    yield from block.found()
                    key, block = (row["ab"], row["cb"]), Block(k, negatives)
                chunk = Chunk(*(row[n] for n in PACKED_SCHEMA.names))
                if row["is_anchor"]:
                    block.load(chunk)
                elif block.anchors:
                    block.meet(chunk)
        yield from block.found()

    return run


FOUND = "anchor_id long, place int, id long, score long"


def hard_negatives(df: DataFrame, is_anchor: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor's k best rows of its label, the k best of other labels that score FROM / 100 of it at least and no more than it.

    Scores are products of floor(SCALE * component); equal ones rank by the smaller id. Rows without
    an id, a label or a vector, or with a null or non-finite component take no part. Rows of an
    anchor's own id are neither its positives nor its negatives; where an anchor's id repeats, its smallest label and vector are the anchor
    and each of its rows a candidate for others. Vectors of another dimension don't meet; empty ones
    score 0. A component whose whole number doesn't fit 63 bits is an error, as is a score beyond 64. Only the three columns and those of is_anchor are read.
    """
    columns = [F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor")]
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(*columns).where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & sound)
    n, n_anchors = rows.select(F.count("*"), F.count(F.when(F.col("is_anchor"), 1))).first()
    a_blocks = max(1, -(-n_anchors // ANCHOR_BLOCK))
    c_blocks = max(1, n // min(max(n // 64, CHUNK), 1 << 20))
    spread = lambda blocks: F.pmod(F.xxhash64("ids"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    none = F.array().cast("array<long>").alias("windows")
    others = rows.select("id", "label", "v", none).mapInArrow(pack(k), PACKED)
    others = others.select(spread(c_blocks).alias("cb"), every(a_blocks).alias("ab"), F.lit(False).alias("is_anchor"), *PACKED_SCHEMA.names)
    anchors = rows.where("is_anchor").groupBy("id").agg(F.min(F.struct("label", "v")).alias("a")).select("id", "a.label", "a.v")

    def best(asked: DataFrame, negatives: bool, *key: str) -> DataFrame:
        left = asked.mapInArrow(pack(k), PACKED).select(spread(a_blocks).alias("ab"), every(c_blocks).alias("cb"), F.lit(True).alias("is_anchor"), *PACKED_SCHEMA.names)
        tiles = left.unionByName(others).repartition(a_blocks * c_blocks, "ab", "cb").sortWithinPartitions("ab", "cb", F.desc("is_anchor"))
        order = Window.partitionBy(*key).orderBy(F.desc("score"), "id")
        return tiles.mapInArrow(joined(k, negatives), FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    positives = cut(best(anchors.select("*", none), False, "anchor_id").select("anchor_id", "rank", "id", "score"))  # k rows for each anchor
    windows = positives.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"]).alias("windows"))
    asked = anchors.join(windows, anchors["id"] == windows["anchor_id"]).select("id", "label", "v", "windows")
    negatives = best(asked, True, "anchor_id", "place").select("anchor_id", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    positives = positives.select("anchor_id", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(positives, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def anchors_and_labels(df: DataFrame, every: int = 100, moved: int = 7, labels: int = 10) -> tuple[DataFrame, Column]:
    """The rows with the label of each id divisible by `moved` set to the next one, and which rows are anchors."""
    label = F.when(F.col("vec_id") % moved == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return df.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % every == 0


def oracle(k: int = 5, every: int = 100, moved: int = 7, labels: int = 10) -> str:
    """DuckDB SQL for hard_negatives() over anchors_and_labels() of embeddings."""
    return f"""
WITH usable AS (
  SELECT vec_id AS id, CASE WHEN vec_id % {moved} = 0 THEN (label + 1) % {labels} ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scores AS (
  SELECT a.id AS anchor_id, c.id, a.label = c.label AS same, CAST(CASE WHEN len(a.v) = 0 THEN 0 ELSE list_dot_product(a.v, c.v) END AS BIGINT) AS score
  FROM usable a, usable c WHERE a.id % {every} = 0 AND a.id <> c.id AND len(a.v) = len(c.v)
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {k}
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND {FROM} * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= {k}
"""
