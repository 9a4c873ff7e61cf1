"""Near-duplicates by the exact Jaccard similarity of word shingles.

Texts of equal shingle sets are one class. Candidates are classes that share a band of ROWS MinHash
values: of BANDS bands, two sets of similarity 0.8 share one with probability 0.9993, of 0.85 with
0.99999. The shingle sets meet under each different group of candidates once, and sets decide:
each pair is compared unless links already found connect it.

A group's sets are dealt in blocks of BLOCK_BYTES, each in a task of its own together with the group's first set,
which links most groups of near copies. Only where members of a larger group are in different components
after that, do its blocks meet in pairs, and there only sets of different components are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvana.llm.batches import give_back, mapper
from corvana.llm.components import joined
from corvana.llm.simhash import BROADCAST_ROWS, components_of, first_rows, shingle_hashes, text_key
from corvana.session import cut

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 6
CHUNK = 1024
BLOCK_BYTES = 32 << 20
FACTORS = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)

GROUP_SCHEMA = pa.schema([("group", pa.int64()), ("fp", pa.int64())])
LINK_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def digest(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def band_keys(found: np.ndarray) -> list[int]:
    """A key for each band of MinHash values; none for an empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), CHUNK):
        least = np.minimum(least, (found[None, at : at + CHUNK] * FACTORS[0] + FACTORS[1]).min(axis=1))
    return [xxhash.xxh3_64_intdigest(least[n * ROWS : (n + 1) * ROWS].tobytes(), n) - (1 << 63) for n in range(BANDS)]


def set_rows(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, key, fp, bands, bytes): a row for each row of df, without a shuffle; fp tells shingle sets apart, key texts; bytes: of the set."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, words) for t in batch.column("t").to_pylist()]
        fps, bands = [digest(x) for x in sets], [band_keys(x) for x in sets]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array([x.nbytes for x in sets], pa.int64())], names=["id", "key", "fp", "bands", "bytes"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("t"))
    return rows.mapInArrow(mapper(kernel, "t"), "id long, key string, fp long, bands array<long>, bytes long")


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each run of batches in whole keys; column 0 is the key, by which they are sorted. Columns of bytes must stay under 2 GiB for a key: larger ones would be split."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        if waiting and waiting[0].column(0)[0].as_py() == key[-1]:
            waiting.append(batch)
            continue
        whole = pa.Table.from_batches([*waiting, batch.slice(0, last)]).combine_chunks().to_batches() if waiting or last else []
        yield from whole
        waiting = [batch.slice(last)]
    if waiting:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()


def runs(key: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of two and more equal keys."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    ends = np.append(first[1:], len(key))
    busy = ends - first > 1
    yield from zip(first[busy].tolist(), ends[busy].tolist(), strict=True)


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, fp) of the keys with several classes, from rows (key, fp) sorted by both; groups of the same classes have one number."""
    for batch in by_key(batches):
        key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        found = [(xxhash.xxh3_64_intdigest(fp[a:b].tobytes()) - (1 << 63), fp[a:b]) for a, b in runs(key)]
        groups = np.repeat(np.array([g for g, _ in found], np.int64), [len(x) for _, x in found])
        yield pa.RecordBatch.from_arrays([pa.array(groups), pa.array(np.concatenate([np.zeros(0, np.int64), *[x for _, x in found]]))], schema=GROUP_SCHEMA)


def similar_links(sets: list[np.ndarray], similarity: float, tree: np.ndarray | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets whose Jaccard similarity is at least the given one. tree: numbers of the trees they are in already; side: only sets of different sides are compared."""
    n = len(sets)
    size = np.array([len(x) for x in sets])
    tree, out = np.arange(n) if tree is None else tree.copy(), []
    for i in range(n - 1):
        low, high = np.minimum(size[i], size), np.maximum(size[i], size)
        rest = np.flatnonzero((tree != tree[i]) & (np.arange(n) > i) & (low >= similarity * high) & (True if side is None else side != side[i]))
        for at in range(0, len(rest), CHUNK):
            part = rest[at : at + CHUNK]
            flat, own = np.concatenate([sets[j] for j in part]), sets[i]
            place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            starts = np.concatenate([[0], np.cumsum(size[part])[:-1]])
            common = np.add.reduceat((own[place] == flat).astype(np.int64), starts)
            for j in part[common >= similarity * (size[i] + size[part] - common) - 1e-9].tolist():
                if tree[j] != tree[i]:
                    tree[tree == tree[j]] = tree[i]
                    out.append((i, j))
    return out


def set_links(df: DataFrame, distinct: DataFrame, id_col: str, text_col: str, words: int, similarity: float, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(a, b): links between distinct classes (fp, bands, bytes, rep: id and key of a row) of df, enough to connect all candidates of at least the similarity."""

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(t, words).tobytes() for t in batch.column("t").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(sets, pa.binary())], names=["fp", "items"])

        yield from mapper(kernel, "t")(batches)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_key(batches):
            unit, fp, items = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            tree, side = (batch.column(n).to_numpy(zero_copy_only=False) if batch.num_columns > 3 else None for n in (3, 4))
            a_out, b_out = [], []
            for a, b in runs(unit):
                sets = [np.frombuffer(items[n].as_buffer(), np.uint64) for n in range(a, b)]
                given = () if tree is None else (np.unique(tree[a:b], return_inverse=True)[1], side[a:b])
                for x, y in similar_links(sets, similarity, *given):
                    a_out.append(fp[a + x])
                    b_out.append(fp[a + y])
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], schema=LINK_SCHEMA)
        give_back()

    def compared(units: DataFrame, *given: str) -> DataFrame:
        """Links of the sets that meet in units (unit, fp)."""
        met = units.join(one.mapInArrow(with_sets, "fp long, items binary"), "fp").select("unit", "fp", "items", *given)
        return met.repartition("unit").sortWithinPartitions("unit", "fp").mapInArrow(verified, "a long, b long")

    keys = distinct.select(F.explode("bands").alias("key"), "fp")
    groups = keys.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(grouped, "group long, fp long").dropDuplicates()
    before = Window.partitionBy("group").orderBy("fp").rowsBetween(Window.unboundedPreceding, -1)
    block = F.floor(F.coalesce(F.sum("bytes").over(before), F.lit(0)) / block_bytes)
    groups = cut(groups.join(distinct.select("fp", "bytes"), "fp").select("group", "fp", block.alias("block")))
    wanted = cut(groups.select("fp").distinct().join(distinct, "fp").select("fp", F.col("rep.id").alias("rep_id"), F.col("rep.key").alias("rep_key")))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = df.select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("t"))
    one = texts.join(wanted, F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("key") == F.col("rep_key"))).select("fp", "t").dropDuplicates(["fp"])

    several = groups.where("block > 0").select("group", "block").distinct()
    if not several.head(1):
        return compared(groups.select(F.col("group").alias("unit"), "fp"))
    unit = lambda *c: F.xxhash64("group", *c).alias("unit")
    pivots = several.join(groups.groupBy("group").agg(F.min("fp").alias("fp")), "group")
    links = cut(compared(groups.select(unit("block"), "fp").unionByName(pivots.select(unit("block"), "fp"))))
    root = components_of(distinct.select("fp", "first"), links).select("fp", "root")
    large = cut(groups.join(several.groupBy("group").agg(F.max("block").alias("last")), "group").join(root, "fp"))
    apart = large.groupBy("group").agg(F.count_distinct("root").alias("roots")).where("roots > 1").select("group")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))
    pairs = large.join(apart, "group").select("group", "fp", "root", "block", every.alias("other")).where("block <> other")
    rest = compared(pairs.select(unit(F.least("block", "other"), F.greatest("block", "other")), "fp", "root", F.col("block").alias("side")), "root", "side")
    return links.unionByName(rest)


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES, classes: DataFrame | None = None) -> DataFrame:
    """df with one row of each component of texts linked by at least the similarity, or by a class (key, root) that they share: that of the smallest id; of several texts under this id and shingle set that of the least key, of equal rows one.

    A null text counts as empty; texts without words are one component. A component without any id
    keeps one row. Every other column is kept as it is.
    """
    rows = cut(set_rows(df, id_col, text_col, words))
    distinct = cut(rows.groupBy("fp").agg(F.min("id").alias("first"), F.first("bands").alias("bands"), F.first("bytes").alias("bytes"), F.min(F.struct("id", "key")).alias("rep")))
    links = set_links(df, distinct, id_col, text_col, words, similarity, block_bytes)
    if classes is not None:  # each shingle set is linked with the least one of its class
        own = cut(rows.select("key", "fp").distinct().join(classes, "key").select("fp", "root").distinct())
        least = own.groupBy("root").agg(F.min("fp").alias("least"))
        links = links.unionByName(joined(own, least, "root").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b")))
    chosen = components_of(distinct.select("fp", "first"), links)
    return first_rows(df, id_col, text_col, rows.select("id", "key", "fp"), chosen)
