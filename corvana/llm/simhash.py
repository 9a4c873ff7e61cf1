"""SimHash near-duplicates: fingerprints, pigeonring candidates, exact check, components.

A 64-bit fingerprint is cut into a ring of SEGMENTS equal segments. If two fingerprints differ in
at most TAU bits, then from some segment on, every chain of l consecutive segments differs in at
most floor(l * TAU / SEGMENTS) bits: the budget is 0 bits for the first segment, 1 for the first
two, 2 for three. So each fingerprint is filed, for each start, under the bits of the first two
segments of the chain, and looked up there and with one set bit of the second segment cleared; two
that differ by one bit there meet because just one of them has that bit set. Where fingerprints
meet, the budget of the longer chains is checked before the full Hamming distance. Filing costs a
fixed number of rows for each distinct fingerprint, so the work grows with the input.

Rows of the same fingerprint are one class from the start, and of the links found under one key a
spanning forest is passed on, so a group of copies never becomes all its pairs. A key with more than
FULL rows is filed anew under each byte of its other two segments: of two fingerprints within TAU
bits, one of these four bytes is equal. If that is still too full, it is filed under each quarter of
the other three bytes, for the same reason; and what is too full even then is dealt in blocks of about
FULL rows that meet two by two, each pair of blocks in a group of its own. FULL doesn't grow with the
input, so no task does.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvana.llm.batches import mapper
from corvana.llm.components import components, joined
from corvana.session import cut

TAU, SEGMENTS, WIDTH = 3, 4, 16
SEED, SHINGLE = 42, 3
BLOCK = 1 << 21
FULL = 20_000
START_BITS, BYTE_BITS = 8, 2 * WIDTH + 8
QUARTER_BITS = BYTE_BITS + 11
#: Rows that are broadcast to mark others; more of them meet by a shuffle.
BROADCAST_ROWS = 500_000


def lanes() -> np.ndarray:
    """For each byte, eight one-byte counters holding its bits, lowest bit first, as one number."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view(np.uint64).ravel()


LANES = lanes()


def shingle_hashes(text: str | None, words: int = SHINGLE) -> list[int]:
    """XXH64 of each run of words (of the whole sequence, if shorter), A-Z lowered."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = xxhash.xxh64_intdigest
    if not found:
        return []
    if len(found) <= words:
        return [h(b" ".join(found), SEED)]
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate([[0], ends[:-words]]).tolist()
    joined = b" ".join(found)
    return [h(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]


def fingerprints(texts: list[str | None], words: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text, as uint64; zero for texts without words."""
    hashes = [shingle_hashes(t, words) for t in texts]
    counts = np.array([len(x) for x in hashes], np.int64)
    out = np.zeros(len(texts), np.uint64)
    own = np.flatnonzero(counts)
    if not len(own):
        return out
    flat = np.fromiter((x for row in hashes for x in row), np.uint64, int(counts.sum()))
    first = np.concatenate([[0], np.cumsum(counts[own])[:-1]])
    pieces = -(-counts[own] // 255)  # a one-byte counter holds 255
    at = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    cuts = np.repeat(first - 255 * at, pieces) + 255 * np.arange(int(pieces.sum()))
    octets = flat.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        sums = np.add.reduceat(LANES[octets[:, k]], cuts).view(np.uint8).reshape(-1, 8)
        total = np.add.reduceat(sums.astype(np.int64), at, axis=0)
        byte = np.packbits(2 * total > counts[own][:, None], axis=1, bitorder="little").ravel()
        out[own] |= byte.astype(np.uint64) << np.uint64(8 * k)
    return out


KEY_SCHEMA = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("probe", pa.bool_())])


def text_key(text: Column) -> Column:
    """Tells texts apart; a null text is like an empty one."""
    return F.md5(F.coalesce(text.cast("binary"), F.lit(b"")))


def fingerprint_rows(df: DataFrame, id_col: str, text_col: str, words: int = SHINGLE, keyed: bool = False) -> DataFrame:
    """(id, fp), keyed also the text's key: a row for each row of df, without a shuffle."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = fingerprints(batch.column("t").to_pylist(), words).view(np.int64)
        names = [n for n in batch.schema.names if n != "t"]
        return pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(found)], names=[*names, "fp"])

    key = [text_key(F.col(text_col)).alias("key")] if keyed else []
    rows = df.select(F.col(id_col).cast("long").alias("id"), *key, F.col(text_col).alias("t"))
    return rows.mapInArrow(mapper(kernel, "t", 4 << 20), f"id long, {'key string, ' if keyed else ''}fp long")


def rotated(fp: np.ndarray, start: int) -> np.ndarray:
    """The ring cut so that the given segment holds the highest bits."""
    n = WIDTH * start
    return fp if not n else fp << np.uint64(n) | fp >> np.uint64(64 - n)


def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint's keys: for each start the first two segments, and those with one set bit of the second cleared."""
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for start in range(SEGMENTS):
            two = rotated(fp, start) >> np.uint64(64 - 2 * WIDTH)
            keys, own, probe = [two], [fp], [np.zeros(len(fp), bool)]
            for bit in range(WIDTH):
                has = (two >> np.uint64(bit) & np.uint64(1)).astype(bool)
                keys.append(two[has] ^ np.uint64(1 << bit))
                own.append(fp[has])
                probe.append(np.ones(int(has.sum()), bool))
            key = np.concatenate(keys) | np.uint64(start << 2 * WIDTH)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.concatenate(own).view(np.int64)), pa.array(np.concatenate(probe))], schema=KEY_SCHEMA)


def other_half(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """The ring's last two segments, from the start that the key names, as the lowest bits."""
    rest, start = np.empty_like(fp), start_of(key)
    for n in range(SEGMENTS):
        rest[start == n] = rotated(fp[start == n], n)
    return rest & np.uint64((1 << 2 * WIDTH) - 1)


def by_byte(key: np.ndarray, fp: np.ndarray) -> list[np.ndarray]:
    """Four keys for each row of a full key: the key and one byte of the other half."""
    rest = other_half(key, fp)
    return [key | (np.uint64(256 * (n + 1)) + (rest >> np.uint64(8 * n) & np.uint64(255))) << np.uint64(BYTE_BITS) for n in range(4)]


def by_quarter(key: np.ndarray, fp: np.ndarray) -> list[np.ndarray]:
    """Four keys for each row of a full key of by_byte(): the key and 6 bits of the other three bytes."""
    rest = other_half(key, fp)
    low = ((key >> np.uint64(BYTE_BITS + 8)) - np.uint64(1)) * np.uint64(8)  # bits below the byte in the key
    rest = rest & (np.uint64(1) << low) - np.uint64(1) | rest >> low + np.uint64(8) << low
    return [key | (np.uint64(64 * (n + 1)) + (rest >> np.uint64(6 * n) & np.uint64(63))) << np.uint64(QUARTER_BITS) for n in range(4)]


def refiled(keys_of: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]):
    """For mapInArrow: rows of full keys under their new keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key in keys_of(*(batch.column(n).to_numpy(zero_copy_only=False).view(np.uint64) for n in (0, 1))):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(1), batch.column(2)], schema=KEY_SCHEMA)

    return run


def start_of(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(2 * WIDTH) & np.uint64((1 << START_BITS) - 1)).astype(np.int64)


def within_budget(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether the chain from start keeps its budget at three segments, and the whole ring at TAU bits."""
    diff = a ^ b
    n = (WIDTH * start).astype(np.uint64)
    ring = np.where(n == 0, diff, diff << n | diff >> (np.uint64(64) - n) % np.uint64(64))
    three = np.bitwise_count(ring >> np.uint64(WIDTH)) <= 3 * TAU // SEGMENTS
    return three & (np.bitwise_count(diff) <= TAU)


class Forest:
    """Spanning forest of the links found so far among the fingerprints of one key."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
        """Those of the links that join two trees, one after the other."""
        root, kept = self.root, ([], [])
        new = root[a] != root[b]
        for x, y in zip(a[new].tolist(), b[new].tolist(), strict=True):
            p, q = x, y
            while root[p] != p:
                p = int(root[p])
            while root[q] != q:
                q = int(root[q])
            if p != q:
                root[max(p, q)] = min(p, q)
                kept[0].append(x)
                kept[1].append(y)
        while not np.array_equal(up := root[root], root):
            root[:] = up
        return kept


def group_links(start: int, fp: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the filed fingerprints of one key and all that are looked up there, in blocks."""
    mine = np.flatnonzero(~probe)
    forest, a_out, b_out = Forest(len(fp)), [], []
    rows = max(1, BLOCK // len(fp))
    for at in range(0, len(mine), rows):
        block = mine[at : at + rows]
        ok = within_budget(fp[block][:, None], fp[None, :], np.array(start)) & (fp[block][:, None] != fp[None, :])
        x, y = np.nonzero(ok)
        kept = forest.add(block[x], y)
        a_out += kept[0]
        b_out += kept[1]
    return fp[np.array(a_out, np.int64)], fp[np.array(b_out, np.int64)]


def links_of(key: np.ndarray, fp: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links under whole keys of a run sorted by key: small groups together, large ones by themselves."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([first, [len(key)]]))
    filed_in = np.add.reduceat((~probe).astype(np.int64), first)
    a_out, b_out = [], []
    busy = (size > 1) & (filed_in > 0)
    small = busy & (size <= 64)
    if small.any():
        rows = np.concatenate([np.arange(f, f + s) for f, s in zip(first[small].tolist(), size[small].tolist(), strict=True)])
        own = np.repeat(np.flatnonzero(small), size[small])
        mine = ~probe[rows]
        left, group = rows[mine], own[mine]
        reps = size[group]
        ends = np.cumsum(reps)
        right = np.repeat(first[group] - ends + reps, reps) + np.arange(int(ends[-1]))
        left = np.repeat(left, reps)
        keep = (fp[left] != fp[right]) & (probe[right] | (left < right))
        left, right = left[keep], right[keep]
        ok = within_budget(fp[left], fp[right], start_of(key[left]))
        a_out.append(fp[left[ok]])
        b_out.append(fp[right[ok]])
    for g in np.flatnonzero(busy & (size > 64)).tolist():
        part = slice(first[g], first[g] + size[g])
        a, b = group_links(int(start_of(key[first[g]])), fp[part], probe[part])
        a_out.append(a)
        b_out.append(b)
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *a_out]), np.concatenate([empty, *b_out])


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from rows sorted by key; the rows of the last key wait for the next batch."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: list[np.ndarray] | None = None

    def out(columns: list[np.ndarray]) -> pa.RecordBatch:
        a, b = links_of(*columns)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

    waiting: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)]
        if not len(columns[0]):
            continue
        waiting.append(columns)
        if columns[0][0] == columns[0][-1] and waiting[0][0][0] == columns[0][0]:
            continue  # all of one key so far
        held = [np.concatenate(x) for x in zip(*waiting, strict=True)]
        last = int(np.searchsorted(held[0], held[0][-1]))
        yield out([x[:last] for x in held]) if last else pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, schema=schema)
        waiting = [[x[last:] for x in held]]
    if waiting:
        yield out([np.concatenate(x) for x in zip(*waiting, strict=True)])


def blocks_met(keys: DataFrame, crowded: DataFrame, full: int) -> DataFrame:
    """Rows (key, fp, probe) of the crowded keys (key, n), dealt in blocks: what is filed in one meets all that is in another, under a key for the two.

    The new keys are hashes that keep the start; keys that should collide only share a group.
    """
    dealt = keys.join(crowded, "key").withColumn("blocks", F.ceil(F.col("n") / full).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    filing = dealt.where(~F.col("probe")).select("key", "fp", F.lit(False).alias("probe"), F.col("own").alias("i"), others).withColumnRenamed("other", "j")
    asking = dealt.select("key", "fp", F.lit(True).alias("probe"), F.col("own").alias("j"), others).withColumnRenamed("other", "i")
    start = ((1 << START_BITS) - 1) << 2 * WIDTH
    both = F.xxhash64("key", "i", "j").bitwiseAND(F.lit(~start)).bitwiseOR(F.col("key").bitwiseAND(F.lit(start)))
    return filing.unionByName(asking).select(both.alias("key"), "fp", "probe")


def fingerprint_links(distinct: DataFrame, full: int = FULL) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that differ in at most TAU bits, enough to connect all that are so linked."""
    schema = "key long, fp long, probe boolean"
    keys, found = cut(distinct.select("fp").mapInArrow(filed, schema)), []
    for keys_of in (by_byte, by_quarter, None):
        crowded = cut(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > full))
        few = crowded.count()
        if not few:
            found.append(keys)
            break
        marked = F.broadcast(crowded) if few <= BROADCAST_ROWS else crowded
        found.append(keys.join(marked.select("key"), "key", "left_anti"))
        if keys_of is None:
            found.append(blocks_met(keys, marked, full))
        else:
            keys = cut(keys.join(marked.select("key"), "key", "left_semi").mapInArrow(refiled(keys_of), schema))
    every = functools.reduce(DataFrame.unionByName, found)
    return every.repartition("key").sortWithinPartitions("key").mapInArrow(linked, "a long, b long")


def labelled(rows: DataFrame) -> DataFrame:
    """(fp, first, component_id, root) of the distinct fingerprints in rows (id, fp).

    first: the smallest id with that fingerprint; root: the component's smallest fingerprint, which
    tells components apart where ids are null or repeated.
    """
    distinct = cut(rows.groupBy("fp").agg(F.min("id").alias("first")))
    return components_of(distinct, fingerprint_links(distinct))


def components_of(distinct: DataFrame, links: DataFrame) -> DataFrame:
    """labelled() of distinct (fp, first) by the given links (a, b) between fps."""
    nodes = components(links).withColumnRenamed("node", "fp")
    least = nodes.join(distinct, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    found = distinct.join(joined(nodes, least, "root").select("fp", "root", "component_id"), "fp", "left")
    return found.select("fp", "first", F.coalesce("component_id", "first").alias("component_id"), F.coalesce("root", "fp").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """(id_col, fingerprint, component_id) for each row: 16 hex digits, and the smallest id reachable over links of at most TAU bits.

    A null text counts as empty; texts without words have fingerprint zero and link like others. A
    null id is no smallest id unless its component has no other (then component_id is null).
    Repeated rows are kept. Only the two columns are read, so others don't matter.
    """
    rows = cut(fingerprint_rows(df, id_col, text_col, words))
    found = joined(rows, cut(labelled(rows)), "fp")
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def text_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """(key, root) of each different text: its text_key() and what tells its component of near-duplicates apart."""
    rows = cut(fingerprint_rows(df, id_col, text_col, words, keyed=True))
    return joined(rows.select("key", "fp").distinct(), cut(labelled(rows)), "fp").select("key", "root")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """df with one row of each component: that of the smallest id; of several texts under this id and fingerprint that of the least key, of equal rows one.

    A component without any id keeps one row. Every other column is kept as it is.
    """
    rows = cut(fingerprint_rows(df, id_col, text_col, words, keyed=True))
    return first_rows(df, id_col, text_col, rows, labelled(rows))


def first_rows(df: DataFrame, id_col: str, text_col: str, rows: DataFrame, chosen: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """keep_first() for the (id, key, fp) rows of df and the labelled() fps. Where few rows go, df isn't shuffled."""
    names = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
    given = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), text_key(F.col(f"`{text_col}`")).alias("key"))
    first = chosen.where("first <=> component_id").groupBy("root").agg(F.min("fp").alias("fp"), F.first("component_id").alias("keep_id"))
    won = first.join(rows, (first.fp == rows.fp) & first.keep_id.eqNullSafe(rows.id)).groupBy("root", "id").agg(F.min("key").alias("key"))
    counts = rows.groupBy("id", "key").agg(F.count("*").alias("n")).alias("c")
    marks = counts.join(won.alias("w"), F.col("c.id").eqNullSafe(F.col("w.id")) & (F.col("c.key") == F.col("w.key")), "left")
    marks = cut(marks.select(F.col("c.id").alias("mark_id"), F.col("c.key").alias("mark"), F.col("w.key").isNull().alias("gone"), "n").where("gone or n > 1"))
    other = F.broadcast(marks) if marks.count() <= broadcast_rows else marks
    met = given.join(other, F.col("id").eqNullSafe(F.col("mark_id")) & (F.col("key") == F.col("mark")), "left")
    several = met.where("n > 1 and not gone").groupBy("id", "key").agg(F.min_by("row", F.xxhash64(*[F.col(f"row.`{c}`") for c in names])).alias("row"))
    return met.where("mark is null").select("row.*").unionByName(several.select("row.*"))
