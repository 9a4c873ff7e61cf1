"""Removal of repeated passages: exact 50-byte matches across documents by bucket-pointer refinement.

Every 50-byte string has an anchor that its bytes alone choose: the 24-gram of least hash among its
27. So equal strings meet under their anchor's hash, a sparse form of the initial q-gram buckets.

1. Documents are packed into compressed chunks, dealt over the tasks and written once; what comes back
   to a chunk meets it where it lies.
2. Each chunk files the hashes of its anchors; those found in two documents come back to the chunks.
   All that is unique, most of the text, ends here.
3. Runs of strings with a shared anchor are cut out, once for each chunk if they repeat in it, with
   the smallest document that has them, and meet by hash. There all positions get bucket pointers by
   their 8-grams; buckets are refined by sorting on the pointers 8 and 16 positions later and, for
   the strings themselves, 18 later, each round reading the pointers that the one before refined. A
   final bucket is the set of equal 50-byte strings; its smallest document goes back to the chunks.
4. Each chunk drops the bytes of strings that a smaller document has.

Hashes only gather candidates; equality is decided on bytes. A passage that many documents share
reaches its bucket once for each chunk, not for each document. A hot anchor, one that a chunk has in
more than HOT contexts (blanks, a frequent phrase), would gather unlike strings in one place: its
strings are cut out one by one and meet by their own hash.

Chunks and parts are sized in bytes, so a chunk files chunks x parts = text^2 / (chunk x part bytes)
payloads; both sizes are parameters, to be raised with the memory of the workers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvana.llm.batches import give_back
from corvana.session import cut, cut_by

LENGTH, GRAM = 50, 24
SPAN = LENGTH - GRAM + 1
CHUNK_BYTES, PART_BYTES = 8 << 20, 64 << 20
TILE = 1 << 18
BATCH_BYTES = 2 << 20
SEGMENT_SHARE = 4  # bytes of segments weigh as much as so many of text
ANCHOR_BYTES = 14  # a text has an anchor for about so many bytes
HOT = 64
NO_DOC = np.iinfo(np.int64).max
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def pressed(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def released(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The whole numbers of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def words_at(buf: np.ndarray, start: int, n: int) -> np.ndarray:
    """The 8 bytes from each of n positions on, as numbers."""
    return np.ndarray((n,), "<u8", buf, start, (1,))


def runs(buf: np.ndarray, first: np.ndarray, bits: int = 48) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, count, hash) of runs of neighbouring 50-byte strings with one anchor; first: where documents start, and the end.

    Works through the buffer in tiles, so a very long text needs no more memory than its own.
    """
    size = np.diff(first) - LENGTH + 1
    own = size > 0
    begins, ends = first[:-1][own], (first[:-1] + size)[own]  # strings start in these ranges
    starts, counts, hashes = [], [], []
    for t in range(0, max(0, len(buf) - LENGTH + 1), TILE):
        n = min(TILE, len(buf) - LENGTH + 1 - t)
        lo, hi = np.searchsorted(ends, t, side="right"), np.searchsorted(begins, t + n)
        a, b = np.maximum(begins[lo:hi], t), np.minimum(ends[lo:hi], t + n)
        at = ranges(a - t, b - a)
        if not len(at):
            continue
        m = n + SPAN - 1
        h = words_at(buf, t, m) * MIX[0] + words_at(buf, t + 8, m) * MIX[1] + words_at(buf, t + 16, m) * MIX[2]
        h ^= h >> np.uint64(32)
        h *= MIX[3]
        h ^= h >> np.uint64(29)
        low = (h & ~np.uint64(0xFFFFFF)) | np.arange(m, dtype=np.uint64)
        for step in (1, 2, 4, 8):
            low = np.minimum(low[:-step], low[step:])
        low = np.minimum(low[:n], low[SPAN - 16 : SPAN - 16 + n])
        anchor = (low & np.uint64(0xFFFFFF)).astype(np.int64)[at]
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])
        begin = np.flatnonzero(new)
        starts.append(at[begin] + t)
        counts.append(np.diff(np.concatenate([begin, [len(at)]])))
        hashes.append(h[anchor[begin]] >> np.uint64(64 - bits))
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(hashes)


def hash_bits(total: int) -> int:
    """So many bits that one anchor in thousands meets another's hash by chance."""
    return min(48, max(32, (total // ANCHOR_BYTES + 1).bit_length() + 12))


class Chunk:
    """Documents' ids (with a mark for null) and bytes, one after the other."""

    def __init__(self, meta: bytes, blob: bytes):
        self.buf = np.frombuffer(released(blob) + bytes(32), np.uint8)[:-32]
        self.bytes = self.buf.tobytes()
        columns = np.frombuffer(released(meta), np.int64).reshape(3, -1)
        self.ids, self.null = columns[0], columns[1].astype(bool)
        self.key = np.where(self.null, NO_DOC, self.ids)  # a null id is larger than any other
        self.first = np.concatenate([[0], np.cumsum(columns[2])])

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1


def packed(chunk_bytes: int):
    """Chunks of about chunk_bytes, at least one document each, numbered by task and order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held, n = [], [], 0, 0

        def out() -> pa.RecordBatch:
            meta = np.array([[i or 0 for i in ids], [i is None for i in ids], [len(t) for t in texts]], np.int64)
            row = {"chunk": (TaskContext.get().partitionId() << 32) + n, "meta": pressed(meta.tobytes()), "blob": pressed(b"".join(texts))}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("chunk", pa.int64()), ("meta", pa.binary()), ("blob", pa.binary())]))

        for batch in batches:
            for i, t in zip(batch.column("id").to_pylist(), batch.column("t"), strict=True):
                data = t.as_py() or b""
                if ids and held + len(data) > chunk_bytes:
                    yield out()
                    ids, texts, held, n = [], [], 0, n + 1
                ids.append(i)
                texts.append(data)
                held += len(data)
        if ids:
            yield out()
        give_back()

    return run


def planes(numbers: np.ndarray) -> bytes:
    """Whole numbers byte by byte: all lowest bytes, then the next ones; small numbers and steps compress well so."""
    return np.ascontiguousarray(numbers.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def squeezed(values: np.ndarray) -> bytes:
    """Rising 48-bit numbers as compressed byte planes of their differences."""
    steps = np.diff(values, prepend=np.uint64(0))
    return pressed(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes(), 1)


def unsqueezed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(released(data), np.uint8).reshape(6, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :6] = planes.T
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def by_part(hashes: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places of its hashes), places in the given order."""
    part = hashes % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
    for a, b in zip(first, [*first[1:], len(part)], strict=True):
        yield int(part[a]), order[a:b]


ROUTED = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("payload", pa.binary())])
RETURNED = pa.schema([("chunk", pa.int64()), ("n", pa.int64()), ("payload", pa.binary())])


def contexts(chunk: Chunk, start: np.ndarray, count: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct anchor hashes of the runs, and in how many different runs each stands, counted up to HOT + 1."""
    order = np.argsort(h, kind="stable")
    rising = h[order]
    first = np.flatnonzero(np.concatenate([[True], rising[1:] != rising[:-1]])) if len(h) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([first, [len(h)]]))
    out = np.minimum(sizes, HOT)
    for g in np.flatnonzero(sizes > HOT).tolist():
        seen: set[bytes] = set()
        for i in order[first[g] : first[g] + sizes[g]].tolist():
            seen.add(chunk.bytes[start[i] : start[i] + count[i] + LENGTH - 1])
            if len(seen) > HOT:
                break
        out[g] = len(seen)
    return rising[first], out


def filed(parts: int, bits: int):
    """Each chunk's distinct anchor hashes for each part: once; twice: in two of its documents; three times: hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row["meta"], row["blob"])
                start, count, h = runs(chunk.buf, chunk.first, bits)
                values, n_contexts = contexts(chunk, start, count, h)
                doc = chunk.doc_of(start)
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                own = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
                n = np.minimum(np.unique(h[own], return_counts=True)[1], 2)
                values = np.repeat(values, np.where(n_contexts > HOT, 3, n))
                rows = [{"part": p, "chunk": row["chunk"], "payload": squeezed(values[at])} for p, at in by_part(values, parts)]
                yield pa.RecordBatch.from_pylist(rows, schema=ROUTED)
        give_back()

    return run


def part_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each part, from rows sorted by part."""
    group: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if group and group[0]["part"] != row["part"]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Back to each chunk: its hashes that are in two documents, twice those that are hot in any chunk."""
    for group in part_groups(batches):
        found = [unsqueezed(row["payload"]) for row in group]
        every = np.concatenate(found)
        every.sort()
        values, n = np.unique(every, return_counts=True)
        values = values[n > 1]
        del every, n
        hot = np.unique(np.concatenate([own[2:][own[2:] == own[:-2]] for own in found]))
        rows = []
        for row, own in zip(group, found, strict=True):
            own = np.unique(own)
            both = own[among(own, values)]
            if len(both):
                both = np.sort(np.concatenate([both, both[among(both, hot)]]))
                rows.append({"chunk": row["chunk"], "n": len(both), "payload": squeezed(both)})
        yield pa.RecordBatch.from_pylist(rows, schema=RETURNED)
    give_back()


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is one of the sorted known ones."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def one_by_one(chunk: Chunk, start: np.ndarray, count: np.ndarray, h: np.ndarray, hot: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, count, hash, single) where the strings of runs with a hot anchor stand alone, under their own hash."""
    is_hot = among(h, hot)
    singles = ranges(start[is_hot], count[is_hot])
    own = np.fromiter((xxhash.xxh3_64_intdigest(chunk.bytes[a : a + LENGTH]) >> (64 - bits) for a in singles.tolist()), np.uint64, len(singles))
    rest = ~is_hot
    ones, single = np.ones(len(singles), np.int64), np.concatenate([np.zeros(int(rest.sum()), bool), np.ones(len(singles), bool)])
    return np.concatenate([start[rest], singles]), np.concatenate([count[rest], ones]), np.concatenate([h[rest], own]), single


def segments(parts: int, bits: int):
    """Distinct runs with shared anchors, for each part: hashes, counts, smallest and largest document, place of the first (twice it, and one more for a string of a hot anchor), bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row["meta"], row["blob"])
                known = np.sort(np.concatenate([unsqueezed(p) for p in row["payloads"]]))
                start, count, h = runs(chunk.buf, chunk.first, bits)
                own = among(h, known)
                start, count, h, single = one_by_one(chunk, start[own], count[own], h[own], known[1:][known[1:] == known[:-1]], bits)
                key = chunk.key[chunk.doc_of(start)]
                place: dict[bytes, int] = {}
                data = chunk.bytes
                group = np.fromiter((place.setdefault(data[a:b], len(place)) for a, b in zip(start.tolist(), (start + count + LENGTH - 1).tolist(), strict=True)), np.int64, len(start))
                least, most = np.full(len(place), NO_DOC), np.full(len(place), np.iinfo(np.int64).min)
                np.minimum.at(least, group, key)
                np.maximum.at(most, group, key)
                _, first = np.unique(group, return_index=True)
                start, count, h, texts = 2 * start[first] + single[first], count[first], h[first], list(place)
                rows = []
                for p, at in by_part(h, parts):
                    at = at[np.argsort(h[at], kind="stable")]
                    head = planes(np.concatenate([np.diff(h[at].view(np.int64), prepend=0), count[at], least[at], most[at], start[at]]))
                    rows.append({"part": p, "chunk": row["chunk"], "payload": pressed(len(at).to_bytes(8, "little") + head + b"".join([texts[i] for i in at.tolist()]))})
                yield pa.RecordBatch.from_pylist(rows, schema=ROUTED)
        give_back()

    return run


def ranked(keys: np.ndarray) -> np.ndarray:
    """Dense bucket numbers of equal keys."""
    order = np.argsort(keys)
    rising = keys[order]
    step = np.empty(len(keys), np.uint64)
    step[:1] = 0
    np.not_equal(rising[1:], rising[:-1], out=step[1:], casting="unsafe")
    out = np.empty(len(keys), np.uint64)
    out[order] = np.cumsum(step, dtype=np.uint64)
    return out


def buckets(text: bytes, strings: np.ndarray) -> np.ndarray:
    """The bucket of the 50-byte string at each given place of the text, by bucket-pointer refinement."""
    buf = np.frombuffer(text + bytes(8), np.uint8)
    pointer = ranked(words_at(buf, 0, len(text)))  # initial buckets: 8-grams
    for depth in (8, 16):
        later = np.zeros_like(pointer)
        later[:-depth] = pointer[depth:]
        pointer = ranked(pointer << np.uint64(32) | later)
    return ranked(pointer[strings] << np.uint64(32) | pointer[strings + LENGTH - 32])


def least_documents(text: bytes, size: np.ndarray, count: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each 50-byte string of the segments that make up the text, the smallest document that has it."""
    start = np.cumsum(size) - size
    strings = ranges(start, count)
    bucket = buckets(text, strings).astype(np.int64)
    least = np.full(int(bucket.max()) + 1 if len(bucket) else 0, NO_DOC)
    np.minimum.at(least, bucket, np.repeat(key, count))
    return least[bucket]


def refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Back to each chunk: the smallest document of each string of its segments, where that is smaller than one of the chunk's that have it."""
    for group in part_groups(batches):
        heads, bodies = [], []
        for row in group:
            data = released(row.pop("payload"))
            n = int.from_bytes(data[:8], "little")
            head = from_planes(data[8 : 8 + 40 * n]).reshape(5, n)
            head[0] = np.cumsum(head[0])
            heads.append(head)
            bodies.append(data[8 + 40 * n :])
        source = np.repeat(np.arange(len(group)), [x.shape[1] for x in heads])
        h, count, key, most, start = np.concatenate(heads, axis=1)
        size = count + LENGTH - 1
        at = np.concatenate([np.cumsum(s + LENGTH - 1) - (s + LENGTH - 1) for s in (x[1] for x in heads)])
        order = np.argsort(h, kind="stable")
        best, best_at = np.zeros(int(count.sum()), np.int64), np.cumsum(count) - count
        begin = 0
        while begin < len(order):  # whole groups of one hash, about BATCH_BYTES at a time
            end, held = begin, 0
            while end < len(order) and (held < BATCH_BYTES or h[order[end]] == h[order[end - 1]]):
                held += int(size[order[end]])
                end += 1
            own = order[begin:end]
            place: dict[bytes, int] = {}  # segments that are equal as a whole are refined once
            texts = (bodies[s][a : a + z] for s, a, z in zip(source[own].tolist(), at[own].tolist(), size[own].tolist(), strict=True))
            group_of = np.fromiter((place.setdefault(t, len(place)) for t in texts), np.int64, len(own))
            least = np.full(len(place), NO_DOC)
            np.minimum.at(least, group_of, key[own])
            _, one = np.unique(group_of, return_index=True)
            counts = count[own][one]
            found = least_documents(b"".join(place), size[own][one], counts, least)
            best[ranges(best_at[own], count[own])] = found[ranges((np.cumsum(counts) - counts)[group_of], count[own])]
            begin = end
        smallest = np.minimum.reduceat(best, best_at) if len(best) else best
        told = smallest < most
        rows, ends = [], np.cumsum([x.shape[1] for x in heads]).tolist()
        for row, begin, end in zip(group, [0, *ends], ends, strict=False):
            mine = begin + np.flatnonzero(told[begin:end])
            if len(mine):
                flat = np.concatenate([[len(mine)], start[mine], count[mine], best[ranges(best_at[mine], count[mine])]])
                rows.append({"chunk": row["chunk"], "n": len(mine), "payload": pressed(planes(flat))})
        yield pa.RecordBatch.from_pylist(rows, schema=RETURNED)
    give_back()


RESULT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])


def removed(chunk: Chunk, payloads: list[bytes] | None, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(document, whether each of its bytes goes) for the chunk's documents in which any goes."""
    place: dict[bytes, np.ndarray] = {}
    at, single = [], []
    for p in payloads or ():
        flat = from_planes(released(p))
        n = int(flat[0])
        start, count = flat[1 : n + 1], flat[n + 1 : 2 * n + 1]
        at.append(start >> 1)
        single.append(start & 1)
        for a, c, own in zip((start >> 1).tolist(), count.tolist(), np.split(flat[2 * n + 1 :], np.cumsum(count)[:-1]), strict=True):
            place[chunk.bytes[a : a + c + LENGTH - 1]] = own
    if not place:
        return
    start, count, h = runs(chunk.buf, chunk.first, bits)
    at, single = np.concatenate(at), np.concatenate(single).astype(bool)
    anchors = h[np.searchsorted(start, at, side="right") - 1]  # of the runs that they stand in
    whole, hot = among(h, np.unique(anchors[~single])), np.unique(anchors[single])
    starts, counts, least = [], [], []
    for a, c in zip(start[whole].tolist(), count[whole].tolist(), strict=True):
        own = place.get(chunk.bytes[a : a + c + LENGTH - 1])
        if own is not None:
            starts.append(a)
            counts.append(c)
            least.append(own)
    is_hot = among(h, hot)
    for a in ranges(start[is_hot], count[is_hot]).tolist():
        own = place.get(chunk.bytes[a : a + LENGTH])
        if own is not None:
            starts.append(a)
            counts.append(1)
            least.append(own)
    if not starts:
        return
    at = ranges(np.array(starts), np.array(counts))
    doc = chunk.doc_of(at)
    gone = np.concatenate(least) < chunk.key[doc]
    at, doc = at[gone], doc[gone]
    order = np.argsort(doc, kind="stable")
    at, doc = at[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(doc)], strict=True):
        n = int(doc[a])
        edge = np.zeros(int(chunk.first[n + 1] - chunk.first[n]) + 1, np.int32)
        own = at[a:b] - chunk.first[n]
        np.add.at(edge, own, 1)
        np.add.at(edge, own + LENGTH, -1)
        yield n, np.cumsum(edge[:-1]) > 0


def cleaned(with_text: bool, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row["meta"], row["blob"])
                gone = dict(removed(chunk, row["payloads"], bits))
                rows = []
                for n, (a, b) in enumerate(zip(chunk.first[:-1].tolist(), chunk.first[1:].tolist(), strict=True)):
                    own = gone.pop(n, None)
                    kept = chunk.bytes[a:b] if own is None else chunk.buf[a:b][~own].tobytes()
                    spans = 0 if own is None else int(own[:1].sum() + (own[1:] & ~own[:-1]).sum())
                    rows.append((None if chunk.null[n] else int(chunk.ids[n]), b - a, b - a - len(kept), spans, kept if with_text else None, hashlib.sha256(kept).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), RESULT.types, strict=True)], schema=RESULT)
        give_back()

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, chunk_bytes: int = CHUNK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept, kept_sha256): a row for each row of df.

    Each byte goes that lies in a 50-byte string which also starts in a document of a smaller id.
    kept: the remaining bytes (null unless with_text; they may cut through a character). A null
    text counts as empty; texts under 50 bytes stay whole; a text longer than chunk_bytes is a chunk
    of its own. Rows that repeat an id are documents of equal rank: neither removes from the other. A
    null id ranks after all others. No rows give no rows. Only the two columns are read.

    A task holds a chunk of about chunk_bytes, and the anchors or segments of a part, those of about
    part_bytes of text.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    total = rows.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    bits, cores = hash_bits(total), spark.sparkContext.defaultParallelism
    tasks, parts = (max(2 * cores, -(-total // size)) for size in (chunk_bytes, part_bytes))
    chunks = cut_by(rows.mapInArrow(packed(chunk_bytes), "chunk long, meta binary, blob binary"), tasks, "chunk")
    routed, returned = "part long, chunk long, payload binary", "chunk long, n long, payload binary"
    meet = lambda df, n: df.repartition(n, "part").sortWithinPartitions("part")
    gather = lambda df: df.repartition(tasks, "chunk").groupBy("chunk").agg(F.collect_list("payload").alias("payloads"), F.sum("n").alias("n"))  # noqa: E731  bounded by the chunk's own runs
    back = cut(gather(meet(chunks.mapInArrow(filed(parts, bits), routed), parts).mapInArrow(shared, returned)))
    met = (back.agg(F.sum("n").alias("n")).first()["n"] or 0) * (LENGTH + ANCHOR_BYTES)  # bytes of shared segments, about
    parts = max(2 * cores, -(-met // (part_bytes // SEGMENT_SHARE)))
    cutout = chunks.join(back.repartition(tasks, "chunk"), "chunk").mapInArrow(segments(parts, bits), routed)
    verdicts = gather(meet(cutout, parts).mapInArrow(refined, returned))
    found = chunks.join(verdicts, "chunk", "left").mapInArrow(cleaned(with_text, bits), "id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return found.withColumnRenamed("id", id_col)
