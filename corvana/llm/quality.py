"""Quality scores: kernel ridge by random Fourier features over document statistics, calibrated by isotonic regression.

1. One pass over all texts turns each into a row of statistics: shares of kinds of characters, repeats of
   words and lines, runs of signs, lengths. A text is read in segments of SEGMENT bytes, whose sums
   are added, so that a text of any length takes bounded memory. Means and deviations are taken over all documents.
2. cos(W x + b), with W drawn from a normal distribution and b from a uniform one, has the Gaussian kernel
   exp(-|x - y|^2 / (2 * WIDTH^2 * number of statistics)) as its mean inner product. Draws are fixed by SEED.
3. Each task sums its rows' share of the normal equations; the sums are added in two steps, first by
   group of tasks, so that no task adds up more than a part of them, and solved on the driver: FEATURES + 1
   rows of as many numbers, whatever the input.
4. Isotonic regression (pool adjacent violators) over BINS counted bins of the ridge score of other labelled rows
   makes it a probability; between the pools' centres it is drawn linearly, so order is kept.

Labels are taken only from rows whose crc32(id as text) mod 4 is not 2: 0 and 1 fit the ridge, 3 the
calibration. All of them are used, none is sampled. Neither labels nor ids, languages or sources are inputs
of a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvana.llm.batches import mapper
from corvana.llm.toxicity import HELD_OUT_MOD, held_out
from corvana.session import cut

FEATURES, WIDTH, RIDGE, SEED = 512, 0.6, 1.0, 42
BINS, CALIBRATES = 2_048, 3
THRESHOLD = 0.7
SEGMENT = 64 << 10
SPREAD = 64  # groups of tasks whose sums are added first

KINDS = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "blank": (32, 9), "line": (10, 13),
    "stop": b".,;:", "cry": b"!?", "quote": b"'\"()-", "rule": b"|_=~", "mark": b"#$%&*@^+", "bracket": b"<>[]{}\\/", "high": range(128, 256),
}
KIND = np.zeros((256, len(KINDS)))
for _n, _codes in enumerate(KINDS.values()):
    KIND[list(_codes), _n] = 1
RUN = re.compile(rb"([^\w\s\x80-\xff])\1+")
SUMS = ("words", "distinct", "repeats", "longest", "letters", "signs", "runs", "lines", "distinct_lines", "ended", "segments")
N_STATISTICS = len(KINDS) + 12


def segments(data: bytes, size: int = SEGMENT) -> Iterator[bytes]:
    """The bytes in segments of at most size, cut after a blank where there is one."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            blank = max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end))
            end = blank + 1 if blank > at else end
        yield data[at:end]
        at = end


def statistics(text: bytes | None) -> np.ndarray:
    """The statistics of a text in UTF-8; of a null text those of an empty one."""
    data = text or b""
    counts, total = np.zeros(256), dict.fromkeys(SUMS, 0.0)
    for part in segments(data):
        counts += np.bincount(np.frombuffer(part, np.uint8), minlength=256)
        words, lines = part.split(), part.split(b"\n")
        same = [a == b for a, b in zip(words, words[1:], strict=False)]
        total["words"] += len(words)
        total["distinct"] += len(set(words))
        total["repeats"] += sum(same)
        total["letters"] += sum(map(len, words))
        total["longest"] = max(total["longest"], max(map(len, words), default=0))
        total["signs"] += sum(map(len, map(re.Match.group, RUN.finditer(part))))
        total["runs"] += sum(1 for w in words if not w[0:1].isalnum() and w[0] < 128)
        total["lines"] += len(lines)
        total["distinct_lines"] += len(set(lines))
        total["ended"] += sum(x[-1:] in (b".", b"!", b"?") for x in lines)
        total["segments"] += 1
    n, words, lines = max(len(data), 1), max(total["words"], 1), max(total["lines"], 1)
    share = counts / n
    used = share[share > 0]
    rest = [
        np.log1p(len(data)), np.log1p(total["words"]), np.log1p(total["lines"]), total["letters"] / words, np.log1p(total["longest"]), total["distinct"] / words,
        total["repeats"] / words, total["signs"] / n, total["runs"] / words, total["distinct_lines"] / lines, total["ended"] / lines, -float(used @ np.log2(used)),
    ]
    return np.concatenate([np.sqrt(share @ KIND), rest])  # roots: small shares of odd characters tell more than their size


SEEN = "id long, x binary"


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): each row's statistics as bytes of doubles, in one pass without a shuffle."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("t").cast(pa.large_binary())
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array([statistics(t).tobytes() for t in texts.to_pylist()], pa.binary())], names=["id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(mapper(kernel, "t"), SEEN)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


SUMMED = "part int, i int, s binary"


def summed(rows: DataFrame, partial, n_rows: int, width: int) -> np.ndarray:
    """The sum over all batches of what partial makes of each, an array of n_rows x width; each task adds its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_rows, width))
        for batch in batches:
            total += partial(batch)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part] * n_rows, pa.int32()), pa.array(range(n_rows), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["part", "i", "s"])

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")  # in one order, so that a task run again adds up to the same
        return pa.table({"part": table["part"][:1], "i": table["i"][:1], "s": pa.array([matrix(table["s"], width).sum(axis=0).tobytes()], pa.binary())})

    by_group = rows.mapInArrow(run, SUMMED).groupBy(F.col("part") % SPREAD, "i").applyInArrow(add, SUMMED)
    found = by_group.groupBy("i").applyInArrow(add, SUMMED).select("i", "s").collect()  # n_rows rows
    total = np.zeros((n_rows, width))
    for r in found:
        total[r["i"]] = np.frombuffer(r["s"], np.float64)
    return total


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    ridge: np.ndarray  # of the random features, and of one
    level: tuple[np.ndarray, np.ndarray]  # ridge scores and the probabilities there

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        w = rng.normal(size=(N_STATISTICS, FEATURES)) / (WIDTH * np.sqrt(N_STATISTICS))
        b = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.sqrt(2 / FEATURES) * np.cos(np.clip((x - self.mean) / self.scale, -8, 8) @ w + b)
        return np.concatenate([z, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.ridge

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.level)


def pooled(at: np.ndarray, n: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of positive / n over the places at, in order: the centres and levels of its pools. Each pool counts half a row of either label, so no level is 0 or 1."""
    pools: list[list[float]] = []  # place * rows, rows, positive rows
    for x, count, ones in zip(at.tolist(), n.tolist(), positive.tolist(), strict=True):
        pools.append([x * count, count, ones])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    centre = np.array([p[0] / p[1] for p in pools])
    level = np.maximum.accumulate(np.array([(p[2] + 0.5) / (p[1] + 1) for p in pools]))
    return centre, level


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[Model, DataFrame]:
    """The model, and described() of docs.

    Without labelled rows of both kinds every score is the share of label 1 among the labelled rows,
    one of each kind added. Where an id repeats, its label holds for all its rows; where a label repeats, the largest holds. Rows without an id are scored and not fitted on.
    """
    seen = cut(described(docs, id_col, text_col))
    width = N_STATISTICS

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch.column("x"), width)
        return np.stack([np.full(width, float(len(x))), x.sum(axis=0), (x * x).sum(axis=0)])

    n, total, squares = summed(seen, moments, 3, width)
    mean = total / np.maximum(n, 1)
    spread = np.sqrt(np.maximum(squares / np.maximum(n, 1) - mean**2, 0))
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0), np.zeros(FEATURES + 1), (np.zeros(1), np.full(1, 0.5)))

    known = labels.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) > 0).cast("int").alias("y"))
    known = known.where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
    told = cut(seen.where("id is not null").join(known, "id"))
    calibrates = F.crc32(F.col("id").cast("string")) % HELD_OUT_MOD == CALIBRATES

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        z = model.features(matrix(batch.column("x"), width))
        y = batch.column("y").to_numpy(zero_copy_only=False).astype(np.float64)
        return np.concatenate([z.T @ z, (z.T @ y)[:, None]], axis=1)

    sums = summed(told.where(~calibrates).select("x", "y"), equations, FEATURES + 1, FEATURES + 2)
    penalty = RIDGE * np.eye(FEATURES + 1)
    penalty[-1, -1] = 1e-9  # the constant is free
    model.ridge = np.linalg.solve(sums[:, :-1] + penalty, sums[:, -1])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.clip(np.rint((model.raw(matrix(batch.column("x"), width)) + 0.5) / 2 * BINS), 0, BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("y")], names=["bin", "y"])

    bins = told.where(calibrates).select("x", "y").mapInArrow(binned, "bin int, y int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).orderBy("bin").collect()  # BINS + 1 rows at most
    ones, rows = told.agg(F.sum("y"), F.count("*")).first()
    if bins and 0 < (ones or 0) < rows:
        at, count, positive = (np.array([float(r[k]) for r in bins]) for k in ("bin", "n", "ones"))
        model.level = pooled(at / BINS * 2 - 0.5, count, positive)
    else:
        model.level = (np.zeros(1), np.full(1, ((ones or 0) + 1) / (rows + 2)))
    return model, seen


def score(seen: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id_col, score) of each row of described(), without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.scores(matrix(batch.column("x"), N_STATISTICS)), pa.float64())], names=["id", "score"])

    return seen.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)


def verdicts(scored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The held-out mark, score and decision of each row; a null id isn't held out."""
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
