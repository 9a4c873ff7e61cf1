"""State machines over ordered signals of any length, run in parts.

A signal is the rows of a key in order. Rows are dealt in ranges of key and order, so a long signal lies
in several neighbouring parts, each in a task of its own. A part that begins amid a signal needs the state its
predecessor ends in. All parts run at once from the states known so far and report the state they end in;
parts whose first state has changed run again, until none does. A machine that forgets, as filters and
smoothers do, settles after a second look; in any case one more part is right after each round, so
the rows are those of one task that runs through the whole signal. Only one state for each part goes
through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvana.session import cut


class Machine:
    """first: the state at a signal's start; outputs: the names of what it gives for each sample; run: the next state and an array of samples x outputs, from a state and an array of samples x channels."""

    first: np.ndarray
    outputs: tuple[str, ...]

    def run(self, state: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError


class Each(Machine):
    """A step from (state, value) to (state, output), value by value."""

    def __init__(self, first: tuple, step: Callable, output: str = "y"):
        self.first, self.step, self.outputs = np.array(first, float), step, (output,)

    def run(self, state: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held, found, step = tuple(state.tolist()), [], self.step
        for value in x[:, 0].tolist():
            held, y = step(held, value)
            found.append(y)
        return np.array(held, float), np.array(found, float)[:, None]


class Cascade(Machine):
    """Second-order sections one after the other, y = b0 x + b1 x1 + b2 x2 - a1 y1 - a2 y2 each.

    A section is linear: over a block its output is the response to the block from rest (one product with
    the impulse response for all blocks) and to the four numbers of the state it begins in, which are handed
    from block to block.
    """

    BLOCK = 128

    def __init__(self, *sections: dict[str, float], output: str = "y"):
        self.sections, self.outputs = sections, (output,)
        self.first = np.zeros(4 * len(sections))
        self.rest = [self.responses(c) for c in sections]

    @staticmethod
    def recursion(c: dict[str, float], state: Sequence[float], x: Sequence[float]) -> list[float]:
        (y1, y2, x1, x2), found = state, []
        for v in x:
            y = c["b0"] * v + c["b1"] * x1 + c["b2"] * x2 - c["a1"] * y1 - c["a2"] * y2
            y1, y2, x1, x2 = y, y1, v, x1
            found.append(y)
        return found

    def responses(self, c: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        """The outputs of a block from rest as a matrix, and those of no input from each number of the state."""
        n = self.BLOCK
        impulse = np.array(self.recursion(c, (0.0,) * 4, [1.0] + [0.0] * (n - 1)))
        at = np.subtract.outer(np.arange(n), np.arange(n))
        from_rest = np.where(at >= 0, impulse[np.maximum(at, 0)], 0.0)
        from_state = np.array([self.recursion(c, unit, [0.0] * n) for unit in np.eye(4).tolist()]).T
        return from_rest, from_state

    def section(self, n: int, state: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c, (from_rest, from_state), size = self.sections[n], self.rest[n], self.BLOCK
        whole = len(x) - len(x) % size
        out = np.empty(len(x))
        blocks = x[:whole].reshape(-1, size)
        given = blocks @ from_rest.T
        for i in range(len(blocks)):
            y = given[i] + from_state @ state
            out[i * size : (i + 1) * size] = y
            state = np.array([y[-1], y[-2], blocks[i, -1], blocks[i, -2]])
        tail = x[whole:].tolist()
        out[whole:] = self.recursion(c, state.tolist(), tail)
        if tail:
            ys, xs = [*state[1::-1], *out[whole:]], [*state[3:1:-1], *tail]
            state = np.array([ys[-1], ys[-2], xs[-1], xs[-2]])
        return state, out

    def run(self, state: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held, y = [], x[:, 0]
        for n in range(len(self.sections)):
            part, y = self.section(n, state[4 * n : 4 * n + 4], y)
            held.append(part)
        return np.concatenate(held) if held else state, y[:, None]


class Smoother(Machine):
    """Follows rises and falls at different rates, from below not under least.

    damping: (reference, curvature) slows small steps down: the step is scaled by m / (m + reference),
    where m is curvature times the distance; no step where both are 0.
    """

    def __init__(self, up: float, down: float, initial: float = 0.0, least: float = -math.inf, damping: tuple[float, float] | None = None, output: str = "y"):
        self.up, self.down, self.least, self.damping = up, down, least, damping
        self.first, self.outputs = np.array([initial], float), (output,)

    def follow(self, y: float, x: np.ndarray) -> tuple[float, np.ndarray]:
        up, down, least, found = self.up, self.down, self.least, np.empty(len(x))
        if self.damping is None:
            for i, v in enumerate(x.tolist()):
                y += (v - y) * (up if v >= y else down)
                if y < least:
                    y = least
                found[i] = y
        else:
            reference, curvature = self.damping
            for i, v in enumerate(x.tolist()):
                rest = v - y
                size = abs(rest) * curvature
                y = max(y + rest * (up if rest >= 0 else down) * (size / (size + reference) if size + reference else 0.0), least)
                found[i] = y
        return y, found

    def run(self, state: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y, found = self.follow(float(state[0]), x[:, 0])
        return np.array([y]), found[:, None]


class Changes(Machine):
    """How often a value has changed so far, from 0 on: the number of the run that each sample is in."""

    def __init__(self, output: str = "run"):
        self.first, self.outputs = np.array([np.nan, 0.0]), (output,)

    def run(self, state: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(x):
            return state, np.empty((0, 1))
        before = np.concatenate([[x[0, 0] if np.isnan(state[0]) else state[0]], x[:-1, 0]])
        found = state[1] + np.cumsum(before != x[:, 0])
        return np.array([x[-1, 0], found[-1]]), found[:, None]


class Latest(Machine):
    """The second channel's latest value where the first one is 0, not a number before there is any."""

    def __init__(self, output: str = "latest"):
        self.first, self.outputs = np.array([np.nan]), (output,)

    def run(self, state: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.maximum.accumulate(np.where(x[:, 0] == 0, np.arange(1, len(x) + 1), 0)) if len(x) else np.zeros(0, int)
        found = np.concatenate([state, x[:, 1]])[at]
        return found[-1:] if len(x) else state, found[:, None]


class RunningMean(Machine):
    """The mean of the first channel's values so far, of the rows where the second is 1; not a number before the first of them."""

    def __init__(self, output: str = "mean"):
        self.first, self.outputs = np.zeros(2), (output,)

    def run(self, state: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = state + np.cumsum(x * x[:, 1:], axis=0)
        found = np.divide(sums[:, 0], sums[:, 1], out=np.full(len(x), np.nan), where=sums[:, 1] > 0)
        return sums[-1] if len(x) else state, found[:, None]


def decaying(peak: float, x: np.ndarray, decay: float, kind: str = "maximum", ticks: np.ndarray | None = None) -> np.ndarray:
    """peak = max(x, peak - decay) after each value, or its mirror; where ticks is false a value neither counts nor lets the peak decay."""
    sign = 1.0 if kind == "maximum" else -1.0
    own = np.ones(len(x), bool) if ticks is None else ticks
    passed = np.cumsum(own) * decay
    best = np.maximum.accumulate(np.where(own, sign * x + passed, -np.inf)) if len(x) else x
    return sign * (np.maximum(best, sign * peak) - passed)


def runs(batch: pa.RecordBatch, key: str) -> list[tuple[object, slice]]:
    """The keys of a sorted batch, each with its rows."""
    codes = batch.column(key).dictionary_encode(null_encoding="encode")
    at = codes.indices.to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, int)
    ends = [*first[1:].tolist(), len(at)]
    names = codes.dictionary.to_pylist()
    return [(names[at[a]], slice(a, b)) for a, b in zip(first.tolist(), ends, strict=False)]


def samples(batch: pa.RecordBatch, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The values as samples x channels, and the rows where none is null."""
    columns = [batch.column(v).cast(pa.float64()) for v in values]
    there = np.ones(batch.num_rows, bool)
    for c in columns:
        there &= c.is_valid().to_numpy(zero_copy_only=False)
    return np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1), there


def walk(batches: Iterator[pa.RecordBatch], key: str, values: list[str], machine: Machine, start: np.ndarray | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, tuple]]:
    """Runs the machine over a part: for each batch its outputs, the rows that have any, and (first key, last key, state, whether one key fills all so far)."""
    first, held, state, alone = None, None, machine.first, True
    begun = False
    for batch in batches:
        x, there = samples(batch, values)
        found = np.full((batch.num_rows, len(machine.outputs)), np.nan)
        for k, rows in runs(batch, key):
            if not begun:
                begun, first, held, state = True, k, k, machine.first if start is None else start
            elif k != held:
                held, state, alone = k, machine.first, False
            own = there[rows]
            state, found[np.flatnonzero(own) + rows.start] = machine.run(state, x[rows][own])
        yield batch, found, there, (first, held, state, alone)


def with_outputs(rows: DataFrame, key: str, values: list[str], machine: Machine, starts: dict[int, np.ndarray]) -> DataFrame:
    """rows, sorted in their partitions, with the machine's outputs, which stand for columns of the same names; starts: of partitions that begin amid a signal."""
    kept = [f for f in rows.schema.fields if f.name not in machine.outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found, there, _ in walk(batches, key, values, machine, starts.get(TaskContext.get().partitionId())):
            columns = [pa.array(found[:, n], pa.float64(), mask=~there) for n in range(len(machine.outputs))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *columns], names=[*(f.name for f in kept), *machine.outputs])

    return rows.mapInArrow(run, T.StructType([*kept, *(T.StructField(n, T.DoubleType()) for n in machine.outputs)]))


def in_parts(df: DataFrame, key: str, order: list[str], values: str | list[str], machine: Machine, parts: int | None = None) -> DataFrame:
    """df with the machine's outputs at each row, over each key's rows in order, however many tasks they take.

    A row where a value is null leaves the state as it is and has null outputs. A null key is a key like any
    other. parts: how many ranges the rows are dealt in; otherwise as many as Spark shuffles into.
    """
    values = [values] if isinstance(values, str) else list(values)
    spark = df.sparkSession
    n_parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(df.repartitionByRange(n_parts, key, *order).sortWithinPartitions(key, *order))
    kind = rows.schema[key].dataType
    summary = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("first", kind), T.StructField("last", kind), T.StructField("alone", T.BooleanType()), T.StructField("state", T.ArrayType(T.DoubleType()))])

    def ends(starts: dict[int, np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, last, of_key = TaskContext.get().partitionId(), None, None
            for batch, _, _, told in walk(batches, key, values, machine, starts.get(TaskContext.get().partitionId())):
                if batch.num_rows:
                    last, of_key = told, batch.schema.field(key).type
            if last is not None:
                first, held, state, alone = last
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([first], of_key), pa.array([held], of_key), pa.array([alone]), pa.array([state.tolist()], pa.list_(pa.float64()))],
                    names=["part", "first", "last", "alone", "state"],
                )

        return run

    needed = [key, *values]
    told = {r["part"]: r for r in rows.select(*needed).mapInArrow(ends({}), summary).collect()}  # a row for each part
    state = {p: np.array(r["state"]) for p, r in told.items()}
    starts: dict[int, np.ndarray] = {}
    while True:
        changed, before = [], None
        for p in sorted(told):
            if before is not None and told[before]["last"] == told[p]["first"]:
                if p not in starts or not np.array_equal(starts[p], state[before], equal_nan=True):
                    starts[p] = state[before]
                    changed.append(p)
            before = p
        again = [p for p in changed if told[p]["alone"]]  # the others end in a key that begins in them
        if not again:
            break
        some = rows.select(*needed).where(F.spark_partition_id().isin(again))
        for r in some.mapInArrow(ends({p: starts[p] for p in again}), summary).collect():
            state[r["part"]] = np.array(r["state"])

    return with_outputs(rows, key, values, machine, starts)


def by_key(df: DataFrame, key: str, order: list[str], values: str | list[str], machine: Machine) -> DataFrame:
    """in_parts() for signals that each fit a task: rows are dealt by key and go through once."""
    values = [values] if isinstance(values, str) else list(values)
    return with_outputs(df.repartition(key).sortWithinPartitions(key, *order), key, values, machine, {})


MOST = 1 << 20  # rows of a key that one task takes


def is_long(df: DataFrame, key: str, most: int = MOST) -> bool:
    """Whether any key has more rows than one task should take."""
    return (df.groupBy(key).count().agg(F.max("count")).first()[0] or 0) > most


def machined(df: DataFrame, key: str, order: list[str], values: str | list[str], machine: Machine, most: int = MOST) -> DataFrame:
    """The machine's outputs at each row: dealt by key where no key has more than `most` rows, else in parts. The rows are the same."""
    return in_parts(df, key, order, values, machine) if is_long(df, key, most) else by_key(df, key, order, values, machine)
