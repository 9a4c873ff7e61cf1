"""Seeded random numbers that are the same on every run and machine, for kernels and as columns."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corvana.functions.vectors import let

MASK = 0xFFFFFFFF
OFFSET = 3_077_908_504


class XorShift32:
    """xorshift with 32 bits of state and shifts of 13, 17 and 5."""

    def __init__(self, seed: int = 0):
        self.state = (OFFSET + seed) & MASK or 1

    def next_int32(self) -> int:
        x = self.state
        x ^= x << 13 & MASK
        x ^= x >> 17
        x ^= x << 5 & MASK
        self.state = x
        return x - (1 << 32) if x >> 31 else x

    def uniform(self) -> float:
        return (self.next_int32() & MASK) / 2**32

    def float_in(self, low: float, high: float) -> float:
        return low + self.uniform() * (high - low)

    def int_in(self, low: int, high: int) -> int:
        return math.floor(self.float_in(low, high))

    def normal_pair(self, mean: float = 0.0, deviation: float = 1.0) -> tuple[float, float]:
        """By the polar method."""
        while True:
            a, b = self.float_in(-1, 1), self.float_in(-1, 1)
            s = a * a + b * b
            if 0 < s < 1:
                f = math.sqrt(-2 * math.log(s) / s)
                return mean + deviation * a * f, mean + deviation * b * f

    def normals(self, n: int, mean: float = 0.0, deviation: float = 1.0) -> list[float]:
        out: list[float] = []
        while len(out) < n:
            out += self.normal_pair(mean, deviation)
        return out[:n]

    def shuffled(self, items: list) -> list:
        out = list(items)
        for i in range(len(out) - 1):
            j = self.int_in(i, len(out))
            out[i], out[j] = out[j], out[i]
        return out


def seeded(seed: Column) -> Column:
    """XorShift32's state for a seed, as a column; the state is an unsigned number."""
    state = (seed.cast("long") + OFFSET).bitwiseAND(F.lit(MASK))
    return F.when(state == 0, F.lit(1).cast("long")).otherwise(state)


def following(state: Column) -> Column:
    """The state after this one, which is the number drawn."""
    low = lambda x: x.bitwiseAND(F.lit(MASK))
    return let(let(let(state, lambda x: x.bitwiseXOR(low(F.shiftleft(x, 13)))), lambda x: x.bitwiseXOR(F.shiftright(x, 17))), lambda x: x.bitwiseXOR(low(F.shiftleft(x, 5))))


def signed(state: Column) -> Column:
    return F.when(state >= 1 << 31, state - (1 << 32)).otherwise(state)


def uniform(state: Column) -> Column:
    return state / F.lit(float(1 << 32))


# columns of several draws: the generators of a batch's rows step together, so a row's numbers are its seed's, whatever its partition


def states(seed: np.ndarray) -> np.ndarray:
    state = (seed + OFFSET) & MASK
    return np.where(state == 0, 1, state)


def stepped(state: np.ndarray) -> np.ndarray:
    state = state ^ (state << 13 & MASK)
    state = state ^ (state >> 17)
    return state ^ (state << 5 & MASK)


def permutations(seeds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each row the places 0 to its size - 1 in drawn order, then what lies beyond: at each place in turn one of those from it on is put there."""
    out = np.tile(np.arange(int(sizes.max(initial=0))), (len(sizes), 1))
    state = states(seeds)
    for i in range(out.shape[1]):
        live = np.flatnonzero(sizes > i)
        state[live] = stepped(state[live])
        j = np.floor(i + state[live] / 2**32 * (sizes[live] - i)).astype(np.int64)
        out[live, i], out[live, j] = out[live, j], out[live, i]
    return out


def shuffled(items: Column, seed: Column) -> Column:
    """An array of whole numbers in an order that a generator with this seed draws; null for null."""

    @F.pandas_udf("array<long>")
    def kernel(x: pd.Series, seeds: pd.Series) -> pd.Series:
        there = (x.notna() & seeds.notna()).to_numpy()
        own = [np.asarray(v, np.int64) for v in x[there]]
        sizes = np.array([len(v) for v in own], np.int64)
        order = permutations(seeds[there].to_numpy(np.int64), sizes)
        found = iter([v[o[: len(v)]] for v, o in zip(own, order, strict=True)])
        return pd.Series([next(found) if t else None for t in there])

    return kernel(items, seed)


def normals(seed: Column, count: Column, mean: Column | float = 0.0, deviation: Column | float = 1.0) -> Column:
    """count normal numbers of a generator with this seed, by the polar method with its rejections; null for a null argument."""
    given = [c if isinstance(c, Column) else F.lit(c) for c in (mean, deviation)]

    @F.pandas_udf("array<double>")
    def kernel(seeds: pd.Series, counts: pd.Series, means: pd.Series, deviations: pd.Series) -> pd.Series:
        there = (seeds.notna() & counts.notna() & means.notna() & deviations.notna()).to_numpy()
        n = counts[there].to_numpy(np.int64)
        state, out = states(seeds[there].to_numpy(np.int64)), np.zeros((len(n), int(n.max(initial=0)) + 2))
        have = np.zeros(len(n), np.int64)
        while len(live := np.flatnonzero(have < n)):
            first = stepped(state[live])
            state[live] = second = stepped(first)
            a, b = first / 2**32 * 2 - 1, second / 2**32 * 2 - 1
            square = a * a + b * b
            good = (square > 0) & (square < 1)
            live, a, b, square = live[good], a[good], b[good], square[good]
            factor = np.sqrt(-2 * np.log(square) / square)
            out[live, have[live]], out[live, have[live] + 1] = a * factor, b * factor
            have[live] += 2
        m, d = means[there].to_numpy(float), deviations[there].to_numpy(float)
        found = iter([m[k] + d[k] * out[k, : n[k]] for k in range(len(n))])
        return pd.Series([next(found) if t else None for t in there])

    return kernel(seed, count, *given)


def pick(weights: list[float], generator: XorShift32) -> int:
    """The first place whose running sum passes a uniform share of the total."""
    mark, run = generator.uniform() * sum(weights), 0.0
    for i, w in enumerate(weights):
        run += w
        if run > mark:
            return i
    return len(weights) - 1


def packed(parts: list[str], limit: int, size: Callable[[str], int] = len, glue: int = 1) -> Iterator[list[str]]:
    """Neighbouring parts together as long as they stay within the limit; a larger one is an error."""
    held: list[str] = []
    total = 0
    for p in parts:
        n = size(p)
        if n > limit:
            raise ValueError(f"a part of {n} is larger than the limit of {limit}")
        if held and total + glue + n > limit:
            yield held
            held, total = [], 0
        total += n + (glue if held else 0)
        held.append(p)
    if held:
        yield held
