"""Signals at another rate, by a windowed sinc in phases.

At a new rate of up / down of the old one, output n stands at place n * down / up of the input. Only `up`
different fractions occur, so the weights are a table of `up` phases of 2 * taps numbers each. A signal may come
in parts, rows of a key in order; each part gets the few samples around it that its outputs reach.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAPS = 16  # zero crossings at each side


def phase_weights(up: int, down: int, taps: int = TAPS) -> np.ndarray:
    """up x 2 reach weights: of the inputs from reach - 1 before an output's place to reach behind it, by the place's fraction; each phase sums to 1."""
    cutoff = min(1.0, up / down)
    reach = math.ceil(taps / cutoff)
    t = (np.arange(up) / up)[:, None] - np.arange(1 - reach, reach + 1)[None, :]
    window = np.where(np.abs(t) < reach, 0.5 + 0.5 * np.cos(np.pi * t / reach), 0.0)
    weights = cutoff * np.sinc(cutoff * t) * window
    return weights / weights.sum(axis=1, keepdims=True)


def outputs(x: np.ndarray, first: int, start: int, end: int, up: int, down: int, weights: np.ndarray) -> np.ndarray:
    """The outputs whose places lie in [start, end) of a signal of which x holds the samples from `first` on; nothing is outside it."""
    reach = weights.shape[1] // 2
    n = np.arange(-(-start * up // down), -(-end * up // down))
    if not len(n):
        return np.zeros(0)
    place, phase = n * down // up, n * down % up
    low, high = int(place[0]) - reach + 1, int(place[-1]) + reach + 1
    whole = np.zeros(high - low)
    a, b = max(low, first), min(high, first + len(x))
    if a < b:
        whole[a - low : b - low] = x[a - first : b - first]
    around = np.lib.stride_tricks.sliding_window_view(whole, 2 * reach)[place - low - reach + 1]
    return np.einsum("ij,ij->i", around, weights[phase])


def reduced(up: int, down: int) -> tuple[int, int]:
    if up < 1 or down < 1:
        raise ValueError("both rates must be positive")
    unit = math.gcd(up, down)
    return up // unit, down // unit


def resampled(samples: Column, new_rate: int, old_rate: int, taps: int = TAPS) -> Column:
    """A signal at the new rate, as long in seconds; null for null."""
    up, down = reduced(new_rate, old_rate)
    weights = phase_weights(up, down, taps)

    @F.pandas_udf("array<double>")
    def kernel(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else outputs(np.asarray(v, np.float64), 0, 0, len(v), up, down, weights))

    return kernel(samples)


def resampled_parts(df: DataFrame, key: str, part: str, samples: str, new_rate: int, old_rate: int, taps: int = TAPS) -> DataFrame:
    """df with each part's samples at the new rate; joined, a key's parts are its whole signal at that rate.

    Parts may have any lengths; a null one has no samples. Only the lengths go through a window by key, and only
    the samples at a part's edges are sent to others: to those whose outputs reach them.
    """
    up, down = reduced(new_rate, old_rate)
    weights = phase_weights(up, down, taps)
    reach = weights.shape[1] // 2
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce(F.size(samples), F.lit(0)).cast("long")
    places = df.select(key, part, size.alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    places = places.select(F.col(key).alias("of"), F.col(part).alias("of_part"), "n", "start")
    held = df.join(places, F.col(key).eqNullSafe(F.col("of")) & F.col(part).eqNullSafe(F.col("of_part"))).select(*[F.col(c) for c in df.columns], "n", "start")

    # a part's head belongs to all parts that end less than reach before it, its tail to those that begin less than reach behind it; `span` parts at most lie there
    blocks = lambda low, high: F.explode(F.sequence(F.floor(low / reach), F.floor(high / reach)))
    end = F.col("start") + F.col("n")
    filled = held.where("n > 0")
    edge = lambda a, b: F.struct(a.alias("at"), F.slice(samples, (a - F.col("start") + 1).cast("int"), (b - a).cast("int")).alias("x"))
    head, tail = edge(F.col("start"), F.least(F.col("start") + reach, end)), edge(F.greatest(end - reach, F.col("start")), end)
    edges = filled.select(key, F.explode(F.array(head, tail)).alias("e")).select(key, "e.at", "e.x")
    edges = edges.withColumn("block", blocks(F.col("at"), F.col("at") + F.size("x") - 1))
    asked = filled.select(key, part, "start", end.alias("end"), F.explode(F.array(F.struct((F.col("start") - reach).alias("a"), F.col("start").alias("b")), F.struct(end.alias("a"), (end + reach).alias("b")))).alias("w"))
    asked = asked.withColumn("block", blocks(F.col("w.a"), F.col("w.b") - 1))
    met = asked.join(edges.withColumnRenamed(key, "of"), (F.col(key).eqNullSafe(F.col("of"))) & (asked["block"] == edges["block"]))
    near = met.where((F.col("at") < F.col("w.b")) & (F.col("at") + F.size("x") > F.col("w.a")))
    around = near.groupBy(key, part).agg(F.collect_set(F.struct("at", "x")).alias("around"))  # samples within reach of a part
    ready = held.join(around.withColumnRenamed(key, "of").withColumnRenamed(part, "of_part"), F.col(key).eqNullSafe(F.col("of")) & F.col(part).eqNullSafe(F.col("of_part")), "left")

    @F.pandas_udf("array<double>")
    def kernel(x: pd.Series, start: pd.Series, around: pd.Series) -> pd.Series:
        def one(v, first, edges) -> np.ndarray | None:
            if v is None:
                return None
            whole = np.zeros(len(v) + 2 * reach)
            for e in [] if edges is None else edges:
                own, at = np.asarray(e["x"], np.float64), int(e["at"]) - first + reach
                a, b = max(at, 0), min(at + len(own), len(whole))
                if a < b:
                    whole[a:b] = own[a - at : b - at]
            whole[reach : reach + len(v)] = v
            return outputs(whole, first - reach, first, first + len(v), up, down, weights)

        return pd.Series([one(v, int(f), e) for v, f, e in zip(x, start, around, strict=True)])

    return ready.select(*[F.col(c) for c in df.columns if c != samples], kernel(F.col(samples), F.col("start"), F.col("around")).alias(samples))
