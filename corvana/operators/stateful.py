"""Ordered single-pass operators over each key's rows: closed forms by windows, folds in a streaming kernel elsewhere."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvana.operators.parts import Each, Machine, machined


def decaying_peak(df: DataFrame, key: str, order: list[str], value: str, decay: float, initial: float = 0.0, kind: str = "maximum") -> DataFrame:
    """peak = max(value, peak - decay) at each row, as a running maximum of value + decay * n: no state is needed. kind minimum mirrors it."""
    by = Window.partitionBy(key).orderBy(*order)
    n, sign = F.row_number().over(by), 1.0 if kind == "maximum" else -1.0
    rows = df.withColumn("n", n).withColumn("raised", F.col(value) * sign + F.col("n") * decay)
    top = F.greatest(F.max("raised").over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(initial * sign))
    return rows.withColumn("peak", (top - F.col("n") * decay) * sign).drop("n", "raised")


def gate_extended(df: DataFrame, key: str, order: list[str], active: str, rows_back: int) -> DataFrame:
    """Activity also for the rows_back rows before an active one."""
    ahead = Window.partitionBy(key).orderBy(*order).rowsBetween(0, rows_back)
    return df.withColumn(active, F.max(active).over(ahead))


#: A fold: its first state, and (state, value) to (next state, output).
Fold = tuple[tuple, Callable[[tuple, float], tuple[tuple, float]]]


def smoothing(up: float, down: float, initial: float = 0.0) -> Fold:
    """Exponential smoothing that follows rises and falls at different rates."""

    def step(state: tuple, x: float) -> tuple[tuple, float]:
        y = state[0] + (x - state[0]) * (up if x > state[0] else down)
        return (y,), y

    return (initial,), step


def loudness(up: float, down: float, initial: float = 1e-5, least: float = 1e-10) -> Fold:
    """Root mean square in decibels of asymmetrically smoothed squares, with a floor."""

    def step(state: tuple, x: float) -> tuple[tuple, float]:
        y = max(state[0] + (x * x - state[0]) * (up if x * x > state[0] else down), least)
        return (y,), max(10 * math.log10(y), -100.0)

    return (initial,), step


def biquad(c: dict[str, float]) -> Fold:
    """y = b0 x + b1 x1 + b2 x2 - a1 y1 - a2 y2."""

    def step(state: tuple, x: float) -> tuple[tuple, float]:
        y1, y2, x1, x2 = state
        y = c["b0"] * x + c["b1"] * x1 + c["b2"] * x2 - c["a1"] * y1 - c["a2"] * y2
        return (y, y1, x, x1), y

    return (0.0, 0.0, 0.0, 0.0), step


def folded(df: DataFrame, key: str, order: list[str], value: str, fold: Fold | Machine, out: str = "y") -> DataFrame:
    """df with a fold's or machine's output at each row, over each key's rows in order; a null value leaves the state as it is and gives null.

    Long keys are run in parts (operators/parts.py); neither a key's rows nor its outputs are ever held together.
    """
    return machined(df, key, order, value, fold if isinstance(fold, Machine) else Each(*fold, output=out))


def first_exceeding(weights: Column, u: Column) -> Column:
    """Inverse of a distribution: the first place, from 0, where the running sum of weights, scaled to 1, exceeds u."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    state = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.lit(-1).alias("found"))
    step = lambda a, w: F.struct((a["sum"] + w).alias("sum"), (a["i"] + 1).alias("i"), F.when((a["found"] < 0) & (a["sum"] + w > u * total), a["i"]).otherwise(a["found"]).alias("found"))
    return F.aggregate(weights, state, step, lambda a: F.when(a["found"] < 0, F.size(weights) - 1).otherwise(a["found"]))
