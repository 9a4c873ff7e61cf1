"""Voice activity by an adaptive gate, and the meters it is made of.

One machine goes through a signal: each channel's band of speech is filtered out, its squares are smoothed
with a fast rise and a slow fall, their mean over the channels gives the loudness, and decaying peaks follow
its top and bottom. Frames are active where the loudness comes near the top, and so are some frames
before them. The machine's state goes from part to part (operators/parts.py); what follows needs only
neighbouring frames, so a long signal is worked on by several tasks throughout.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvana.functions.signals import filter_coefficients
from corvana.operators.parts import Cascade, Machine, Smoother, decaying, in_parts, machined

FRAME = 0.01  # seconds
QUIET, LOUD = -60.0, -30.0  # decibels: where estimates begin and end, and the least top that counts

# The two sections of the loudness standard's weighting at 44100 samples a second.
STANDARD_SHELF = {"b0": 1.53512485958697, "b1": -2.69169618940638, "b2": 1.19839281085285, "a1": -1.69065929318241, "a2": 0.73248077421585}
STANDARD_PASS = {"b0": 1.0, "b1": -2.0, "b2": 1.0, "a1": -1.99004745483398, "a2": 0.99007225036621}


def k_weighting(rate: float, standard: bool = False) -> tuple[dict[str, float], dict[str, float]]:
    """The sections of K weighting, a high shelf and a high pass: designed for the rate, or the standard's own."""
    return (STANDARD_SHELF, STANDARD_PASS) if standard else (filter_coefficients("highshelf", rate, 2000.0, 0.0, 4.0), filter_coefficients("highpass", rate, 1.5, 0.01))


def decibels(power: np.ndarray) -> np.ndarray:
    """Of mean squares, with a floor at -100."""
    return np.where(power <= 1e-10, -100.0, 10 * np.log10(np.maximum(power, 1e-10)))


class Meter(Machine):
    """Loudness of all channels in decibels from smoothed squares of the filtered samples; rates are a second's."""

    def __init__(self, rate: float, channels: int = 1, up: float = 400.0, down: float = 10.0, initial: float = QUIET, least: float = QUIET, sections: tuple[dict[str, float], ...] = ()):
        ticks = rate * channels
        self.channels, self.filters = channels, Cascade(*sections)
        self.smoother = Smoother(up / ticks, down / ticks, 10 ** (initial / 10), 10 ** (least / 10))
        self.size = len(self.filters.first) + 1
        self.first = np.tile(np.append(self.filters.first, self.smoother.first), channels)
        self.outputs = ("loudness",)

    def levels(self, state: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next state, and the mean squares after each sample of each channel in turn (samples x channels)."""
        own, held, n = np.empty(x.shape), [], self.size
        for c in range(self.channels):
            part = state[c * n : (c + 1) * n]
            filters, y = self.filters.run(part[:-1], x[:, c : c + 1])
            level, own[:, c] = self.smoother.follow(float(part[-1]), y[:, 0] ** 2)
            held.append(np.append(filters, level))
        before = np.concatenate([state[n - 1 :: n][None], own[:-1]]) if len(x) else own
        mean = np.empty(x.shape)
        for c in range(self.channels):  # the channels up to c have moved on, the others not yet
            mean[:, c] = (own[:, : c + 1].sum(axis=1) + before[:, c + 1 :].sum(axis=1)) / self.channels
        return np.concatenate(held), mean

    def run(self, state: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        state, mean = self.levels(state, x)
        return state, decibels(mean[:, -1:])


@dataclass(frozen=True)
class GateOptions:
    low: float = 100.0
    high: float = 1000.0
    up: float = 400.0
    down: float = 10.0
    decay: float = 4.0  # decibels a second
    backward: float = 0.2  # seconds
    threshold: float = -15.0  # decibels under the top


class Gate(Machine):
    """sample (its number), frame (the number of the frame that it begins, not a number elsewhere), loudness, minimum and maximum after each sample.

    A frame begins at the first sample whose time is over FRAME behind the last one's, in doubles.
    """

    def __init__(self, rate: float, channels: int, options: GateOptions):
        band = (filter_coefficients("highpass", rate, options.low, 0.7071), filter_coefficients("lowpass", rate, options.high, 0.7071))
        self.meter = Meter(rate, channels, options.up, options.down, sections=band)
        self.decay = options.decay / (rate * channels)
        self.rate, self.step = rate, math.floor(FRAME * rate)
        self.first = np.concatenate([self.meter.first, [QUIET, QUIET, 0.0, 0.0, 0.0]])  # peaks, samples and frames so far, where the next frame begins
        self.outputs = ("sample", "frame", "loudness", "minimum", "maximum")

    def next_frame(self, sample: int) -> int:
        due = sample / self.rate + FRAME
        after = max(sample + self.step - 1, sample + 1)
        while after / self.rate <= due:
            after += 1
        return after

    def run(self, state: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(x):
            return state, np.empty((0, 5))
        meter, mean = self.meter.levels(state[:-5], x)
        loud, (low, high, n, frames, begins) = decibels(mean).ravel(), state[-5:]
        last = slice(self.meter.channels - 1, None, self.meter.channels)
        bottom, top = decaying(low, loud, self.decay, "minimum"), decaying(high, loud, self.decay, ticks=loud >= QUIET)
        frame, begins = np.full(len(x), np.nan), int(begins)
        while begins < n + len(x):
            frame[begins - int(n)] = frames
            frames, begins = frames + 1, self.next_frame(begins)
        found = np.stack([n + np.arange(len(x)), frame, loud[last], bottom[last], top[last]], axis=1)
        return np.concatenate([meter, [bottom[-1], top[-1], n + len(x), frames, begins]]), found


def gate_levels(df: DataFrame, key: str, order: list[str], channels: list[str], rate: float, options: GateOptions = GateOptions(), parts: int | None = None) -> DataFrame:
    """df with sample, frame (null where none begins), loudness, minimum and maximum at each row. parts: in that many parts, whatever the lengths."""
    machine = Gate(rate, len(channels), options)
    found = in_parts(df, key, order, channels, machine, parts) if parts else machined(df, key, order, channels, machine)
    return found.withColumn("sample", F.col("sample").cast("long")).withColumn("frame", F.when(~F.isnan("frame"), F.col("frame").cast("long")))


BLOCK_FRAMES = 4_096


def gate_frames(levels: DataFrame, key: str, rate: float, options: GateOptions = GateOptions(), block: int = BLOCK_FRAMES) -> DataFrame:
    """(key, frame, start_time, loudness, minimum, maximum, active): a row for each frame.

    A frame is active where the loudness reaches the threshold under the top, and so are the frames up
    to `backward` seconds before it. Frames are dealt by key and block; those that begin a block are
    sent to the one before as well, as far as activity reaches back.
    """
    back = math.floor(options.backward / FRAME)
    if back > block:
        raise ValueError("activity reaches back over more than a block")
    frames = levels.where("frame is not null").select(key, "frame", (F.col("sample") / rate).alias("start_time"), "loudness", "minimum", "maximum")
    reached = F.col("loudness") >= F.greatest("maximum", F.lit(LOUD)) + options.threshold
    own = F.floor(F.col("frame") / block)
    blocks = F.when((F.col("frame") % block < back) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = frames.withColumn("reached", reached).withColumn("own", own).withColumn("block", F.explode(blocks))
    ahead = Window.partitionBy(key, "block").orderBy("frame").rowsBetween(0, back)
    return dealt.withColumn("active", F.max("reached").over(ahead)).where("block = own").drop("own", "block", "reached")


def gate_segments(frames: DataFrame, lengths: DataFrame, key: str, rate: float, block: int = BLOCK_FRAMES) -> DataFrame:
    """(key, segment, active, start_time, end_time): runs of equal activity; lengths: (key, samples).

    A frame begins a segment where the one before differs; the first of a block is compared with a
    copy of the last of the block before. Only these few rows are numbered by key.
    """
    own = F.floor(F.col("frame") / block)
    blocks = F.when(F.col("frame") % block == block - 1, F.array(own, own + 1)).otherwise(F.array(own))
    by = Window.partitionBy(key, "block").orderBy("frame")
    dealt = frames.select(key, "frame", "start_time", "active", own.alias("own")).withColumn("block", F.explode(blocks))
    dealt = dealt.withColumn("before", F.lag("active").over(by)).withColumn("ended", F.lag("start_time").over(by))
    starts = dealt.where((F.col("block") == F.col("own")) & (F.col("before").isNull() | (F.col("before") != F.col("active"))))
    order = Window.partitionBy(key).orderBy("frame")
    found = starts.select(key, (F.row_number().over(order) - 1).alias("segment"), "active", "start_time", F.lead("ended").over(order).alias("last"))
    whole = frames.groupBy(F.col(key).alias("of")).agg(F.max("start_time").alias("end")).join(lengths.select(F.col(key).alias("with"), "samples"), F.col("of").eqNullSafe(F.col("with")))
    found = found.join(whole, F.col(key).eqNullSafe(F.col("of")))
    end = F.least(F.coalesce("last", "end") + FRAME, F.col("samples") / rate)
    return found.select(key, "segment", "active", "start_time", end.alias("end_time"))


def voice_activity(df: DataFrame, key: str, order: list[str], channels: list[str], rate: float, options: GateOptions = GateOptions(), parts: int | None = None, block: int = BLOCK_FRAMES) -> DataFrame:
    """Segments of activity and rest of each key's signal, whose rows, in order, hold a sample of each channel.

    Rows with a null in a channel are passed over. A signal without samples has no segment.
    """
    levels = gate_levels(df.select(key, *order, *channels), key, order, channels, rate, options, parts)
    lengths = df.select(key, *channels).dropna(subset=channels).groupBy(key).agg(F.count("*").alias("samples"))
    return gate_segments(gate_frames(levels, key, rate, options, block), lengths, key, rate, block)
