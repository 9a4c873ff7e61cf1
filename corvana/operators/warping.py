"""What alignments are used for: paths over given weights, words within segments, timelines carried to another text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvana.functions import signals
from corvana.operators.alignment import PATH, aligned, swept, told

# paths over given costs


def head_weights(heads: np.ndarray) -> np.ndarray:
    """Mean weights (tokens x frames) of attention scores (heads x tokens x frames).

    Each token's frames go through a softmax, each head is centred and scaled by its root mean square (the
    mean isn't taken off the square: that is how the scale is defined here), each token's frames are
    smoothed by a median of five (two at each end stay), and the heads are averaged.
    """
    heads = np.asarray(heads, np.float64)
    x = np.exp(heads - heads.max(axis=2, keepdims=True))
    x /= x.sum(axis=2, keepdims=True)
    mean, square = x.mean(axis=(1, 2), keepdims=True), (x * x).mean(axis=(1, 2), keepdims=True)
    x = (x - mean) / (np.sqrt(square) + 1e-10)
    return median_of_5(x).mean(axis=0)


def median_of_5(x: np.ndarray) -> np.ndarray:
    """Along the last axis; two values at each end stay."""
    out = x.copy()
    if x.shape[-1] >= 5:
        out[..., 2:-2] = np.median(np.lib.stride_tricks.sliding_window_view(x, 5, axis=-1), axis=-1)
    return out


def weights_path(weights: np.ndarray) -> tuple[float, list[tuple[int, int]]]:
    """The path from the first token and frame to the last of largest summed weight; its cost is the negated sum, without the first pair."""
    w = np.asarray(weights, np.float64)
    if w.ndim != 2 or not w.size:
        return 0.0, []
    costs, paths = swept(1, w.shape[0], w.shape[1], lambda i, j: -w[i, j][None], w.shape[1])
    return float(costs[0]), paths[0]


def attention_path(heads: Column, first_frame: Column | None = None, end_frame: Column | None = None, selected: list[int] | None = None) -> Column:
    """(cost, path) of tokens (source) against frames (dest) from attention scores, array<array<array<double>>> as heads, tokens, frames.

    first_frame, end_frame: the frames that take part, all by default; dest counts from the first of the
    whole. selected: the heads that do. Null for null scores or bounds; no path for no head, token or frame.
    """

    def one(x, start, end):
        if x is None or start is None or end is None or start != start or end != end:
            return None, None
        use = [x[n] for n in selected] if selected is not None else list(x)
        cube = [[np.asarray(t, np.float64)[int(start) : int(end)] for t in head] for head in use]
        if not cube or not len(cube[0]) or not len(cube[0][0]):
            return 0.0, []
        cost, path = weights_path(head_weights(np.array(cube)))
        return cost, [(i, int(start) + j) for i, j in path]

    @F.pandas_udf(PATH)
    def kernel(x: pd.Series, start: pd.Series, end: pd.Series) -> pd.DataFrame:
        return told([one(p, a, b) for p, a, b in zip(x, start, end, strict=True)])

    width = F.when(F.size(heads) > 0, F.size(F.get(F.get(heads, F.lit(0)), F.lit(0)))).otherwise(0)
    begin = F.lit(0) if first_frame is None else first_frame
    return kernel(heads, begin.cast("int"), (F.coalesce(width, F.lit(0)) if end_frame is None else end_frame).cast("int"))


# alignment within segments


def cropped(channels: Column, entries: Column, rate: float) -> Column:
    """The samples of each channel inside the entries (start_time, end_time), one after the other; starts before the signal begin with it, ends behind end with it."""
    n = F.size(F.get(channels, F.lit(0)))
    start = lambda e: F.greatest(F.floor(e["start_time"] * rate), F.lit(0)).cast("int")
    end = lambda e: F.least(F.floor(e["end_time"] * rate), n).cast("int")
    part = lambda c: F.flatten(F.transform(entries, lambda e: F.slice(c, start(e) + 1, F.greatest(end(e) - start(e), F.lit(0)))))
    return F.transform(channels, part)


ENTRY = "array<struct<text:string,start_time:double,end_time:double>>"


def mapped_entries(entries: Column, path: Column, seconds: float) -> Column:
    """A reference's entries moved along a path (source: reference frames, dest: the signal's): from the first frame that meets the one where an entry starts to the last that meets the one where it ends."""
    meets = lambda t: F.transform(F.filter(path, lambda p: p["source"] == frame(t)), lambda p: p["dest"])
    last = F.element_at(path, -1)["source"]
    frame = lambda t: F.least(F.greatest(F.floor(t / seconds).cast("int"), F.lit(0)), last)
    move = lambda e: F.struct(e["text"].alias("text"), (F.array_min(meets(e["start_time"])) * seconds).alias("start_time"), (F.array_max(meets(e["end_time"])) * seconds).alias("end_time"))
    return F.when(F.size(path) > 0, F.transform(entries, move)).otherwise(F.array().cast(ENTRY))


def align_segments(signals_: DataFrame, segments: DataFrame, key: str, sample_rate: float, band: int | None = None, kind: str | None = "mfcc", **options) -> DataFrame:
    """(key, segment, text, start_time, end_time): words aligned within each segment of a signal.

    signals_: (key, samples); segments: (key, segment, start_time, end_time, reference: samples of the segment's
    text as it is said elsewhere, words: text, start_time and end_time there). kind: of the frames that are compared, None for the
    samples themselves. Each segment's samples
    are cut out, the frames of both are warped onto each other, the words' times go along the path, and
    the segment's start is added. A segment is a row of its own, so the segments of one long signal spread
    over the cluster. Segments without samples, and keys without a signal, give no rows.
    """
    o = signals.MFCC | options
    cut = F.slice("samples", F.floor(F.col("start_time") * sample_rate).cast("int") + 1, F.greatest((F.floor(F.col("end_time") * sample_rate) - F.floor(F.col("start_time") * sample_rate)).cast("int"), F.lit(0)))
    met = segments.join(signals_.select(key, "samples"), key).withColumn("own", cut).where(F.size("own") > 0)
    framed_as = lambda c: F.col(c) if kind is None else signals.spectra(F.col(c), kind, **options)
    framed = met.select(key, "segment", "start_time", "words", framed_as("reference").alias("a"), framed_as("own").alias("b"))
    path = framed.withColumn("path", aligned(framed, "a", "b", band=band)["path"])
    moved = path.select(key, "segment", "start_time", F.explode(mapped_entries(F.col("words"), F.col("path"), 1 / sample_rate if kind is None else o["hop"] / o["rate"])).alias("w"))
    return moved.select(key, "segment", "w.text", (F.col("w.start_time") + F.col("start_time")).alias("start_time"), (F.col("w.end_time") + F.col("start_time")).alias("end_time"))


def timeline_by_mapping(source: DataFrame, mapping: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """(key, target, text, start_time, end_time): a timeline's times carried over to another text's words.

    source: (key, source, start_time, end_time); mapping: (key, ord, source, target) pairs of words that mean
    the same, in their order; target: (key, target, text). A source word's interval is divided evenly
    among the different targets it maps to, in the order in which they first come; a target that gets several
    parts starts with the first and ends with the last of them, in the order in which their sources first come. Words
    without a partner have no row.
    """
    pairs = mapping.where("source is not null and target is not null").groupBy(key, "source", "target").agg(F.min("ord").alias("ord"))
    of_source = Window.partitionBy(key, "source")
    shared = pairs.select(
        "*", F.count("*").over(of_source).alias("n"), (F.row_number().over(of_source.orderBy("ord")) - 1).alias("i"), F.min("ord").over(of_source).alias("group_ord")
    ).join(source.select(key, "source", "start_time", "end_time"), [key, "source"])
    width = (F.col("end_time") - F.col("start_time")) / F.col("n")
    parts = shared.select(key, "target", "group_ord", "ord", (F.col("start_time") + F.col("i") * width).alias("start_time"), (F.col("start_time") + (F.col("i") + 1) * width).alias("end_time"))
    place = F.struct("group_ord", "ord")
    merged = parts.groupBy(key, "target").agg(F.min_by("start_time", place).alias("start_time"), F.max_by("end_time", place).alias("end_time"))
    return merged.join(target.select(key, "target", "text"), [key, "target"]).select(key, "target", "text", "start_time", "end_time")


def timeline_by_words(pairs: DataFrame, key: str) -> DataFrame:
    """timeline_by_mapping() where words of equal keys mean the same, for texts that are in a row each; nothing is shuffled.

    pairs: (key, start_times, end_times, source_words: keys of the source's words in their order, words: texts of
    the target's, target_words: their keys). Linear in the words of a row.
    """
    names = ("start_times", "end_times", "source_words", "words", "target_words")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part, out = batch.slice(first, 256), ([], [], [], [], [])
                for own, starts, ends, source, words, target in zip(*[part.column(n).to_pylist() for n in (key, *names)], strict=True):
                    low, high = {w: n for n, w in reversed(list(enumerate(source)))}, {w: n for n, w in enumerate(source)}
                    shares, seen = Counter(target), Counter()
                    for n, (text, w) in enumerate(zip(words, target, strict=True)):
                        if w in low:
                            a, b, i = low[w], high[w], seen[w]
                            begin = starts[a] + i * ((ends[a] - starts[a]) / shares[w])
                            end = starts[b] + (i + 1) * ((ends[b] - starts[b]) / shares[w])
                            for column, value in zip(out, (own, n, text, begin, end), strict=True):
                                column.append(value)
                            seen[w] += 1
                types = (batch.schema.field(key).type, pa.int32(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=[key, "target", "text", "start_time", "end_time"])

    kind = pairs.schema[key].dataType.simpleString()
    return pairs.select(key, *names).mapInArrow(kernel, f"{key} {kind}, target int, text string, start_time double, end_time double")
