"""Signal functions: filter design and windows on the driver, sample arithmetic as columns, transforms in numpy kernels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvana.functions.times import decibels_to_gain
from corvana.functions.vectors import let, mean


def peak(channels: Column) -> Column:
    """The largest magnitude over all channels, 0.00001 at least."""
    return F.greatest(F.array_max(F.transform(F.flatten(channels), F.abs)), F.lit(1e-5))


def with_gain(channels: Column, gain: Column) -> Column:
    return F.transform(channels, lambda c: F.transform(c, lambda x: x * gain))


def normalized(channels: Column, target: float = -3.0, most: float = 30.0) -> Column:
    gain = F.least(decibels_to_gain(F.lit(target)) / peak(channels), decibels_to_gain(F.lit(most)))
    return let(gain, lambda g: with_gain(channels, g))


def attenuated(channels: Column, target: float = -0.1) -> Column:
    """Only louder signals change."""
    return let(F.least(F.lit(1.0), decibels_to_gain(F.lit(target)) / peak(channels)), lambda g: with_gain(channels, g))


def without_bias(channels: Column) -> Column:
    return F.transform(channels, lambda c: let(mean(c), lambda m: F.transform(c, lambda x: x - m)))


def downmixed(channels: Column) -> Column:
    """The mean of the channels; a missing sample counts as 0."""
    n = F.size(channels)
    width = F.array_max(F.transform(channels, F.size))
    return F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.aggregate(channels, F.lit(0.0), lambda a, c: a + F.coalesce(F.get(c, i), F.lit(0.0))) / n)


def mixed(a: Column, b: Column, sign: float = 1.0) -> Column:
    """Sums (or differences) up to the shorter one's end."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x + sign * y)


def leading_silent(samples: Column, threshold: Column) -> Column:
    """How many samples before the first loud one; the last sample never counts."""
    loud = F.array_min(F.filter(F.transform(samples, lambda x, i: F.when(F.abs(x) > threshold, i)), lambda i: i.isNotNull()))
    return F.least(F.coalesce(loud, F.size(samples)), F.greatest(F.size(samples) - 1, F.lit(0)))


def trailing_silent(samples: Column, threshold: Column) -> Column:
    return leading_silent(F.reverse(samples), threshold)


def trimmed_start(samples: Column, kept: int = 0, decibels: float = -40.0) -> Column:
    """Without the silence at the start, but for as many zeros as are kept."""
    silent = leading_silent(samples, decibels_to_gain(F.lit(decibels)))
    return let(silent, lambda n: F.concat(F.array_repeat(F.lit(0.0), kept), F.slice(samples, n + 1, F.size(samples))))


def trimmed_end(samples: Column, kept: int = 0, decibels: float = -40.0) -> Column:
    return F.when(F.size(samples) == 0, samples).otherwise(F.reverse(trimmed_start(F.reverse(samples), kept, decibels)))


def sliced(channels: Column, start: Column, end: Column) -> Column:
    """Samples [start, end) of each channel."""
    return F.transform(channels, lambda c: F.slice(c, start.cast("int") + 1, F.greatest(end - start, F.lit(0)).cast("int")))


def sliced_by_time(channels: Column, rate: float, start: Column, end: Column) -> Column:
    return sliced(channels, F.floor(start * rate), F.floor(end * rate))


def joined(first: Column, second: Column) -> Column:
    """One signal after the other, channel by channel."""
    return F.zip_with(first, second, lambda a, b: F.concat(a, b))


def interleaved(channels: Column) -> Column:
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(F.get(channels, F.lit(0))) - 1), lambda i: F.transform(channels, lambda c: F.get(c, i))))


def channel_of(samples: Column, channels: int, n: int) -> Column:
    return F.filter(samples, lambda x, i: i % channels == n)


def faded(samples: Column, n: int) -> Column:
    """Exponential fades by 60 dB over n samples at both ends; shorter signals stay."""
    size = F.size(samples)
    gain = lambda i: F.pow(F.lit(10.0), -3.0 * (1 - i / float(n)))
    return F.when(size < 2 * n, samples).otherwise(F.transform(samples, lambda x, i: x * F.when(i < n, gain(i)).when(i >= size - n, gain(size - 1 - i)).otherwise(F.lit(1.0))))


def emphasized(samples: Column, factor: float = 0.97) -> Column:
    return F.transform(samples, lambda x, i: F.when(i == 0, x).otherwise(x - factor * F.get(samples, i - 1)))


def window_weights(kind: str, n: int) -> np.ndarray:
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / max(n - 1, 1))
    return {"hann": hann, "hann-sqrt": np.sqrt(hann), "hamming": 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / max(n - 1, 1)), "povey": hann**0.85}[kind]


def windows(kind: str, n: Column) -> Column:
    """window_weights() as a column: an array for each row's number of places."""
    at = lambda mean: F.transform(F.sequence(F.lit(0), n - 1), lambda i: mean - (1 - mean) * F.cos(2 * math.pi * i / F.greatest(n - 1, F.lit(1))))
    shapes = {"hann": lambda x: x, "hann-sqrt": lambda x: F.sqrt(F.greatest(x, F.lit(0.0))), "povey": lambda x: F.pow(F.greatest(x, F.lit(0.0)), F.lit(0.85))}
    found = at(0.54) if kind == "hamming" else F.transform(at(0.5), shapes[kind])
    return F.when(n > 0, found).otherwise(F.array().cast("array<double>"))


# spectra as arrays of real and imaginary parts in turn


def bin_frequencies(bins: Column, highest: Column) -> Column:
    """The frequency of each of so many bins, evenly from 0 to the highest."""
    return F.transform(F.sequence(F.lit(0), bins - 1), lambda i: i * highest / F.greatest(bins - 1, F.lit(1)))


def complex_bins(buffer: Column, mirrored: bool = False) -> Column:
    """array<struct<real, imaginary>> of a buffer; mirrored: with the conjugates of the inner bins behind, in reverse."""
    own = F.transform(F.sequence(F.lit(0), F.floor(F.size(buffer) / 2).cast("int") - 1), lambda i: F.struct(F.get(buffer, 2 * i).alias("real"), F.get(buffer, 2 * i + 1).alias("imaginary")))
    none = F.array().cast("array<struct<real:double,imaginary:double>>")
    found = F.when(F.size(buffer) >= 2, own).otherwise(none)
    if not mirrored:
        return found
    conjugates = lambda x: F.transform(F.reverse(F.slice(x, 2, F.greatest(F.size(x) - 2, F.lit(0)))), lambda z: F.struct(z["real"].alias("real"), (-z["imaginary"]).alias("imaginary")))
    return let(found, lambda x: F.concat(x, conjugates(x)))


def bin_buffer(bins: Column) -> Column:
    """The real and imaginary parts in turn."""
    return F.flatten(F.transform(bins, lambda z: F.array(z["real"], z["imaginary"])))


def polar(bins: Column) -> Column:
    """array<struct<magnitude, phase>>."""
    return F.transform(bins, lambda z: F.struct(F.sqrt(z["real"] * z["real"] + z["imaginary"] * z["imaginary"]).alias("magnitude"), F.atan2(z["imaginary"], z["real"]).alias("phase")))


def cartesian(bins: Column) -> Column:
    """array<struct<real, imaginary>> of magnitudes and phases."""
    return F.transform(bins, lambda z: F.struct((z["magnitude"] * F.cos(z["phase"])).alias("real"), (z["magnitude"] * F.sin(z["phase"])).alias("imaginary")))


def stft(samples: np.ndarray, order: int, window: int, hop: int, kind: str = "hann") -> np.ndarray:
    """Spectra of frames, the signal padded by half a window at both ends."""
    if order % 2 or window % 2 or window > order or hop > window:
        raise ValueError("sizes must be even, the window within the order and the hop within the window")
    x = np.pad(np.asarray(samples, np.float64), window // 2)
    n = max(0, 1 + (len(x) - window) // hop)
    frames = np.lib.stride_tricks.sliding_window_view(x, window)[::hop][:n] if n else np.zeros((0, window))
    return np.fft.rfft(frames * window_weights(kind, window), order)


def istft(spectra: np.ndarray, order: int, window: int, hop: int, kind: str = "hann") -> np.ndarray:
    """Overlap-add over the sum of squared weights; samples that no weight reaches are 0."""
    w = window_weights(kind, window)
    frames = np.fft.irfft(spectra, order)[:, :window] * w
    out, norm = np.zeros(window + hop * max(0, len(frames) - 1)), np.zeros(window + hop * max(0, len(frames) - 1))
    for i, f in enumerate(frames):
        out[i * hop : i * hop + window] += f
        norm[i * hop : i * hop + window] += w * w
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-8)[window // 2 : len(out) - window // 2]


def to_mel(f):
    return 2595 * np.log10(1 + np.asarray(f) / 700)


def from_mel(m):
    return 700 * (10 ** (np.asarray(m) / 2595) - 1)


def mel_filterbanks(bands: int, order: int, rate: float, low: float, high: float) -> np.ndarray:
    """Triangles around centres that are even in mel, each summing to 1."""
    edges = from_mel(np.linspace(to_mel(low), to_mel(high), bands + 2))
    bins = np.arange(order // 2 + 1) * rate / order
    half = (edges[2:] - edges[:-2]) / 2
    weights = np.maximum(0, 1 - np.abs(bins[None, :] - edges[1:-1, None]) / half[:, None])
    total = weights.sum(axis=1, keepdims=True)
    return np.divide(weights, total, out=np.zeros_like(weights), where=total > 0)


def dct_matrix(features: int, bands: int) -> np.ndarray:
    return np.cos(np.pi * np.outer(np.arange(features), np.arange(bands) + 0.5) / bands)


MFCC = {"bands": 40, "features": 13, "order": 512, "low": 133.3333, "high": 6855.4976, "window": 400, "hop": 160, "emphasis": 0.97, "rate": 16000}


def mfcc(samples: np.ndarray, **options) -> np.ndarray:
    """Emphasis, power spectra, mel bands in decibels, cosine transform, sinusoidal liftering by 22."""
    o = MFCC | options
    x = np.asarray(samples, np.float64)
    x = np.concatenate([x[:1], x[1:] - o["emphasis"] * x[:-1]])
    power = np.abs(stft(x, o["order"], o["window"], o["hop"])) ** 2
    mel = power @ mel_filterbanks(o["bands"], o["order"], o["rate"], o["low"], o["high"]).T
    decibels = np.where(mel <= 1e-10, -100.0, 10 * np.log10(np.maximum(mel, 1e-10)))
    found = 2 * decibels @ dct_matrix(o["features"], o["bands"]).T
    return found * (1 + 11 * np.sin(np.pi * np.arange(o["features"]) / 22))


SPECTRA = T.ArrayType(T.ArrayType(T.DoubleType()))


def spectra(samples: Column, kind: str = "power", **options) -> Column:
    """Frames of a signal as power spectra, mel spectra or mfcc, for each row; null for null. options as MFCC's; window weights by Hann."""
    o = MFCC | options

    def one(x) -> list | None:
        if x is None:
            return None
        if kind == "mfcc":
            return mfcc(x, **options).tolist()
        power = np.abs(stft(x, o["order"], o["window"], o["hop"])) ** 2
        return (power if kind == "power" else power @ mel_filterbanks(o["bands"], o["order"], o["rate"], o["low"], o["high"]).T).tolist()

    @F.pandas_udf(SPECTRA)
    def kernel(x: pd.Series) -> pd.Series:
        return x.map(one)

    return kernel(samples)


def restored(samples: Column, order: int, window: int, hop: int) -> Column:
    """A signal by way of its spectra and back."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def kernel(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else istft(stft(v, order, window, hop), order, window, hop).tolist())

    return kernel(samples)


def filter_coefficients(kind: str, rate: float, frequency: float, q: float = 1.0, gain: float = 0.0) -> dict[str, float]:
    """Second-order sections of the published audio equaliser cookbook, a0 divided out; low- and high-pass take q in decibels."""
    ratio = min(max(frequency / (rate / 2), 0.0), 1.0)
    w = math.pi * ratio
    cos, sin, amp = math.cos(w), math.sin(w), 10 ** (gain / 40)
    if kind in ("lowpass", "highpass"):
        if ratio in (0.0, 1.0):
            through = (ratio == 1.0) == (kind == "lowpass")
            return {"b0": float(through), "b1": 0.0, "b2": 0.0, "a1": 0.0, "a2": 0.0}
        alpha, s = sin / (2 * 10 ** (q / 20)), 1 if kind == "lowpass" else -1
        edge = (1 - s * cos) / 2
        b, a = (edge, 2 * s * edge, edge), (1 + alpha, -2 * cos, 1 - alpha)
    elif kind in ("lowshelf", "highshelf"):
        alpha, s = sin / math.sqrt(2), 1 if kind == "lowshelf" else -1
        root = 2 * math.sqrt(amp) * alpha
        b = (amp * ((amp + 1) - s * (amp - 1) * cos + root), s * 2 * amp * ((amp - 1) - s * (amp + 1) * cos), amp * ((amp + 1) - s * (amp - 1) * cos - root))
        a = ((amp + 1) + s * (amp - 1) * cos + root, -s * 2 * ((amp - 1) + s * (amp + 1) * cos), (amp + 1) + s * (amp - 1) * cos - root)
    else:
        alpha = sin / (2 * q) if q > 0 else 0.0
        shapes = {
            "bandpass": ((alpha, 0.0, -alpha), (1 + alpha, -2 * cos, 1 - alpha)),
            "notch": ((1.0, -2 * cos, 1.0), (1 + alpha, -2 * cos, 1 - alpha)),
            "allpass": ((1 - alpha, -2 * cos, 1 + alpha), (1 + alpha, -2 * cos, 1 - alpha)),
            "peaking": ((1 + alpha * amp, -2 * cos, 1 - alpha * amp), (1 + alpha / amp, -2 * cos, 1 - alpha / amp)),
        }
        b, a = shapes[kind]
    return {"b0": b[0] / a[0], "b1": b[1] / a[0], "b2": b[2] / a[0], "a1": a[1] / a[0], "a2": a[2] / a[0]}


def filter_sections(kind: str, rate: float, frequency: Column, q: float = 1.0, gain: float = 0.0) -> Column:
    """filter_coefficients() as a column: struct<b0, b1, b2, a1, a2> for each row's frequency."""
    ratio = F.least(F.greatest(frequency / (rate / 2), F.lit(0.0)), F.lit(1.0))
    w, amp = math.pi * ratio, 10 ** (gain / 40)
    cos, sin = F.cos(w), F.sin(w)
    edge = None
    if kind in ("lowpass", "highpass"):
        alpha, s = sin / (2 * 10 ** (q / 20)), 1 if kind == "lowpass" else -1
        half = (1 - s * cos) / 2
        b, a = (half, 2 * s * half, half), (1 + alpha, -2 * cos, 1 - alpha)
        edge = F.when(ratio.isin(0.0, 1.0), F.when((ratio == 1.0) == F.lit(kind == "lowpass"), 1.0).otherwise(0.0))
    elif kind in ("lowshelf", "highshelf"):
        s = 1 if kind == "lowshelf" else -1
        root, more, less = 2 * math.sqrt(amp) * sin / math.sqrt(2), amp + 1, amp - 1
        b = (amp * (more - s * less * cos + root), s * 2 * amp * (less - s * more * cos), amp * (more - s * less * cos - root))
        a = (more + s * less * cos + root, -s * 2 * (less + s * more * cos), more + s * less * cos - root)
    else:
        alpha = sin / (2 * q) if q > 0 else sin * 0
        shapes = {
            "bandpass": ((alpha, alpha * 0, -alpha), (1 + alpha, -2 * cos, 1 - alpha)),
            "notch": ((alpha * 0 + 1, -2 * cos, alpha * 0 + 1), (1 + alpha, -2 * cos, 1 - alpha)),
            "allpass": ((1 - alpha, -2 * cos, 1 + alpha), (1 + alpha, -2 * cos, 1 - alpha)),
            "peaking": ((1 + alpha * amp, -2 * cos, 1 - alpha * amp), (1 + alpha / amp, -2 * cos, 1 - alpha / amp)),
        }
        b, a = shapes[kind]
    found = {"b0": b[0] / a[0], "b1": b[1] / a[0], "b2": b[2] / a[0], "a1": a[1] / a[0], "a2": a[2] / a[0]}
    if edge is not None:
        found = {n: F.when(edge.isNotNull(), edge if n == "b0" else F.lit(0.0)).otherwise(c) for n, c in found.items()}
    return F.struct(*[c.alias(n) for n, c in found.items()])


def bandwidth_to_q(octaves: float) -> float:
    return math.sqrt(2**octaves) / (2**octaves - 1)


def q_to_bandwidth(q: float) -> float:
    return 2 / math.log(2) * math.asinh(1 / (2 * q))
