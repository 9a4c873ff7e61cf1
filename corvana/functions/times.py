"""Seconds, frames, decibels and mel as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvana.functions.texts import leading_zeros
from corvana.functions.vectors import clip

FRAME = 0.02


def whole_ms(seconds: Column) -> Column:
    """Whole milliseconds, downward; a rounding error just under a millisecond doesn't lose it."""
    return F.floor(seconds * 1000 + 1e-6).cast("long")


def hms(seconds: Column) -> Column:
    n = whole_ms(seconds)
    return F.struct(F.floor(n / 3600000).alias("hours"), F.floor(n / 60000 % 60).alias("minutes"), F.floor(n / 1000 % 60).alias("seconds"), (n % 1000).alias("milliseconds"))


def format_hms(seconds: Column, decimal: str = ".") -> Column:
    n = whole_ms(seconds)
    part = lambda unit: F.floor(n / unit)
    return F.concat(leading_zeros(part(3600000), 2), F.lit(":"), leading_zeros(part(60000) % 60, 2), F.lit(":"), leading_zeros(part(1000) % 60, 2), F.lit(decimal), leading_zeros(n % 1000, 3))


def format_ms(seconds: Column, decimal: str = ".") -> Column:
    """Minutes hold the hours too."""
    n = whole_ms(seconds)
    return F.concat(leading_zeros(F.floor(n / 60000), 2), F.lit(":"), leading_zeros(F.floor(n / 1000) % 60, 2), F.lit(decimal), leading_zeros(n % 1000, 3))


def frame_of(seconds: Column, frame: float = FRAME) -> Column:
    return F.floor(seconds / frame)


def frames_in(start: Column, end: Column, frame: float = FRAME) -> Column:
    """Null for a reversed range."""
    return F.when(end >= start, frame_of(end, frame) - frame_of(start, frame))


def token_seconds(token: Column, first: int) -> Column:
    return clip((token - first) * FRAME, 0.0, 30.0)


def duration(samples: Column, rate: Column) -> Column:
    return F.size(samples) / rate


def gain_to_decibels(x: Column) -> Column:
    return F.when(x <= 1e-5, -100.0).otherwise(20 * F.log10(x))


def decibels_to_gain(d: Column) -> Column:
    return F.when(d <= -100, 0.0).otherwise(F.pow(F.lit(10.0), d / 20))


def power_to_decibels(x: Column) -> Column:
    return F.when(x <= 1e-10, -100.0).otherwise(10 * F.log10(x))


def decibels_to_power(d: Column) -> Column:
    return F.when(d <= -100, 0.0).otherwise(F.pow(F.lit(10.0), d / 10))


def hertz_to_mel(f: Column) -> Column:
    return 2595 * F.log10(1 + f / 700)


def mel_to_hertz(m: Column) -> Column:
    return 700 * (F.pow(F.lit(10.0), m / 2595) - 1)
