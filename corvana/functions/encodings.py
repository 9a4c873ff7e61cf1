"""Encodings, hashes and binary numbers. JVM expressions where Spark has them, Arrow kernels elsewhere."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def base64(b: Column, padded: bool = True) -> Column:
    text = F.regexp_replace(F.base64(b), r"\s", "")
    return text if padded else F.regexp_replace(text, "=+$", "")


def unbase64(s: Column) -> Column:
    """Padding may be missing."""
    body = F.regexp_replace(s, r"[\s=]", "")
    return F.unbase64(F.concat(body, F.repeat(F.lit("="), F.pmod(-F.length(body), F.lit(4)).cast("int"))))


def hexed(b: Column) -> Column:
    return F.lower(F.hex(b))


def unhexed(s: Column) -> Column:
    return F.unhex(s)


def ascii_bytes(s: Column) -> Column:
    """Null for texts beyond ASCII."""
    return F.when(~s.rlike(r"[^\x00-\x7F]"), F.encode(s, "US-ASCII"))


def utf8(s: Column) -> Column:
    return F.encode(s, "UTF-8")


def utf16(s: Column) -> Column:
    return F.encode(s, "UTF-16LE")


def from_utf16(b: Column) -> Column:
    return F.decode(b, "UTF-16LE")


def from_utf32(points: Column) -> Column:
    """Code points to text, by way of their UTF-8 bytes."""

    def one(c: Column) -> Column:
        part = lambda shift, mark: F.lpad(F.hex(F.shiftright(c, shift).bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(mark))), 2, "0")
        two = F.hex(F.shiftright(c, 6).bitwiseOR(F.lit(0xC0)))
        three = F.hex(F.shiftright(c, 12).bitwiseOR(F.lit(0xE0)))
        four = F.hex(F.shiftright(c, 18).bitwiseOR(F.lit(0xF0)))
        return (
            F.when(c < 0x80, F.lpad(F.hex(c), 2, "0")).when(c < 0x800, F.concat(two, part(0, 0x80)))
            .when(c < 0x10000, F.concat(three, part(6, 0x80), part(0, 0x80))).otherwise(F.concat(four, part(12, 0x80), part(6, 0x80), part(0, 0x80)))
        )

    return F.decode(F.unhex(F.array_join(F.transform(points, one), "")), "UTF-8")


def escape_html(s: Column) -> Column:
    out = s
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def unescape_html(s: Column) -> Column:
    """& last, so that nothing is unescaped twice."""
    out = s
    for pattern, b in (("&(lt|#60|#x3[cC]);", "<"), ("&(gt|#62|#x3[eE]);", ">"), ("&(quot|#34|#x22);", '"'), ("&(apos|#39|#x27);", "'"), ("&(amp|#38|#x26);", "&")):
        out = F.regexp_replace(out, pattern, b)
    return out


def sha256(s: Column) -> Column:
    return F.sha2(s, 256)


def murmur3_int(n: Column) -> Column:
    """MurmurHash3 (x86, 32 bits, seed 42) of a little-endian int32, unsigned."""
    return F.hash(n).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))


def murmur3(data: bytes, seed: int = 0) -> int:
    """MurmurHash3, x86, 32 bits, unsigned."""
    mask, h = 0xFFFFFFFF, seed
    mix = lambda k: ((k * 0xCC9E2D51 & mask) << 15 | (k * 0xCC9E2D51 & mask) >> 17) * 0x1B873593 & mask
    whole = len(data) // 4 * 4
    for (k,) in struct.iter_unpack("<I", data[:whole]):
        h ^= mix(k)
        h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    if data[whole:]:
        h ^= mix(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * factor & mask
    return h


def murmur3_many(data: list[bytes], seed: int = 0) -> np.ndarray:
    """murmur3() of many byte strings: their blocks in step with each other, the longest first, so that those still at work stand together."""
    order = sorted(range(len(data)), key=lambda n: -len(data[n]))
    size = np.array([len(data[n]) for n in order], np.int64)
    words = -(-size // 4)
    flat = np.frombuffer(b"".join(data[n] + bytes(-len(data[n]) % 4) for n in order), "<u4")
    start, whole = np.cumsum(words) - words, size // 4
    h = np.full(len(data), seed, np.uint32)
    left = lambda x, n: x << np.uint32(n) | x >> np.uint32(32 - n)
    mixed = lambda k: left(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    for b in range(int(whole[0]) if len(data) else 0):
        n = int(np.searchsorted(-whole, -b))  # with more than b blocks
        h[:n] = left(h[:n] ^ mixed(flat[start[:n] + b]), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    rest = np.flatnonzero(words > whole)  # a last block of one to three bytes, zeros behind
    h[rest] ^= mixed(flat[start[rest] + whole[rest]])
    h ^= size.astype(np.uint32)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> np.uint32(shift)) * np.uint32(factor)
    out = np.empty(len(data), np.int64)
    out[order] = h
    return out


@F.pandas_udf(T.LongType())
def murmur3_text(s: pd.Series) -> pd.Series:
    known = s.notna()
    out = pd.Series(pd.array([pd.NA] * len(s), "Int64"), index=s.index)
    out[known] = murmur3_many([x.encode("utf-8") for x in s[known]])
    return out


@F.pandas_udf(T.StringType())
def from_windows_1252(b: pd.Series) -> pd.Series:
    """Bytes without a character become the control character of the same number."""
    return b.map(lambda x: None if x is None else "".join(bytes([c]).decode("cp1252", "ignore") or chr(c) for c in x))


@F.pandas_udf(T.StructType([T.StructField("raw", T.IntegerType()), T.StructField("deflated", T.IntegerType()), T.StructField("ratio", T.DoubleType())]))
def deflate_metrics(s: pd.Series) -> pd.DataFrame:
    """Bytes of a text before and after raw deflate, and their ratio (0 for an empty text)."""

    def one(x):
        data = (x or "").encode("utf-8")
        c = zlib.compressobj(wbits=-15)
        n = len(c.compress(data) + c.flush())
        return len(data), n, len(data) / n if data else 0.0

    return pd.DataFrame(s.map(one).tolist(), columns=["raw", "deflated", "ratio"])


def leb128(n: int) -> bytes:
    if n < 0:
        raise ValueError("a negative number has no unsigned form")
    out = bytearray()
    while True:
        low, n = n & 0x7F, n >> 7
        out.append(low | 0x80 * bool(n))
        if not n:
            return bytes(out)


def leb128_signed(n: int) -> bytes:
    out = bytearray()
    while True:
        low, n = n & 0x7F, n >> 7
        done = n == 0 and not low & 0x40 or n == -1 and bool(low & 0x40)
        out.append(low | 0x80 * (not done))
        if done:
            return bytes(out)


def from_leb128(data: bytes, signed: bool = False) -> int:
    n = shift = 0
    for b in data:
        n |= (b & 0x7F) << shift
        shift += 7
        if not b & 0x80:
            break
    return n - (1 << shift) if signed and data and data[shift // 7 - 1] & 0x40 else n


def encode_leb128(n: Column, signed: bool = True) -> Column:
    """Seven bits of a whole number to a byte, lowest first; null for a negative number without a sign."""
    n = n.cast("long")
    fits = (lambda k: n.between(F.expr(f"-(1L << {7 * k - 1})"), F.expr(f"(1L << {7 * k - 1}) - 1"))) if signed else (lambda k: n < F.expr(f"1L << {7 * k}"))
    size = F.coalesce(*[F.when(fits(k), k) for k in range(1, 9)], F.lit(10 if signed else 9))
    septet = lambda i: F.call_function("shiftright", n, i * 7).bitwiseAND(F.lit(127))
    octets = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.lpad(F.hex(septet(i) + F.when(i < size - 1, 128).otherwise(0)), 2, "0"))
    coded = F.unhex(F.array_join(octets, ""))
    return coded if signed else F.when(n >= 0, coded)


def decode_leb128(b: Column, signed: bool = True) -> Column:
    """The whole number at the start of the bytes."""
    octet = lambda i: F.conv(F.hex(F.substring(b, i, F.lit(1))), 16, 10).cast("long")
    octets = F.transform(F.sequence(F.lit(1), F.length(b)), octet)
    last = F.array_min(F.filter(F.transform(octets, lambda x, i: F.when(x < 128, i)), lambda i: i.isNotNull()))
    septets = F.transform(F.slice(octets, F.lit(1), F.coalesce(last, F.size(octets) - 1) + 1), lambda x, i: F.call_function("shiftleft", x.bitwiseAND(F.lit(127)), i * 7))
    n = F.aggregate(septets, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    negative = F.element_at(octets, F.size(septets)).bitwiseAND(F.lit(64)) != 0
    return F.when(negative & (F.size(septets) < 10), n - F.call_function("shiftleft", F.lit(1).cast("long"), F.size(septets) * 7)).otherwise(n) if signed else n


def little_endian(b: Column, offset: int, width: int, signed: bool) -> Column:
    """The whole number in width bytes at an offset from 0."""
    digits = F.concat(*[F.hex(F.substring(b, offset + 1 + i, 1)) for i in reversed(range(width))])
    n = F.conv(digits, 16, 10).cast("long")
    return F.when(n >= 1 << (8 * width - 1), n - (1 << 8 * width)).otherwise(n) if signed else n


def to_little_endian(n: Column, width: int) -> Column:
    """The lowest width bytes of a whole number, lowest first."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(n.cast("long"), 8 * i).bitwiseAND(F.lit(0xFF))), 2, "0") for i in range(width)]))


def pcm_numbers(samples: Column, bits: int) -> Column:
    """Floats in [-1, 1], clipped, as whole numbers of 8 (unsigned), 16, 24 or 32 bits; halves go to the even number."""
    scale = float(1 << (bits - 1))
    return F.transform(samples, lambda x: (F.greatest(F.lit(-scale), F.least(F.lit(scale - 1), F.rint(x * scale))) + (128 if bits == 8 else 0)).cast("long"))


def from_pcm_numbers(numbers: Column, bits: int) -> Column:
    scale = float(1 << (bits - 1))
    return F.transform(numbers, lambda n: (n - (128 if bits == 8 else 0)) / F.lit(scale))


def pcm_bytes(samples: Column, bits: int) -> Column:
    """The numbers one after the other, lowest byte first."""
    return F.unhex(F.array_join(F.transform(pcm_numbers(samples, bits), lambda n: F.hex(to_little_endian(n, bits // 8))), ""))


PCM = {8: (np.uint8, 128), 16: (np.int16, 32768), 24: (np.int32, 8388608), 32: (np.int32, 2147483648)}


def to_pcm(samples: np.ndarray, bits: int) -> bytes:
    """Floats in [-1, 1], clipped, as little-endian whole numbers; 8 bits are unsigned."""
    kind, scale = PCM[bits]
    x = np.clip(np.rint(np.asarray(samples, np.float64) * scale), -scale, scale - 1).astype(np.int64)
    if bits == 8:
        return (x + 128).astype(np.uint8).tobytes()
    if bits == 24:
        return x.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    return x.astype(np.dtype(kind).newbyteorder("<")).tobytes()


def from_pcm(data: bytes, bits: int) -> np.ndarray:
    kind, scale = PCM[bits]
    if bits == 8:
        return (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / scale
    if bits == 24:
        wide = np.zeros((len(data) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, 3)
        return (wide.view("<i4").ravel() >> 8) / scale
    return np.frombuffer(data, np.dtype(kind).newbyteorder("<")) / scale
