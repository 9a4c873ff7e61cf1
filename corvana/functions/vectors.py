"""Vector functions as Column expressions: one array in, a value or an array out, in double precision.

Empty arrays: sums, means, norms and distances are 0, argmax and argmin -1, transforms empty. Null
arrays give null. Where a division has a zero divisor the result is 0, as for not-a-number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def divide(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def fold(v: Column, step) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + step(x))


def let(value: Column, use) -> Column:
    """use(value), with value computed once for each row rather than at each of its uses."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def zero_if_nan(x: Column) -> Column:
    return F.nanvl(x, F.lit(0.0))


def clip(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low) if not isinstance(low, Column) else low, F.least(F.lit(high) if not isinstance(high, Column) else high, x))


def round_half_up(x: Column, digits: int = 3) -> Column:
    """Halves go toward plus infinity."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


# aggregates within one array

def total(v: Column) -> Column:
    return fold(v, lambda x: x)


def sum_of_squares(v: Column) -> Column:
    return fold(v, lambda x: x * x)


def sum_and_squares(v: Column) -> Column:
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("squares"))
    return F.aggregate(v, zero, lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["squares"] + x * x).alias("squares")))


def mean(v: Column) -> Column:
    return divide(total(v), F.size(v).cast("double"))


def upper_median(v: Column) -> Column:
    """Of an even number of values the upper one; null if there is none."""
    return F.try_element_at(F.sort_array(v), F.floor(F.size(v) / 2).cast("int") + 1)


def variance(v: Column, sample: bool = False) -> Column:
    """One value alone has variance 0."""
    n = F.size(v).cast("double")
    return let(mean(v), lambda m: divide(fold(v, lambda x: (x - m) * (x - m)), F.greatest(n - 1, F.lit(1.0)) if sample else n))


def deviation(v: Column, sample: bool = False) -> Column:
    return F.sqrt(variance(v, sample))


def largest(v: Column) -> Column:
    """NaN isn't largest: it is left out."""
    return F.array_max(F.filter(v, lambda x: ~F.isnan(x)))


def smallest(v: Column) -> Column:
    return F.array_min(F.filter(v, lambda x: ~F.isnan(x)))


def index_of(v: Column, value: Column) -> Column:
    """The first place, from 0, of a value; -1 if there is none."""
    return F.coalesce(F.array_position(v, value) - 1, F.lit(-1)).cast("int")


def index_of_max(v: Column) -> Column:
    return index_of(v, largest(v))


def index_of_min(v: Column) -> Column:
    return index_of(v, smallest(v))


def last_index_in_range(v: Column, value: Column, start: int, end: int) -> Column:
    """The last place in [start, end) that holds the value; -1 if there is none."""
    places = F.filter(F.sequence(F.lit(start), F.lit(max(start, end - 1))), lambda i: (i < end) & (F.get(v, i) == value))
    return F.coalesce(F.array_max(places), F.lit(-1)).cast("int")


# transforms

def center(v: Column) -> Column:
    return let(mean(v), lambda m: F.transform(v, lambda x: x - m))


def scale_to_sum_1(v: Column) -> Column:
    """Shifted up by twice the lowest value, if that is negative; a single value becomes 1, a zero sum stays as it is."""
    low = F.coalesce(F.array_min(v), F.lit(0.0))
    moved = let(low, lambda low: F.transform(v, lambda x: x + F.when(low < 0, -2 * low).otherwise(F.lit(0.0))))
    scaled = let(moved, lambda a: let(total(a), lambda s: F.transform(a, lambda x: F.when(s == 0, x).otherwise(divide(x, s)))))
    return F.when(F.size(v) == 1, F.array(F.lit(1.0))).otherwise(scaled)


def z_scores(v: Column, sample: bool = False) -> Column:
    return let(mean(v), lambda m: let(deviation(v, sample), lambda d: F.transform(v, lambda x: divide(x - m, d))))


def log_of(v: Column, least: float = 1e-40) -> Column:
    return F.transform(v, lambda x: F.ln(x + least))


def exp_of(v: Column) -> Column:
    return F.transform(v, F.exp)


def moving_average_3(v: Column) -> Column:
    """The ends repeat their value."""
    n = F.size(v)
    return F.transform(v, lambda x, i: (F.get(v, F.greatest(i - 1, F.lit(0))) + x + F.get(v, F.least(i + 1, n - 1))) / 3)


def median_filter(v: Column, width: int) -> Column:
    """Moving median of an odd width; width // 2 values at each end stay, as do arrays that are too short."""
    side, n = width // 2, F.size(v)
    return F.transform(v, lambda x, i: F.when((i >= side) & (i < n - side), F.get(F.sort_array(F.slice(v, F.greatest(i - side + 1, F.lit(1)), width)), F.lit(side))).otherwise(x))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def denormalize(v: Column, means: Column, deviations: Column) -> Column:
    return F.zip_with(F.zip_with(v, deviations, lambda x, d: x * d), means, lambda x, m: x + m)


def softmax(v: Column, temperature: float = 1.0) -> Column:
    t = max(temperature, 1e-5)
    e = let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp((x - top) / t)))
    return let(e, lambda e: let(total(e) + 1e-20, lambda s: F.transform(e, lambda x: x / s)))


def log_softmax(v: Column, least: float = 1e-40) -> Column:
    return log_of(softmax(v), least)


def sum_exp(v: Column) -> Column:
    return fold(v, F.exp)


def log_sum_exp(v: Column, least: float = 1e-40) -> Column:
    return F.ln(sum_exp(v) + least)


def sigmoid(x: Column) -> Column:
    return F.nanvl(1 / (1 + F.exp(-x)), F.lit(0.0))


def deltas(v: Column) -> Column:
    """Whole steps from a running value, which the rounding error stays with."""
    # the running value stays whole and within 1 below what it follows, so it is the floor of the value before
    return F.transform(v, lambda x, i: F.floor(x).cast("double") - F.when(i == 0, 0.0).otherwise(F.floor(F.get(v, i - 1)).cast("double")))


def top_k_indexes(v: Column, k: int) -> Column:
    """Places, from 0, of the k largest values, largest first, ties to the first place."""
    ranked = F.array_sort(F.transform(v, lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: s["i"])


def split_parts(v: Column, size: int) -> Column:
    n = F.ceil(F.size(v) / size).cast("int")
    return F.when(n == 0, F.array().cast("array<array<double>>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(v, i * size + 1, size)))


def constant(n: int, value: float = 0.0) -> Column:
    return F.array_repeat(F.lit(value), n)


def whole_numbers(start: Column, end: Column) -> Column:
    """[start, end); empty if end isn't larger."""
    return F.when(start < end, F.sequence(start, end - 1)).otherwise(F.array().cast("array<int>"))


def transpose(m: Column) -> Column:
    """Rows of equal length to columns."""
    width = F.size(F.get(m, F.lit(0)))
    return F.when((F.size(m) == 0) | (width == 0), F.array().cast("array<array<double>>")).otherwise(F.transform(F.sequence(F.lit(0), width - 1), lambda c: F.transform(m, lambda r: F.get(r, c))))


# pairs

def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def magnitude(v: Column) -> Column:
    return F.sqrt(sum_of_squares(v))


def squared_euclidean(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def euclidean_first(a: Column, b: Column, n: int = 13) -> Column:
    return euclidean(F.slice(a, 1, n), F.slice(b, 1, n))


def cosine_given(a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    return clip(F.nanvl(dot(a, b) / (size_a * size_b + 1e-40), F.lit(0.0)), -1.0, 1.0)


def cosine_similarity(a: Column, b: Column) -> Column:
    return cosine_given(a, b, magnitude(a), magnitude(b))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def minkowski(a: Column, b: Column, power: float) -> Column:
    return F.pow(total(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(power)))), F.lit(1.0 / power))


def mean_squared_error(a: Column, b: Column) -> Column:
    return divide(squared_euclidean(a, b), F.size(a).cast("double"))


def hamming(a: Column, b: Column, bits: int = 32) -> Column:
    """Differing bits among the lowest ones."""
    return F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit((1 << bits) - 1)))
