"""Aggregates across vectors, element by element: partial aggregation before one small shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvana.operators.parts import MOST, RunningMean, in_parts, is_long

DIAGONAL = 1e-6


def long_form(df: DataFrame, vector: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.posexplode(vector).alias("pos", "x"))


def mean(df: DataFrame, key: str, vector: str) -> DataFrame:
    return long_form(df, vector, key).groupBy(key, "pos").agg(F.avg("x").alias("value"))


def weighted_mean(df: DataFrame, key: str, vector: str, weight: str) -> DataFrame:
    """Sum of weighted values; weights are taken as they are."""
    return long_form(df, vector, key, weight).groupBy(key, "pos").agg(F.sum(F.col("x") * F.col(weight)).alias("value"))


def variance(df: DataFrame, key: str, vector: str, sample: bool = False) -> DataFrame:
    """One vector alone has variance 0."""
    measure = F.when(F.count("x") > 1, F.var_samp("x")).otherwise(0.0) if sample else F.var_pop("x")
    return long_form(df, vector, key).groupBy(key, "pos").agg(measure.alias("value"))


def deviation(df: DataFrame, key: str, vector: str, sample: bool = False) -> DataFrame:
    return variance(df, key, vector, sample).withColumn("value", F.sqrt("value"))


def normalize(df: DataFrame, key: str, row_id: str, vector: str) -> DataFrame:
    """z-scores of each element over its set; 0 where the set doesn't vary. A set's moments are aggregated and joined back."""
    stats = long_form(df, vector, key).groupBy(key, "pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("d"))
    joined = long_form(df, vector, key, row_id).join(stats, [key, "pos"])
    return joined.select(row_id, "pos", F.when(F.col("d") == 0, 0.0).otherwise((F.col("x") - F.col("m")) / F.when(F.col("d") != 0, F.col("d"))).alias("value"))


def center(df: DataFrame, key: str, row_id: str, vector: str) -> DataFrame:
    joined = long_form(df, vector, key, row_id).join(mean(df, key, vector).withColumnRenamed("value", "m"), [key, "pos"])
    return joined.select(row_id, "pos", (F.col("x") - F.col("m")).alias("value"))


PRODUCTS = (("i", T.IntegerType()), ("j", T.IntegerType()), ("xy", T.DoubleType()), ("x", T.DoubleType()), ("y", T.DoubleType()), ("n", T.LongType()))


def products(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, i, j, xy, x, y, n): sums of products and of their factors over the vectors of a key in a batch, i <= j; a batch sends its sums only."""
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, codes = batch.column("v"), batch.column(key).dictionary_encode(null_encoding="encode")
            flat, sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(lists.offsets.to_numpy())
            starts, of = np.cumsum(sizes) - sizes, codes.indices.to_numpy(zero_copy_only=False)
            for code, dim in sorted(set(zip(of.tolist(), sizes.tolist(), strict=True))):
                own = np.flatnonzero((of == code) & (sizes == dim))
                x = flat[starts[own][:, None] + np.arange(dim)]
                i, j = np.triu_indices(dim)
                total = x.sum(axis=0)
                columns = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array((x.T @ x)[i, j]), pa.array(total[i]), pa.array(total[j]), pa.array(np.full(len(i), len(own)))]
                keys = codes.dictionary.take(pa.array(np.full(len(i), code)))
                yield pa.RecordBatch.from_arrays([keys, *columns], names=[key, "i", "j", "xy", "x", "y", "n"])

    fields = [T.StructField(key, kind), *(T.StructField(n, t) for n, t in PRODUCTS)]
    return df.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, T.StructType(fields))


def covariance(df: DataFrame, key: str, vector: str, biased: bool = False) -> DataFrame:
    """The upper triangle (i <= j), with a small amount on the diagonal; a single vector has zeros. Null vectors are left out, a null component makes its sums not a number.

    Products are summed batch by batch before anything is shuffled.
    """
    sums = products(df, key, vector).groupBy(key, "i", "j").agg(*[F.sum(c).alias(c) for c in ("xy", "x", "y", "n")])
    measure = (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / (F.col("n") if biased else F.greatest(F.col("n") - 1, F.lit(1)))
    diagonal = F.when(F.col("i") == F.col("j"), DIAGONAL).otherwise(0.0)
    return sums.select(key, "i", "j", F.when(F.col("n") > 1, measure + diagonal).otherwise(0.0).alias("value"))


def weighted_covariance(df: DataFrame, key: str, vector: str, weight: str) -> DataFrame:
    """covariance() of centered vectors whose products are summed with their weights, as they are."""
    v = F.col(vector)
    pairs = F.flatten(F.transform(v, lambda x, i: F.filter(F.transform(v, lambda y, j: F.struct(i.alias("i"), j.alias("j"), (x * y).alias("xy"))), lambda s: s["i"] <= s["j"])))
    flat = df.select(key, F.col(weight).alias("w"), F.inline(pairs))
    found = flat.groupBy(key, "i", "j").agg(F.sum(F.col("w") * F.col("xy")).alias("c"), F.count("*").alias("n"))
    diagonal = F.when(F.col("i") == F.col("j"), DIAGONAL).otherwise(0.0)
    return found.select(key, "i", "j", F.when(F.col("n") > 1, F.col("c") + diagonal).otherwise(0.0).alias("value"))


def running_mean(df: DataFrame, key: str, order: list[str], value: str, most: int = MOST) -> DataFrame:
    """df with the mean of a key's values up to each row. Where a key has more than `most` rows, sums are handed from part to part."""
    if is_long(df, key, most):
        there = F.col(value).isNotNull()
        channels = df.withColumns({"value_": F.coalesce(F.col(value).cast("double"), F.lit(0.0)), "there_": there.cast("double")})
        found = in_parts(channels, key, order, ["value_", "there_"], RunningMean()).drop("value_", "there_")
        return found.withColumn("mean", F.nanvl("mean", F.lit(None).cast("double")))
    by = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("mean", F.avg(value).over(by))
