"""Gaps and islands: frames with the same activity state merge into one segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvana.operators.parts import MOST, Changes, in_parts, is_long


def state_islands(df: DataFrame, key: str, order: list[str], active: Column, most: int = MOST) -> DataFrame:
    """Rows of each key numbered by runs of an equal state; a null state counts as inactive.

    Adds ``state`` and ``island`` (from 0). One shuffle on the key serves both windows; where a key has
    more than `most` rows, its rows are numbered in parts instead, by several tasks.
    """
    flagged = df.withColumn("state", F.coalesce(active, F.lit(False)))
    if is_long(df, key, most):
        found = in_parts(flagged.withColumn("flag", F.col("state").cast("double")), key, order, "flag", Changes("island"))
        return found.drop("flag").withColumn("island", F.col("island").cast("long"))
    by = Window.partitionBy(key).orderBy(*order)
    changed = F.coalesce((F.lag("state").over(by) != F.col("state")).cast("int"), F.lit(0))
    return flagged.withColumn("changed", changed).withColumn("island", F.sum("changed").over(by)).drop("changed")
