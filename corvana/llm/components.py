"""Connected components of a distributed edge table, by hooking roots and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvana.session import cut

#: A key is hot with more rows than this, and than this share of all, so that at most HOT_SHARE keys are broadcast; of so few rows that one task takes them all none is.
HOT_ROWS, HOT_SHARE, FEW_ROWS = 1_000, 100_000, 10_000


def joined(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined with right, which has each key once; a key that holds a large share of left meets right by broadcast, so its rows stay where they are."""
    total = left.count()
    if total <= FEW_ROWS:
        return left.join(right, key, how)
    counts = left.groupBy(key).agg(F.count("*").alias("n"))
    hot = cut(counts.where(F.col("n") > max(HOT_ROWS, total // HOT_SHARE)).select(key))
    if hot.isEmpty():
        return left.join(right, key, how)
    few = F.broadcast(hot)
    met = left.join(few, key, "left_semi").join(F.broadcast(right.join(few, key, "left_semi")), key, how)
    return met.unionByName(left.join(few, key, "left_anti").join(right, key, how))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node with an edge can reach.

    Each round maps the edges to the roots of their ends, hooks each root to its smallest
    neighbouring root, if that is smaller, and jumps pointers until each points to a root. Rounds
    end when no edge joins two roots; their number grows with the logarithm of the largest
    component. All state stays in tables; a round's are read from checkpoints.
    Self-loops and null ends make no edge; repeated edges count once; no edges give no rows.
    """
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    live = cut(pairs.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct())
    parent = live.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("root", F.col("node"))
    if live.isEmpty():
        return parent
    tasks = -(-live.count() // max(1, FEW_ROWS))
    kept = lambda df: cut(df).coalesce(tasks)
    live = live.coalesce(tasks)
    parent = kept(live.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("root", F.col("node")))
    while True:
        lowest = live.groupBy(F.col("v").alias("high")).agg(F.min("u").alias("low"))
        jumped = lowest
        while True:  # chains of hooks shrink to half with each jump
            step = joined(jumped, jumped.select(F.col("high").alias("low"), F.col("low").alias("lower")), "low", "left")
            step = kept(step.select("high", F.coalesce("lower", "low").alias("low"), F.col("lower").isNotNull().alias("moved")))
            jumped = step.select("high", "low")
            if step.where("moved").isEmpty():
                break
        parent = joined(parent, jumped.select(F.col("high").alias("root"), "low"), "root", "left")
        parent = kept(parent.select("node", F.coalesce("low", "root").alias("root")))
        tops_u, tops_v = jumped.select(F.col("high").alias("u"), F.col("low").alias("top_u")), jumped.select(F.col("high").alias("v"), F.col("low").alias("top_v"))
        mapped = joined(joined(live, tops_u, "u", "left"), tops_v, "v", "left").select(F.coalesce("top_u", "u").alias("p"), F.coalesce("top_v", "v").alias("q"))
        live = kept(mapped.where("p <> q").select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct())
        if live.isEmpty():
            return parent
