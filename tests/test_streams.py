"""Streams whose rows come in no order, in several frames and files."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from corvana.plans import streams
from corvana.streaming import states


def test_rows_in_order():
    n = 5000
    at = np.random.default_rng(3).permutation(n)
    every = pd.DataFrame({"ts": pd.to_datetime(at // 3, unit="s"), "event_id": at, "value": at * 0.5})
    frames = [every[k : k + 700] for k in range(0, n, 700)]
    for held in (1 << 20, 1000):  # all in memory, and sorted runs in files
        assert [r[1] for r in states.in_order(iter(frames), held)] == list(range(n))


def test_streams_of_unordered_folders(spark, tmp_path):
    """Two users of 12,000 rows each, in no order, in a folder of files: more than a frame of each."""
    rows = spark.range(24_000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(0) + F.floor(F.col("id") / 4)).alias("ts"), (F.col("id") % 2).alias("user_id"), ((F.col("id") * 7919) % 101).cast("double").alias("value"))
    rows.orderBy(F.md5(F.col("event_id").cast("string"))).repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    state, y = {0: [], 1: []}, {0: 0.0, 1: 0.0}
    smooth = {}
    for i in range(24_000):
        u, v = i % 2, float(i * 7919 % 101)
        y[u] += (v - y[u]) * (0.4 if v > y[u] else 0.05)
        smooth[i] = y[u]
        if not state[u] or state[u][-1][0] != (v >= 50):
            state[u].append([v >= 50, 0])
        state[u][-1][1] += 1
    got = {(r.user_id, r.island): (r.state, r.n) for r in streams.islands(spark, str(tmp_path)).collect()}
    assert got == {(u, k): tuple(x) for u in state for k, x in enumerate(state[u][:-1])}
    found = {r.event_id: r.value for r in streams.smoothed(spark, str(tmp_path)).collect()}
    assert len(found) == 24_000 and all(abs(found[i] - smooth[i]) < 1e-4 for i in found)
