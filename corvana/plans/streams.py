"""Queries that run as streams to their end, against the SQL of the same operator in one piece."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvana.session import shared_dir, table
from corvana.streaming import states

THRESHOLD = 50.0


def streamed(spark: SparkSession, sf_dir: str, operator) -> DataFrame:
    """The rows that an operator gives for the stream of event files (one file or a folder of them), all that are there now; results and state lie in the shared folder."""
    where = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, since a stream takes no path of a single file
    writer = operator(events).writeStream.format("parquet").option("path", f"{where}/rows").option("checkpointLocation", f"{where}/state").trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.parquet(f"{where}/rows")


def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands that have closed: a user's last one is still open when the stream ends."""
    found = streamed(spark, sf_dir, lambda events: states.stream_islands(events, THRESHOLD))
    return found.select("user_id", "island", "state", "n")


ISLANDS_SQL = f"""
WITH flagged AS (SELECT user_id, ts, event_id, coalesce(value >= {THRESHOLD}, false) AS state FROM events),
marked AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) <> state THEN 1 ELSE 0 END AS changed FROM flagged),
numbered AS (SELECT *, CAST(sum(changed) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS island FROM marked),
found AS (SELECT user_id, island, state, count(*) AS n, max(island) OVER (PARTITION BY user_id) AS last FROM numbered GROUP BY user_id, island, state)
SELECT user_id, island, state, n FROM found WHERE island < last
"""


def smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streamed(spark, sf_dir, lambda events: states.stream_smoothed(events, 0.4, 0.05))
    return found.select("event_id", (F.round(F.col("smoothed") + 1e-9, 4) + 0.0).alias("value"))


SMOOTH = "a[1] + (x[1] - a[1]) * CASE WHEN x[1] > a[1] THEN 0.4 ELSE 0.05 END"
SMOOTHED_SQL = f"""
SELECT event_id, round(y + 1e-9, 4) + 0.0 AS value FROM (SELECT unnest(ids) AS event_id, unnest(list_reduce(list_prepend([0::DOUBLE], list_transform(v, lambda x: [x])), lambda a, x: list_append(list_prepend({SMOOTH}, a[2:]), {SMOOTH}))[2:]) AS y
  FROM (SELECT list(event_id ORDER BY ts, event_id) AS ids, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id))
"""

QUERIES = {"stream_islands": (islands, ISLANDS_SQL), "stream_smoothed": (smoothed, SMOOTHED_SQL)}


def queries() -> dict:
    return {n: q for n, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in QUERIES.items()}
