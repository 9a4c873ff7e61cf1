"""The registered queries over the driver's tables and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvana.plans import activity, articles, carried, pieces, rates, results, samples, speech, streams, texts, timelines, vectors
from corvana.plans.islands import state_islands
from corvana.session import table

Query = Callable[[SparkSession, str], DataFrame]

THRESHOLD = 50.0


def islands_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = state_islands(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("value") >= THRESHOLD)
    return rows.groupBy("user_id", "island", "state").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n")
    )


ISLANDS_SQL = f"""
WITH flagged AS (
  SELECT user_id, ts, event_id, coalesce(value >= {THRESHOLD}, false) AS state FROM events
), marked AS (
  SELECT *, CASE WHEN lag(state) OVER w <> state THEN 1 ELSE 0 END AS changed FROM flagged
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), numbered AS (
  SELECT *, CAST(sum(changed) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS island FROM marked
)
SELECT user_id, island, state, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n
FROM numbered GROUP BY user_id, island, state
"""


PARTS = (vectors, texts, timelines, samples, speech, streams, activity, pieces, carried, results, rates, articles)


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {"islands_events": islands_events}
    for part in PARTS:
        found |= part.queries()
    return found


def oracle_sql() -> dict[str, str]:
    found = {"islands_events": ISLANDS_SQL}
    for part in PARTS:
        found |= part.oracle_sql()
    return found
