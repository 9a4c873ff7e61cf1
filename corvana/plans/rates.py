"""Queries of signals at another rate and of merged settings, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvana.functions import trees
from corvana.operators import resampling
from corvana.plans.vectors import SINGLE_FROM, rows
from corvana.session import table

UP, DOWN, TAPS = 3, 4, 6


def told(c: str):
    return F.transform(c, lambda x: F.round(x + 1e-9, 6) + 0.0).alias("v")


def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as signals at three quarters of their rate."""
    return rows(spark, sf_dir).select("vec_id", resampling.resampled(F.col("v"), UP, DOWN, TAPS).alias("v")).select("vec_id", told("v"))


def resampled_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of a label, in order of their ids, as one signal in parts."""
    found = resampling.resampled_parts(rows(spark, sf_dir).select("label", "vec_id", "v"), "label", "vec_id", "v", UP, DOWN, TAPS)
    return found.select("vec_id", told("v"))


REACH = math.ceil(TAPS * DOWN / UP)
T = f"(n * {DOWN} / {UP}::DOUBLE - k)"
SINC = f"CASE WHEN {T} = 0 THEN 1.0 ELSE sin(pi() * {T} * {UP} / {DOWN}) / (pi() * {T} * {UP} / {DOWN}) END"
H = f"CASE WHEN abs({T}) < {REACH} THEN ({SINC}) * (0.5 + 0.5 * cos(pi() * {T} / {REACH})) ELSE 0 END"
NEAR = f"range(n * {DOWN} // {UP} - {REACH - 1}, n * {DOWN} // {UP} + {REACH + 1})"
Y = f"list_sum(list_transform({NEAR}, lambda k: CASE WHEN k >= 0 AND k < len({{x}}) THEN {{x}}[k + 1] ELSE 0 END * ({H}))) / list_sum(list_transform({NEAR}, lambda k: {H}))"
RESAMPLED_SQL = f"SELECT vec_id, list_transform(range(0, CAST(ceil(len(v) * {UP} / {DOWN}) AS BIGINT)), lambda n: round({Y.format(x='v')} + 1e-9, 6) + 0.0) AS v FROM {SINGLE_FROM}"
PARTS_SQL = f"""
WITH signals AS (
  SELECT label, flatten(list(embedding::DOUBLE[] ORDER BY vec_id)) AS x FROM embeddings GROUP BY label
), places AS (
  SELECT label, vec_id, coalesce(sum(len(embedding)) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a, len(embedding) AS size FROM embeddings
), near AS (
  SELECT vec_id, greatest(a - {REACH}, 0) AS f, x[greatest(a - {REACH}, 0) + 1:a + size + {REACH}] AS s, range((a * {UP} + {DOWN - 1}) // {DOWN}, ((a + size) * {UP} + {DOWN - 1}) // {DOWN}) AS n FROM places JOIN signals USING (label)
)
SELECT vec_id, list_transform(n, lambda n: round(list_sum(list_transform({NEAR}, lambda k: CASE WHEN k >= f AND k < f + len(s) THEN s[k - f + 1] ELSE 0 END * ({H}))) / list_sum(list_transform({NEAR}, lambda k: {H})) + 1e-9, 6) + 0.0) AS v FROM near
"""


PATHS = ("props.k", "props.deep.a", "props.deep.b", "props.deep.c", "kind", "limits.low", "limits.high", "more")


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's settings laid over defaults of its kind."""
    n = F.col("event_id")
    base = F.concat(F.lit('{"props":{"k":0,"deep":{"a":1,"b":[1,2]}},"kind":"'), "event_type", F.lit('","limits":{"low":'), n.cast("string"), F.lit(',"high":null}}'))
    extension = (
        F.when(n % 5 == 0, F.concat(F.lit('{"props":'), "props", F.lit("}")))
        .when(n % 5 == 1, F.lit('{"limits":7,"more":{"x":{}}}'))
        .when(n % 5 == 2, F.concat(F.lit('{"props":{"deep":{"b":[3],"c":"é"},"k":'), "props", F.lit("}}")))
        .when(n % 5 == 3, F.lit('{"kind":{"name":"other"},"limits":{"high":9}}'))
        .otherwise(F.lit("{}"))
    )
    found = table(spark, sf_dir, "events").select("event_id", trees.merged(base, extension).alias("j"))
    return found.select("event_id", *[F.get_json_object("j", f"$.{p}").alias(p.replace(".", "_")) for p in PATHS], F.col("j").contains('"high":null').alias("has_null"), F.length("j").alias("size"))


MERGED_SQL = f"""
WITH merged AS (
  SELECT event_id, CAST(json_merge_patch('{{"props":{{"k":0,"deep":{{"a":1,"b":[1,2]}}}},"kind":"' || event_type || '","limits":{{"low":' || event_id || ',"high":null}}}}',
    CASE event_id % 5 WHEN 0 THEN '{{"props":' || props || '}}' WHEN 1 THEN '{{"limits":7,"more":{{"x":{{}}}}}}' WHEN 2 THEN '{{"props":{{"deep":{{"b":[3],"c":"é"}},"k":' || props || '}}}}' WHEN 3 THEN '{{"kind":{{"name":"other"}},"limits":{{"high":9}}}}' ELSE '{{}}' END) AS VARCHAR) AS j FROM events
)
SELECT event_id, {", ".join(f"json_extract_string(j, '$.{p}') AS {p.replace('.', '_')}" for p in PATHS)}, contains(j, '"high":null') AS has_null, CAST(length(j) AS INTEGER) AS size FROM merged
"""

QUERIES = {"sig_resampled": (resampled, RESAMPLED_SQL), "sig_resampled_parts": (resampled_parts, PARTS_SQL), "cfg_merged": (merged, MERGED_SQL)}


def queries() -> dict:
    return {n: q for n, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in QUERIES.items()}
