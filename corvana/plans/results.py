"""Queries of recognisers' results and of seeded permutations and normal numbers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvana.functions import randoms
from corvana.operators import events as ev
from corvana.plans.samples import NEXT
from corvana.plans.vectors import SINGLE_FROM, rows
from corvana.session import table

PER_SEGMENT = 7


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as one result in JSON: seven tokens to a segment, some segments opened by a mark, some tokens without offsets."""
    e = table(spark, sf_dir, "events")
    n = F.col("x.n")
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type", "value")))  # a user's events stand for one result
    numbered = e.groupBy("user_id").agg(F.transform(ordered, lambda x, i: F.struct(i.cast("long").alias("n"), x["event_id"].alias("event_id"), x["event_type"].alias("event_type"), x["value"].alias("value"))).alias("e"))
    one = numbered.select("user_id", F.explode("e").alias("x"))
    opens = (n % PER_SEGMENT == 0) & (F.floor(n / PER_SEGMENT) % 2 == 1)
    text = F.when(opens, ev.BEGIN).when(n % 3 == 0, F.concat(F.lit(" "), F.col("x.event_type"))).otherwise(F.substring("x.event_type", 1, 3))
    offsets = F.when(n % 5 != 4, F.struct(F.when(opens, 0).otherwise(n * 100).cast("long").alias("from"), F.when(opens, 0).otherwise(n * 100 + 80).cast("long").alias("to")))
    token = F.struct(F.col("x.event_id").cast("int").alias("id"), text.alias("text"), (F.col("x.event_id") % 100 / 100).alias("p"), (n * 11 - 5).alias("t_dtw"), offsets.alias("offsets"))
    tokens = one.groupBy("user_id", F.floor(n / PER_SEGMENT).alias("segment")).agg(F.transform(F.array_sort(F.collect_list(F.struct(n.alias("n"), token.alias("t")))), lambda x: x["t"]).alias("tokens"))
    segment = F.struct("segment", F.struct((F.col("segment") * 250).cast("long").alias("from"), (F.col("segment") * 250 + 250).cast("long").alias("to")).alias("offsets"), "tokens")
    whole = tokens.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(segment)), lambda s: F.struct(s["offsets"].alias("offsets"), s["tokens"].alias("tokens"))).alias("transcription"))
    language = F.when(F.col("user_id") % 2 == 0, "en").otherwise("de")
    return whole.select("user_id", F.to_json(F.struct(F.struct(language.alias("language")).alias("result"), "transcription")).alias("json"), F.lit(60.0).alias("total"))


def seconds(c: str):
    return (F.round(F.col(c) + 1e-9, 6) + 0.0).alias(c)


def result_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ev.result_timeline(ev.result_tokens(results(spark, sf_dir), "user_id", "json"), "user_id")
    return found.select("user_id", "segment", F.col("word").cast("int").alias("word"), "text", seconds("start_time"), seconds("end_time"), F.round("confidence", 6).alias("confidence"), F.size("tokens").alias("tokens"))


def result_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ev.result_tokens(results(spark, sf_dir), "user_id", "json", "total")
    return found.select("user_id", "language", "segment", "token", "id", "text", seconds("start_time"), seconds("end_time"))


TOKENS = f"""
numbered AS (
  SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events
), tokens AS (
  SELECT user_id, event_id, n, n // {PER_SEGMENT} AS segment, n % {PER_SEGMENT} AS token, event_id % 100 / 100::DOUBLE AS p, n % {PER_SEGMENT} = 0 AND n // {PER_SEGMENT} % 2 = 1 AS opens, n % 5 <> 4 AS timed, event_type FROM numbered
), texts AS (
  SELECT *, CASE WHEN opens THEN '[_BEG_]' WHEN n % 3 = 0 THEN ' ' || event_type ELSE event_type[1:3] END AS text, CASE WHEN timed THEN CASE WHEN opens THEN 0 ELSE n * 100 END END AS a, CASE WHEN timed THEN CASE WHEN opens THEN 0 ELSE n * 100 + 80 END END AS b FROM tokens
), filled AS (
  SELECT *, coalesce(a, last_value(b IGNORE NULLS) OVER w, 0) AS f, coalesce(b, last_value(b IGNORE NULLS) OVER w, 0) AS t FROM texts WINDOW w AS (PARTITION BY user_id ORDER BY n)
), shifted AS (
  SELECT *, coalesce(last_value(CASE WHEN opens AND f = 0 THEN segment * 0.25::DOUBLE END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY n), 0) AS shift FROM filled
)"""
WORDS_SQL = f"""
WITH {TOKENS}, marked AS (
  SELECT *, CASE WHEN row_number() OVER w = 1 OR starts_with(text, ' ') THEN 1 ELSE 0 END AS begins FROM shifted WHERE NOT opens WINDOW w AS (PARTITION BY user_id, segment ORDER BY n)
), worded AS (
  SELECT *, sum(begins) OVER (PARTITION BY user_id, segment ORDER BY n) - 1 AS word FROM marked
)
SELECT user_id, CAST(segment AS INTEGER) AS segment, CAST(word AS INTEGER) AS word, trim(string_agg(text, '' ORDER BY n)) AS text, round(min(f / 1000 + shift) + 1e-9, 6) + 0.0 AS start_time, round(max(t / 1000 + shift) + 1e-9, 6) + 0.0 AS end_time, round(avg(p), 6) AS confidence, CAST(count(*) AS INTEGER) AS tokens
FROM worded GROUP BY user_id, segment, word
"""
ALIGNED_SQL = f"""
WITH {TOKENS}
SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'en' ELSE 'de' END AS language, CAST(segment AS INTEGER) AS segment, CAST(token AS INTEGER) AS token, CAST(event_id AS INTEGER) AS id, text,
  round(greatest((n * 11 - 5) / 100, 0) + shift + 1e-9, 6) + 0.0 AS start_time, round(coalesce((lead(n) OVER (PARTITION BY user_id, segment ORDER BY n) * 11 - 5) / 100, 60) + shift + 1e-9, 6) + 0.0 AS end_time FROM shifted
"""


def shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's components in an order drawn by a generator that its id seeds."""
    found = rows(spark, sf_dir).select("vec_id", randoms.shuffled(F.sequence(F.lit(0), F.size("v") - 1), F.col("vec_id")).alias("places"), "v")
    first = F.transform(F.slice("places", 1, 3), lambda p: F.get("v", p))
    return found.select("vec_id", F.array_join(F.col("places").cast("array<string>"), ",").alias("places"), F.round(F.aggregate(first, F.lit(0.0), lambda a, x: a + x), 6).alias("first_three"))


U = "(s / 4294967296.0::DOUBLE)"
SHUFFLE_SQL = f"""
WITH RECURSIVE drawn AS (
  SELECT vec_id, v, 0 AS i, range(0, len(v)) AS p, (3077908504 + vec_id) & 4294967295 AS s FROM {SINGLE_FROM}
  UNION ALL
  SELECT vec_id, v, i + 1, list_transform(p, lambda x, k: CASE WHEN k = i + 1 THEN p[j + 1] WHEN k = j + 1 THEN p[i + 1] ELSE x END), s
  FROM (SELECT vec_id, v, i, p, s, CAST(floor(i + {U} * (len(v) - i)) AS BIGINT) AS j FROM (SELECT vec_id, v, i, p, {NEXT.format('s')} AS s FROM drawn WHERE i < len(v)))
)
SELECT vec_id, array_to_string(p, ',') AS places, round(v[p[1] + 1] + v[p[2] + 1] + v[p[3] + 1], 6) AS first_three FROM drawn WHERE i = len(v)
"""


def normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many normal numbers as a vector's label and five, seeded by its id, with the mean and deviation of its first two components."""
    found = rows(spark, sf_dir).select("vec_id", randoms.normals(F.col("vec_id"), F.col("label") + 5, F.get("v", F.lit(0)), F.abs(F.get("v", F.lit(1)))).alias("x"))
    return found.select("vec_id", F.size("x").alias("n"), F.transform("x", lambda x: F.round(x + 1e-9, 6) + 0.0).alias("x"))


A, B_ = "(s1 / 4294967296.0::DOUBLE * 2 - 1)", "(s2 / 4294967296.0::DOUBLE * 2 - 1)"
SQUARE = f"({A} * {A} + {B_} * {B_})"
NORMAL_SQL = f"""
WITH RECURSIVE drawn AS (
  SELECT vec_id, embedding[1]::DOUBLE AS mean, abs(embedding[2]::DOUBLE) AS deviation, label + 5 AS n, []::DOUBLE[] AS x, (3077908504 + vec_id) & 4294967295 AS s FROM embeddings
  UNION ALL
  SELECT vec_id, mean, deviation, n, CASE WHEN {SQUARE} > 0 AND {SQUARE} < 1 THEN list_concat(x, [{A} * sqrt(-2 * ln({SQUARE}) / {SQUARE}), {B_} * sqrt(-2 * ln({SQUARE}) / {SQUARE})]) ELSE x END, s2
  FROM (SELECT *, {NEXT.format('s1')} AS s2 FROM (SELECT vec_id, mean, deviation, n, x, {NEXT.format('s')} AS s1 FROM drawn WHERE len(x) < n))
)
SELECT vec_id, CAST(n AS INTEGER) AS n, list_transform(x[1:n], lambda y: round(mean + deviation * y + 1e-9, 6) + 0.0) AS x FROM drawn WHERE len(x) >= n
"""

QUERIES = {"ev_result_json": (result_words, WORDS_SQL), "ev_result_aligned": (result_aligned, ALIGNED_SQL), "rnd_shuffle": (shuffle, SHUFFLE_SQL), "rnd_normal": (normal, NORMAL_SQL)}


def queries() -> dict:
    return {n: q for n, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in QUERIES.items()}
