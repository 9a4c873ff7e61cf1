"""Queries of voice activity and of the meters and filters that it is made of; each user's events stand for the samples of a signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvana.operators import gate, parts
from corvana.plans.timelines import events, fold_sql

RATE = 550.0  # no whole number of samples to a hundredth of a second
OPTIONS = gate.GateOptions(low=40.0, high=160.0, up=400.0, down=250.0, decay=20.0, backward=0.025, threshold=-2.5)
ORDER = ["ts", "event_id"]


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels: the values, and a sawtooth of the event's number."""
    return events(spark, sf_dir).select("user_id", "ts", "event_id", (F.col("value") / 500 - 0.2).alias("left"), ((F.col("event_id") % 97) / 97 - 0.5).alias("right"))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gate.gate_levels(signal(spark, sf_dir), "user_id", ORDER, ["left", "right"], RATE, OPTIONS)
    return found.select("event_id", F.col("sample").cast("long").alias("sample"), *[(F.round(F.col(c) + 1e-9, 5) + 0.0).alias(c) for c in ("loudness", "minimum", "maximum")])


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gate.voice_activity(signal(spark, sf_dir), "user_id", ORDER, ["left", "right"], RATE, OPTIONS)
    return found.select("user_id", F.col("segment").cast("long").alias("segment"), "active", *[(F.round(F.col(c) + 1e-9, 6) + 0.0).alias(c) for c in ("start_time", "end_time")])


def folded(values: str, first: str, step: str, keep: int) -> str:
    """A fold over a list in SQL: the accumulator's first values are the state, the rest the outputs."""
    return f"list_reduce(list_prepend({first}, list_transform({values}, lambda x: [x])), lambda a, x: {step})[{keep + 1}:]"


def section(values: str, kind: str, frequency: float) -> str:
    """A high or low pass by the equaliser cookbook's formulas: w = 2 pi frequency / rate, alpha = sin(w) / (2 * 10^(q / 20))."""
    w = f"(2 * pi() * {frequency} / {RATE})"
    alpha, s = f"(sin{w} / (2 * pow(10, 0.7071 / 20)))", "-" if kind == "lowpass" else "+"
    edge, mid = f"((1 {s} cos{w}) / 2)", "" if kind == "lowpass" else "-"
    y = f"(({edge} * x[1] + {mid}2 * {edge} * a[3] + {edge} * a[4] + 2 * cos{w} * a[1] - (1 - {alpha}) * a[2]) / (1 + {alpha}))"
    return folded(values, "[0::DOUBLE, 0, 0, 0]", f"list_append(list_concat([{y}, a[1], x[1], a[3]], a[5:]), {y})", 4)


def level(values: str) -> str:
    y = f"greatest(1e-6, a[1] + (x[1] * x[1] - a[1]) * CASE WHEN x[1] * x[1] >= a[1] THEN {OPTIONS.up / RATE / 2}::DOUBLE ELSE {OPTIONS.down / RATE / 2}::DOUBLE END)"
    return folded(values, "[1e-6::DOUBLE]", f"list_append(list_prepend({y}, a[2:]), {y})", 1)


DECAY = f"{OPTIONS.decay / RATE / 2}::DOUBLE"
LEVELS = f"""
signals AS (
  SELECT user_id, list(event_id ORDER BY ts, event_id) AS ids, list(value / 500 - 0.2 ORDER BY ts, event_id) AS l, list((event_id % 97) / 97::DOUBLE - 0.5 ORDER BY ts, event_id) AS r
  FROM events WHERE value IS NOT NULL GROUP BY user_id
), high AS (
  SELECT user_id, ids, {section("l", "highpass", OPTIONS.low)} AS l, {section("r", "highpass", OPTIONS.low)} AS r FROM signals
), band AS (
  SELECT user_id, ids, {section("l", "lowpass", OPTIONS.high)} AS l, {section("r", "lowpass", OPTIONS.high)} AS r FROM high
), smooth AS (
  SELECT user_id, ids, {level("l")} AS l, {level("r")} AS r FROM band
), ticks AS (
  SELECT user_id, ids, flatten(list_transform(range(1, len(l) + 1), lambda i: [10 * log10((l[i] + CASE WHEN i > 1 THEN r[i - 1] ELSE 1e-6::DOUBLE END) / 2), 10 * log10((l[i] + r[i]) / 2)])) AS t FROM smooth
), numbered AS (
  SELECT user_id, ids, t, unnest(range(0, len(ids))) AS sample FROM ticks
), levels AS (
  SELECT user_id, ids[sample + 1] AS event_id, sample, t[2 * sample + 2] AS loudness,
    least({gate.QUIET} + {DECAY} * (2 * sample + 2), list_min(list_transform(t[1:2 * sample + 2], lambda x, j: x - {DECAY} * j)) + {DECAY} * (2 * sample + 2)) AS minimum,
    greatest({gate.QUIET} - {DECAY} * (2 * sample + 2), list_max(list_transform(t[1:2 * sample + 2], lambda x, j: x + {DECAY} * j)) - {DECAY} * (2 * sample + 2)) AS maximum
  FROM numbered
)"""
LEVELS_SQL = f"WITH {LEVELS} SELECT event_id, sample, {', '.join(f'round({c} + 1e-9, 5) + 0.0 AS {c}' for c in ('loudness', 'minimum', 'maximum'))} FROM levels"
STEP, BACK = 6, 2  # samples to a frame, frames that activity reaches back
SEGMENTS_SQL = f"""
WITH {LEVELS}, frames AS (
  SELECT user_id, sample, max(loudness >= greatest(maximum, {gate.LOUD}) + {OPTIONS.threshold}) OVER (PARTITION BY user_id ORDER BY sample ROWS BETWEEN CURRENT ROW AND {BACK} FOLLOWING) AS active,
    count(*) OVER (PARTITION BY user_id) AS frames
  FROM levels WHERE sample % {STEP} = 0
), marked AS (
  SELECT *, CASE WHEN lag(active) OVER w <> active THEN 1 ELSE 0 END AS changed FROM frames WINDOW w AS (PARTITION BY user_id ORDER BY sample)
), counted AS (
  SELECT *, CAST(sum(changed) OVER (PARTITION BY user_id ORDER BY sample) AS BIGINT) AS segment FROM marked
)
SELECT c.user_id, segment, active, round(min(sample) / {RATE} + 1e-9, 6) + 0.0 AS start_time, round(least(max(sample) / {RATE} + {gate.FRAME}, any_value(n) / {RATE}) + 1e-9, 6) + 0.0 AS end_time
FROM counted c JOIN (SELECT user_id, count(value) AS n FROM events GROUP BY user_id) t ON t.user_id = c.user_id GROUP BY c.user_id, segment, active
"""


def filtered(machine: parts.Machine):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = parts.machined(events(spark, sf_dir).select("user_id", "event_id", "ts", "value"), "user_id", ORDER, "value", machine)
        return found.select("event_id", (F.round(F.col("y") + 1e-9, 4) + 0.0).alias("value"))

    return query


def given_section(c: dict[str, float]) -> str:
    return f"({c['b0']}::DOUBLE * {{x}} + {c['b1']}::DOUBLE * {{x1}} + {c['b2']}::DOUBLE * {{x2}} - ({c['a1']}::DOUBLE) * {{y1}} - ({c['a2']}::DOUBLE) * {{y2}})"


SHELF = given_section(gate.STANDARD_SHELF).format(x="x[1]", x1="a[3]", x2="a[4]", y1="a[1]", y2="a[2]")
PASS = given_section(gate.STANDARD_PASS).format(x=SHELF, x1="a[1]", x2="a[2]", y1="a[5]", y2="a[6]")
WEIGHTED_SQL = fold_sql("[0::DOUBLE, 0, 0, 0, 0, 0]", f"list_append(list_concat([{SHELF}, a[1], x[1], a[3], {PASS}, a[5]], a[7:]), {PASS})", 6)
REFERENCE, CURVATURE = 40.0, 0.5
DAMPED = f"a[1] + (x[1] - a[1]) * CASE WHEN x[1] >= a[1] THEN 0.6 ELSE 0.2 END * abs(x[1] - a[1]) * {CURVATURE} / (abs(x[1] - a[1]) * {CURVATURE} + {REFERENCE})"
DAMPED_SQL = fold_sql("[0::DOUBLE]", f"list_append(list_prepend({DAMPED}, a[2:]), {DAMPED})", 1)

QUERIES = {
    "vad_levels": (levels, LEVELS_SQL),
    "vad_gate": (segments, SEGMENTS_SQL),
    "sig_k_weighted": (filtered(parts.Cascade(*gate.k_weighting(44100.0, standard=True))), WEIGHTED_SQL),
    "sig_damped": (filtered(parts.Smoother(0.6, 0.2, damping=(REFERENCE, CURVATURE))), DAMPED_SQL),
}


def queries() -> dict:
    return {n: q for n, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in QUERIES.items()}
