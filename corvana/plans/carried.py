"""Queries of alignments in use: paths over attention weights, words within segments, timelines carried to another text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvana.functions.texts import words as split_words
from corvana.operators import warping
from corvana.plans.samples import neighbours
from corvana.plans.vectors import PAIR_FROM, SINGLE_FROM, rows
from corvana.session import table

HEADS, TOKENS, FRAMES = 2, 4, 8  # 64 components as attention scores


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = lambda h, t: F.slice(F.transform("v", lambda x: x * 8), (h * TOKENS + t) * FRAMES + 1, FRAMES)
    heads = F.array(*[F.array(*[token(h, t) for t in range(TOKENS)]) for h in range(HEADS)])
    found = rows(spark, sf_dir).select("vec_id", warping.attention_path(heads).alias("r"))
    return found.select("vec_id", (F.round(F.col("r.cost") + 1e-7, 3) + 0.0).alias("cost"), F.size("r.path").alias("steps"))


SOFT = f"list_transform(range(0, {HEADS * TOKENS}), lambda r: list_transform(v[r * {FRAMES} + 1:r * {FRAMES} + {FRAMES}], lambda x: exp(x * 8)))"
MEDIAN = "CASE WHEN f <= 2 OR f > {n} - 2 THEN y[r][f] ELSE list_sort(y[r][f - 2:f + 2])[3] END".format(n=FRAMES)
#: The best way back from a cell: a frame before, then a token before, then both; ties to the first of these.
WEIGHTS_SQL = f"""
WITH RECURSIVE soft AS (
  SELECT vec_id, list_transform(s, lambda x: list_transform(x, lambda e: e / list_sum(x))) AS s FROM (SELECT vec_id, {SOFT} AS s FROM {SINGLE_FROM})
), scaled AS (
  SELECT vec_id, list_transform(s, lambda x, r: list_transform(x, lambda e: (e - 1 / {FRAMES}::DOUBLE) / (sqrt(list_sum(list_transform(flatten(s[(r - 1) // {TOKENS} * {TOKENS} + 1:(r - 1) // {TOKENS} * {TOKENS} + {TOKENS}]), lambda q: q * q)) / {TOKENS * FRAMES}) + 1e-10))) AS y FROM soft
), smooth AS (
  SELECT vec_id, list_transform(range(1, {HEADS * TOKENS} + 1), lambda r: list_transform(range(1, {FRAMES} + 1), lambda f: {MEDIAN})) AS z FROM scaled
), means AS (
  SELECT vec_id, list_transform(range(1, {TOKENS} + 1), lambda t: list_transform(range(1, {FRAMES} + 1), lambda f: -(z[t][f] + z[t + {TOKENS}][f]) / 2)) AS c FROM smooth
), first AS (
  SELECT vec_id, c, list_reduce(list_prepend([0::FLOAT], list_transform(range(2, {FRAMES} + 1), lambda f: [c[1][f]::FLOAT])), lambda a, x: list_append(a, a[-1] + x[1])) AS row FROM means
), filled AS (
  SELECT vec_id, 1 AS t, c, row, [row] AS m FROM first
  UNION ALL
  SELECT vec_id, t + 1, c, next, list_append(m, next) FROM (
    SELECT vec_id, t, c, m, list_reduce(list_prepend([c[t + 1][1]::FLOAT + row[1]], list_transform(range(2, {FRAMES} + 1), lambda f: [f::FLOAT])), lambda a, x: list_append(a, c[t + 1][CAST(x[1] AS INTEGER)]::FLOAT + least(a[-1], row[CAST(x[1] AS INTEGER)], row[CAST(x[1] AS INTEGER) - 1]))) AS next
    FROM filled WHERE t < {TOKENS})
), back AS (
  SELECT vec_id, m, {TOKENS} AS i, {FRAMES} AS j, 1 AS steps FROM filled WHERE t = {TOKENS}
  UNION ALL
  SELECT vec_id, m, i - CASE WHEN by_frame THEN 0 ELSE 1 END, j - CASE WHEN by_frame OR by_both THEN 1 ELSE 0 END, steps + 1 FROM (
    SELECT *, i = 1 OR (j > 1 AND m[i][j - 1] <= m[i - 1][j] AND m[i][j - 1] <= m[i - 1][j - 1]) AS by_frame, i > 1 AND j > 1 AND m[i - 1][j - 1] < m[i][j - 1] AND m[i - 1][j - 1] < m[i - 1][j] AS by_both
    FROM back WHERE i > 1 OR j > 1)
)
SELECT vec_id, round(m[{TOKENS}][{FRAMES}]::DOUBLE + 1e-7, 3) + 0.0 AS cost, CAST(steps AS INTEGER) AS steps FROM back WHERE i = 1 AND j = 1
"""

RATE = 64.0
SEGMENTS = ((0, 0.0, 0.3), (1, 0.25, 0.7), (2, 0.7, 1.0))
SPOKEN = (("one", 0.0, 0.1), ("two", 0.1, 0.24))
LENGTH = 16  # samples of a reference


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each segment of a vector's signal, by references that are parts of the next vector."""
    pairs = neighbours(spark, sf_dir)
    entry = lambda x: F.struct(F.lit(x[0]).alias("text"), F.lit(x[1]).alias("start_time"), F.lit(x[2]).alias("end_time"))
    every = F.explode(F.array(*[F.struct(F.lit(n).alias("segment"), F.lit(a).alias("start_time"), F.lit(b).alias("end_time"), F.slice("b", n * LENGTH + 1, LENGTH).alias("reference")) for n, a, b in SEGMENTS]))
    asked = pairs.select("vec_id", every.alias("s"), F.array(*map(entry, SPOKEN)).alias("words")).select("vec_id", "s.*", "words")
    found = warping.align_segments(pairs.select("vec_id", F.col("a").alias("samples")), asked, "vec_id", RATE, kind=None)
    return found.select("vec_id", "segment", "text", *[(F.round(F.col(c) + 1e-9, 6) + 0.0).alias(c) for c in ("start_time", "end_time")])


PARTS = ", ".join(f"({n}, {a}::DOUBLE, {b}::DOUBLE)" for n, a, b in SEGMENTS)
WORDS_SAID = ", ".join(f"('{w}', {a}::DOUBLE, {b}::DOUBLE)" for w, a, b in SPOKEN)
INF = "'inf'::FLOAT"
COST = "abs(a[{i}] - b[{j}])::FLOAT"
SEGMENTS_SQL = f"""
WITH RECURSIVE parts AS (
  SELECT vec_id, segment, s AS shift, w[segment * {LENGTH} + 1:segment * {LENGTH} + {LENGTH}] AS a, v[CAST(floor(s * {RATE}) AS INTEGER) + 1:CAST(floor(e * {RATE}) AS INTEGER)] AS b
  FROM {PAIR_FROM} pairs, (VALUES {PARTS}) AS t(segment, s, e)
), filled AS (
  SELECT vec_id, segment, shift, a, b, 1 AS i, list_prepend(0::FLOAT, list_transform(range(2, len(b) + 1), lambda j: {INF})) AS row, [list_prepend(0::FLOAT, list_transform(range(2, len(b) + 1), lambda j: {INF}))] AS m FROM parts
  UNION ALL
  SELECT vec_id, segment, shift, a, b, i + 1, next, list_append(m, next) FROM (
    SELECT *, list_reduce(list_prepend([{INF}], list_transform(range(2, len(b) + 1), lambda j: [j::FLOAT])), lambda r, x: list_append(r, {COST.format(i='i + 1', j='CAST(x[1] AS INTEGER)')} + least(r[-1], row[CAST(x[1] AS INTEGER)], row[CAST(x[1] AS INTEGER) - 1]))) AS next
    FROM filled WHERE i < len(a))
), back AS (
  SELECT vec_id, segment, shift, m, len(a) AS i, len(b) AS j FROM filled WHERE i = len(a)
  UNION ALL
  SELECT vec_id, segment, shift, m, i - CASE WHEN by_b THEN 0 ELSE 1 END, j - CASE WHEN by_b OR by_both THEN 1 ELSE 0 END FROM (
    SELECT *, m[i][j - 1] <= m[i - 1][j] AND m[i][j - 1] <= m[i - 1][j - 1] AS by_b, m[i - 1][j - 1] < m[i][j - 1] AND m[i - 1][j - 1] < m[i - 1][j] AS by_both FROM back WHERE i > 1 AND j > 1)
)
SELECT p.vec_id, p.segment, word AS text,
  round(any_value(shift) + min(j - 1) FILTER (WHERE i - 1 = CAST(floor(s * {RATE}) AS INTEGER)) / {RATE} + 1e-9, 6) + 0.0 AS start_time,
  round(any_value(shift) + max(j - 1) FILTER (WHERE i - 1 = least({LENGTH} - 1, CAST(floor(e * {RATE}) AS INTEGER))) / {RATE} + 1e-9, 6) + 0.0 AS end_time
FROM back p, (VALUES {WORDS_SAID}) AS t(word, s, e) GROUP BY p.vec_id, p.segment, word
"""


def carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's words, half a second each, carried over to the next turn's: words mean the same where they are the same in lower case.

    Whole turns meet, twice a text and not its words; only lines that several turns share are told apart word by word.
    """
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("line"), "text")
    side = lambda df, n: df.select("line", *[(F.col("text") if n == m else F.lit(None).cast("string")).alias(c) for m, c in enumerate("ab")])
    both = side(turns, 0).unionByName(side(turns.withColumn("line", F.col("line") - 1), 1)).where("line is not null")
    met = both.groupBy("line").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b")).where("size(a) > 0 and size(b) > 0")
    once = F.size("a") + F.size("b") == 2
    words = met.where(once).select("line", split_words(F.get("a", F.lit(0))).alias("s"), split_words(F.get("b", F.lit(0))).alias("words"))
    lowered = lambda c: F.transform(c, lambda w: F.lower(w))
    times = lambda end: F.transform("s", lambda w, n: n * 0.5 + 0.4 if end else n * 0.5)
    pairs = words.select("line", times(False).alias("start_times"), times(True).alias("end_times"), lowered("s").alias("source_words"), "words", lowered("words").alias("target_words"))
    found = warping.timeline_by_words(pairs, "line").unionByName(shared_lines(met.where(~once)))
    return found.select("line", "target", "text", *[(F.round(F.col(c) + 1e-9, 6) + 0.0).alias(c) for c in ("start_time", "end_time")])


def shared_lines(met: DataFrame) -> DataFrame:
    """carried() of lines that are of several turns (line, a: texts, b: the next line's)."""
    split = lambda c: met.select("line", F.explode(c).alias("text")).select("line", F.posexplode(split_words(F.col("text"))).alias("n", "text"))
    source = split("a").select("line", F.col("n").alias("source"), (F.col("n") * 0.5).alias("start_time"), (F.col("n") * 0.5 + 0.4).alias("end_time"), F.lower("text").alias("w"))
    target = split("b").select("line", F.col("n").alias("target"), "text")
    pairs = source.select("line", "source", "w").join(target.withColumn("w", F.lower("text")), ["line", "w"])
    mapping = pairs.select("line", "source", "target", F.row_number().over(Window.partitionBy("line").orderBy("source", "target")).alias("ord"))
    return warping.timeline_by_mapping(source, mapping, target, "line")


WORD = "[\\p{L}\\p{M}\\p{N}]+(?:[''’][\\p{L}\\p{M}\\p{N}]+)*|[^\\s\\p{L}\\p{M}\\p{N}]"
CARRIED_SQL = f"""
WITH words AS (
  SELECT line, unnest(w) AS w, unnest(range(0, len(w))) AS n FROM (SELECT conv_id * 1000 + turn AS line, regexp_extract_all(text, '{WORD}') AS w FROM conversations)
), mapped AS (
  SELECT s.line, s.n AS source, t.n AS target, t.w AS text, row_number() OVER (PARTITION BY s.line, s.n ORDER BY t.n) - 1 AS i, count(*) OVER (PARTITION BY s.line, s.n) AS n FROM words s JOIN words t ON t.line = s.line + 1 AND lower(t.w) = lower(s.w)
), parts AS (
  SELECT line, source, target, text, source * 0.5::DOUBLE + i * 0.4::DOUBLE / n AS a, source * 0.5::DOUBLE + (i + 1) * 0.4::DOUBLE / n AS b FROM mapped
)
SELECT line, CAST(target AS INTEGER) AS target, text, round(arg_min(a, source) + 1e-9, 6) + 0.0 AS start_time, round(arg_max(b, source) + 1e-9, 6) + 0.0 AS end_time FROM parts GROUP BY line, target, text
"""

QUERIES = {"dtw_weights": (weights, WEIGHTS_SQL), "dtw_segments": (segments, SEGMENTS_SQL), "timeline_to_text": (carried, CARRIED_SQL)}


def queries() -> dict:
    return {n: q for n, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in QUERIES.items()}
