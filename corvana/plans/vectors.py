"""Queries of the vector functions over embeddings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvana.functions import vectors as v
from corvana.operators import vector_sets
from corvana.session import table

ROUND = 6


def rounded(c: Column) -> Column:
    return F.round(c, ROUND) + 0.0


def rounded_array(c: Column) -> Column:
    """As text, so that both engines show the same."""
    return F.array_join(F.transform(c, lambda x: F.format_string("%.5f", F.round(x, 5) + 0.0)), ",")


SQL_SUM = "list_sum({})"
SQL_MEAN = "list_avg(v)"
SQL_VAR = f"list_sum(list_transform(v, lambda x: (x - {SQL_MEAN}) * (x - {SQL_MEAN}))) / {{}}"
SQL_JOIN = "array_to_string(list_transform({}, lambda x: printf('%.5f', round(x, 5) + 0.0)), ',')"

#: name: (kind, Spark, SQL over v, an array of doubles); kind: n for numbers, i for whole numbers, a for arrays.
SINGLE = {
    "vec_sum": ("n", lambda u: v.total(u), "list_sum(v)"),
    "vec_sumsq": ("n", lambda u: v.sum_of_squares(u), "list_sum(list_transform(v, lambda x: x * x))"),
    "vec_mean_in": ("n", lambda u: v.mean(u), "list_avg(v)"),
    "vec_median_upper": ("n", lambda u: v.upper_median(u), "list_sort(v)[len(v) // 2 + 1]"),
    "vec_var_pop": ("n", lambda u: v.variance(u), SQL_VAR.format("len(v)")),
    "vec_var_sample": ("n", lambda u: v.variance(u, True), SQL_VAR.format("(len(v) - 1)")),
    "vec_std_in": ("n", lambda u: v.deviation(u), f"sqrt({SQL_VAR.format('len(v)')})"),
    "vec_max": ("n", lambda u: v.largest(u), "list_max(v)"),
    "vec_min": ("n", lambda u: v.smallest(u), "list_min(v)"),
    "vec_argmax": ("i", lambda u: v.index_of_max(u), "list_position(v, list_max(v)) - 1"),
    "vec_argmin": ("i", lambda u: v.index_of_min(u), "list_position(v, list_min(v)) - 1"),
    "vec_norm": ("n", lambda u: v.magnitude(u), "sqrt(list_sum(list_transform(v, lambda x: x * x)))"),
    "vec_logsumexp": ("n", lambda u: v.log_sum_exp(u), "ln(list_sum(list_transform(v, lambda x: exp(x))) + 1e-40)"),
    "vec_sumexp": ("n", lambda u: v.sum_exp(u), "list_sum(list_transform(v, lambda x: exp(x)))"),
    "vec_sigmoid": ("a", lambda u: F.transform(u, v.sigmoid), "list_transform(v, lambda x: 1 / (1 + exp(-x)))"),
    "vec_round_half_up": ("a", lambda u: F.transform(u, lambda x: v.round_half_up(x, 2)), "list_transform(v, lambda x: floor(x * 100 + 0.5) / 100)"),
    "vec_clip": ("a", lambda u: F.transform(u, lambda x: v.clip(x, -0.1, 0.1)), "list_transform(v, lambda x: greatest(-0.1, least(0.1, x)))"),
    "vec_center": ("a", lambda u: v.center(u), "list_transform(v, lambda x: x - list_avg(v))"),
    "vec_sum_to_1": ("a", lambda u: v.scale_to_sum_1(u), "list_transform(v, lambda x: (x + CASE WHEN list_min(v) < 0 THEN -2 * list_min(v) ELSE 0 END) / (list_sum(v) + len(v) * CASE WHEN list_min(v) < 0 THEN -2 * list_min(v) ELSE 0 END))"),
    "vec_zscore": ("a", lambda u: v.z_scores(u), f"list_transform(v, lambda y: (y - list_avg(v)) / sqrt({SQL_VAR.format('len(v)')}))"),
    "vec_log": ("a", lambda u: v.log_of(F.transform(u, F.abs)), "list_transform(v, lambda x: ln(abs(x) + 1e-40))"),
    "vec_exp": ("a", lambda u: v.exp_of(u), "list_transform(v, lambda x: exp(x))"),
    "vec_softmax": ("a", lambda u: v.softmax(u), "list_transform(v, lambda y: exp(y - list_max(v)) / (list_sum(list_transform(v, lambda x: exp(x - list_max(v)))) + 1e-20))"),
    "vec_logsoftmax": ("a", lambda u: v.log_softmax(u), "list_transform(v, lambda y: ln(exp(y - list_max(v)) / (list_sum(list_transform(v, lambda x: exp(x - list_max(v)))) + 1e-20) + 1e-40))"),
    "vec_ma3": ("a", lambda u: v.moving_average_3(u), "list_transform(v, lambda x, i: (v[greatest(i - 1, 1)] + x + v[least(i + 1, len(v))]) / 3)"),
    "vec_med3": ("a", lambda u: v.median_filter(u, 3), "list_transform(v, lambda x, i: CASE WHEN i > 1 AND i < len(v) THEN list_sort(v[i - 1:i + 1])[2] ELSE x END)"),
    "vec_med5": ("a", lambda u: v.median_filter(u, 5), "list_transform(v, lambda x, i: CASE WHEN i > 2 AND i < len(v) - 1 THEN list_sort(v[i - 2:i + 2])[3] ELSE x END)"),
    "vec_topk": ("t", lambda u: v.top_k_indexes(u, 5), "list_transform(list_sort(list_transform(v, lambda x, i: {'x': -x, 'i': i - 1}))[1:5], lambda s: s.i)"),
    "vec_deltas": ("a", lambda u: v.deltas(F.transform(u, lambda x: x * 40)), "list_transform(list_reduce(list_prepend([0::DOuBLE], list_transform(v, lambda x: [x * 40])), lambda a, x: list_append(list_prepend(a[1] + floor(x[1] - a[1]), a[2:]), floor(x[1] - a[1])))[2:], lambda x: x)"),
    "vec_slice_parts": ("a", lambda u: F.transform(v.split_parts(u, 10), v.total), "list_transform(range(0, CAST(ceil(len(v) / 10) AS BIGINT)), lambda i: list_sum(v[i * 10 + 1:i * 10 + 10]))"),
    "vec_transpose": ("a", lambda u: F.flatten(v.transpose(F.array(u, F.reverse(u)))), "flatten(list_transform(range(1, len(v) + 1), lambda i: [v[i], v[len(v) + 1 - i]]))"),
    "vec_last_index": ("i", lambda u: v.last_index_in_range(u, F.get(u, F.lit(9)), 0, 20), "list_max(list_filter(range(0, 20), lambda i: v[i + 1] = v[10]))"),
    "vec_emphasis": ("a", lambda u: F.transform(u, lambda x, i: F.when(i == 0, x).otherwise(x - 0.97 * F.get(u, i - 1))), "list_transform(v, lambda x, i: CASE WHEN i = 1 THEN x ELSE x - 0.97 * v[i - 1] END)"),
    "vec_denormalize": ("a", lambda u: v.denormalize(u, F.transform(u, lambda x: F.lit(2.0)), F.transform(u, lambda x: F.lit(3.0))), "list_transform(v, lambda x: x * 3.0 + 2.0)"),
}
ZIP = "list_sum(list_transform(range(1, len(v) + 1), lambda i: {}))"
NORM = "sqrt(list_sum(list_transform({0}, lambda x: x * x)))"
COS = f"greatest(-1.0, least(1.0, {ZIP.format('v[i] * w[i]')} / ({NORM.format('v')} * {NORM.format('w')} + 1e-40)))"
PAIRS = {
    "vec_dot": ("n", lambda u, w: v.dot(u, w), ZIP.format("v[i] * w[i]")),
    "vec_l2": ("n", lambda u, w: v.euclidean(u, w), f"sqrt({ZIP.format('(v[i] - w[i]) ** 2')})"),
    "vec_l2_squared": ("n", lambda u, w: v.squared_euclidean(u, w), ZIP.format("(v[i] - w[i]) ** 2")),
    "vec_l2_13": ("n", lambda u, w: v.euclidean_first(u, w), "sqrt(list_sum(list_transform(range(1, 14), lambda i: (v[i] - w[i]) ** 2)))"),
    "vec_cos": ("n", lambda u, w: v.cosine_similarity(u, w), COS),
    "vec_cos_distance": ("n", lambda u, w: v.cosine_distance(u, w), f"1 - {COS}"),
    "vec_minkowski": ("n", lambda u, w: v.minkowski(u, w, 3.0), f"pow({ZIP.format('pow(abs(v[i] - w[i]), 3.0)')}, 1.0 / 3)"),
    "vec_mse": ("n", lambda u, w: v.mean_squared_error(u, w), f"{ZIP.format('(v[i] - w[i]) ** 2')} / len(v)"),
    "vec_subtract": ("a", lambda u, w: v.subtract(u, w), "list_transform(range(1, len(v) + 1), lambda i: v[i] - w[i])"),
}
OUT = {
    "n": (rounded, f"round({{}}, {ROUND}) + 0.0"), "i": (lambda c: c.cast("int"), "CAST({} AS INTEGER)"), "a": (rounded_array, SQL_JOIN),
    "t": (lambda c: F.array_join(c.cast("array<string>"), ","), "array_to_string({}, ',')"),
}


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", v.doubles(F.col("embedding")).alias("v"))


def single(kind: str, expr):
    return lambda spark, sf_dir: rows(spark, sf_dir).select("vec_id", OUT[kind][0](expr(F.col("v"))).alias("value"))


def paired(kind: str, expr):
    """Each vector with that of the next id: one equi-join."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        left = rows(spark, sf_dir).select("vec_id", "v")
        right = rows(spark, sf_dir).select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
        return left.join(right, "vec_id").select("vec_id", OUT[kind][0](expr(F.col("v"), F.col("w"))).alias("value"))

    return query


SINGLE_FROM = "(SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"
PAIR_FROM = "(SELECT a.vec_id, a.embedding::DOUBLE[] AS v, b.embedding::DOUBLE[] AS w FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
LONG = "(SELECT vec_id, label, i - 1 AS pos, embedding[i]::DOUBLE AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(i))"


def by_label(f):
    return lambda spark, sf_dir: f(rows(spark, sf_dir)).select("label", "pos", rounded(F.col("value")).alias("value"))


def weighted(df: DataFrame) -> DataFrame:
    return vector_sets.weighted_mean(df.withColumn("weight", 1 / (1 + F.col("vec_id"))), "label", "v", "weight")


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_sets.normalize(rows(spark, sf_dir), "label", "vec_id", "v")
    return found.select("vec_id", "pos", rounded(F.col("value")).alias("value"))


def centered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_sets.center(rows(spark, sf_dir), "label", "vec_id", "v")
    return found.select("vec_id", "pos", rounded(F.col("value")).alias("value"))


def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_sets.covariance(rows(spark, sf_dir), "label", "v")
    return found.select("label", "i", "j", rounded(F.col("value")).alias("value"))


def squared_error_of_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = rows(spark, sf_dir)
    right = rows(spark, sf_dir).select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return left.join(right, "vec_id").groupBy("label").agg(rounded(F.avg(v.mean_squared_error(F.col("v"), F.col("w")))).alias("value"))


def running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_sets.running_mean(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", rounded(F.col("mean") + 1e-9).alias("value"))


def hamming_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", v.hamming(F.col("event_id"), F.col("user_id") * 7919).cast("int").alias("value"))


SETS = {
    "vec_mean": (by_label(lambda df: vector_sets.mean(df, "label", "v")), f"SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(x), {ROUND}) + 0.0 AS value FROM {LONG} GROUP BY label, pos"),
    "vec_var": (by_label(lambda df: vector_sets.variance(df, "label", "v")), f"SELECT label, CAST(pos AS INTEGER) AS pos, round(var_pop(x), {ROUND}) + 0.0 AS value FROM {LONG} GROUP BY label, pos"),
    "vec_var_sample_sets": (by_label(lambda df: vector_sets.variance(df, "label", "v", sample=True)), f"SELECT label, CAST(pos AS INTEGER) AS pos, round(coalesce(var_samp(x), 0), {ROUND}) + 0.0 AS value FROM {LONG} GROUP BY label, pos"),
    "vec_std": (by_label(lambda df: vector_sets.deviation(df, "label", "v")), f"SELECT label, CAST(pos AS INTEGER) AS pos, round(stddev_pop(x), {ROUND}) + 0.0 AS value FROM {LONG} GROUP BY label, pos"),
    "vec_weighted_mean": (by_label(weighted), f"SELECT label, CAST(pos AS INTEGER) AS pos, round(sum(x / (1 + vec_id)), {ROUND}) + 0.0 AS value FROM {LONG} GROUP BY label, pos"),
    "vec_normalize_sets": (normalized, f"SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(CASE WHEN stddev_pop(x) OVER w = 0 THEN 0 ELSE (x - avg(x) OVER w) / stddev_pop(x) OVER w END, {ROUND}) + 0.0 AS value FROM {LONG} WINDOW w AS (PARTITION BY label, pos)"),
    "vec_center_sets": (centered, f"SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(x - avg(x) OVER (PARTITION BY label, pos), {ROUND}) + 0.0 AS value FROM {LONG}"),
    "vec_cov": (covariance, f"SELECT a.label, CAST(a.pos AS INTEGER) AS i, CAST(b.pos AS INTEGER) AS j, round(coalesce(covar_samp(a.x, b.x), 0) + CASE WHEN a.pos = b.pos AND count(*) > 1 THEN 1e-6 ELSE 0 END, {ROUND}) + 0.0 AS value FROM {LONG} a JOIN {LONG} b ON a.vec_id = b.vec_id AND a.pos <= b.pos GROUP BY a.label, a.pos, b.pos"),
    "vec_mse_sets": (squared_error_of_sets, f"SELECT label, round(avg({ZIP.format('(v[i] - w[i]) ** 2')} / len(v)), {ROUND}) + 0.0 AS value FROM (SELECT a.label, a.embedding::DOUBLE[] AS v, b.embedding::DOUBLE[] AS w FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) GROUP BY label"),
    "vec_running_mean": (running_mean, f"SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 1e-9, {ROUND}) + 0.0 AS value FROM events"),
    "vec_hamming": (hamming_ids, "SELECT event_id, CAST(bit_count((xor(event_id, user_id * 7919)) & 4294967295) AS INTEGER) AS value FROM events"),
}


def queries() -> dict:
    found = {n: single(kind, expr) for n, (kind, expr, _) in SINGLE.items()}
    found |= {n: paired(kind, expr) for n, (kind, expr, _) in PAIRS.items()}
    return found | {n: q for n, (q, _) in SETS.items()}


def oracle_sql() -> dict[str, str]:
    found = {n: f"SELECT vec_id, {OUT[kind][1].format(sql)} AS value FROM {SINGLE_FROM}" for n, (kind, _, sql) in SINGLE.items()}
    found |= {n: f"SELECT vec_id, {OUT[kind][1].format(sql)} AS value FROM {PAIR_FROM}" for n, (kind, _, sql) in PAIRS.items()}
    return found | {n: sql for n, (_, sql) in SETS.items()}
