"""Queries of signals, binary numbers, random numbers and alignments, each with its SQL; embeddings stand for samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvana.functions import encodings as e
from corvana.functions import randoms, signals
from corvana.functions import times as s
from corvana.functions import vectors as v
from corvana.operators import alignment, stateful, vector_sets
from corvana.plans.vectors import OUT, PAIR_FROM, SINGLE_FROM, paired, rounded, rows, single
from corvana.session import table

BOTH = "list_concat(v, w)"
PEAK = f"greatest(list_max(list_transform({BOTH}, lambda x: abs(x))), 0.00001)"
SCALED = "list_transform({}, lambda x: x * ({}))"
LOUD = 40.0  # makes samples loud enough to clip


def flat(f):
    """A function of two channels as an array of the samples of both."""
    return lambda u, w: F.flatten(f(F.array(u, w)))


def louder(u):
    return F.transform(u, lambda x: x * LOUD)


PAIRS = {
    "sig_peak": ("n", lambda u, w: signals.peak(F.array(u, w)), PEAK),
    "sig_peak_db": ("n", lambda u, w: s.gain_to_decibels(signals.peak(F.array(u, w))), f"20 * log10({PEAK})"),
    "sig_gain": ("a", flat(lambda c: signals.with_gain(c, s.decibels_to_gain(F.lit(-6.0)))), SCALED.format(BOTH, "pow(10, -0.3)")),
    "sig_normalize": ("a", flat(signals.normalized), SCALED.format(BOTH, f"least(pow(10, -0.15) / {PEAK}, pow(10, 1.5))")),
    "sig_attenuate": ("a", flat(lambda c: signals.attenuated(F.transform(c, louder))), SCALED.format(BOTH, f"{LOUD} * least(1.0, pow(10, -0.005) / ({PEAK} * {LOUD}))")),
    "sig_dc_bias": ("a", flat(signals.without_bias), "list_concat(list_transform(v, lambda x: x - list_avg(v)), list_transform(w, lambda x: x - list_avg(w)))"),
    "sig_downmix": ("a", lambda u, w: signals.downmixed(F.array(u, w)), "list_transform(range(1, len(v) + 1), lambda i: (v[i] + w[i]) / 2)"),
    "sig_mix": ("a", lambda u, w: signals.mixed(u, F.slice(w, 1, 50)), "list_transform(range(1, 51), lambda i: v[i] + w[i])"),
    "sig_subtract": ("a", lambda u, w: signals.mixed(u, w, -1.0), "list_transform(range(1, len(v) + 1), lambda i: v[i] - w[i])"),
    "sig_interleave": ("a", lambda u, w: signals.interleaved(F.array(u, w)), "flatten(list_transform(range(1, len(v) + 1), lambda i: [v[i], w[i]]))"),
    "sig_deinterleave": ("a", lambda u, w: signals.channel_of(signals.interleaved(F.array(u, w)), 2, 1), "w"),
    "sig_concat": ("a", lambda u, w: F.get(signals.joined(F.array(u), F.array(w)), F.lit(0)), BOTH),
    "sig_slice_time": ("a", flat(lambda c: signals.sliced_by_time(c, 16.0, F.lit(0.7), F.lit(2.33))), "list_concat(v[12:37], w[12:37])"),
    "vec_cos_precomputed": ("n", lambda u, w: v.cosine_given(u, w, v.magnitude(u), F.lit(2.0)), "greatest(-1.0, least(1.0, list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * w[i])) / (sqrt(list_sum(list_transform(v, lambda x: x * x))) * 2.0 + 1e-40)))"),
}

SILENT = "least(coalesce(list_min(list_filter(range(0, len({0})), lambda i: abs({0}[i + 1]) > 0.1)), len({0})), len({0}) - 1)"
SINGLE = {
    "sig_fade": ("a", lambda u: signals.faded(u, 16), "list_transform(v, lambda x, i: x * CASE WHEN i <= 16 THEN pow(10.0, -3.0 * (1 - (i - 1) / 16.0::DOUBLE)) WHEN i > len(v) - 16 THEN pow(10.0, -3.0 * (1 - (len(v) - i) / 16.0::DOUBLE)) ELSE 1 END)"),
    "sig_silence_start": ("i", lambda u: signals.leading_silent(u, F.lit(0.1)), SILENT.format("v")),
    "sig_silence_end": ("i", lambda u: signals.trailing_silent(u, F.lit(0.1)), SILENT.format("list_reverse(v)")),
    "sig_trim_start": ("a", lambda u: signals.trimmed_start(u, 3, -20.0), f"list_concat([0.0, 0.0, 0.0], v[{SILENT.format('v')} + 1:])"),
    "sig_trim_end": ("a", lambda u: signals.trimmed_end(u, 2, -20.0), f"list_concat(v[1:len(v) - {SILENT.format('list_reverse(v)')}], [0.0, 0.0])"),
    "sig_istft": ("a", lambda u: F.transform(signals.restored(u, 16, 16, 4), lambda x: F.round(F.round(x, 12), 3)), "list_transform(v, lambda x: round(x, 3))"),
    "vec_sum_and_sumsq": ("a", lambda u: F.array(v.sum_and_squares(u)["sum"], v.sum_and_squares(u)["squares"]), "[list_sum(v), list_sum(list_transform(v, lambda x: x * x))]"),
    "sig_polar": ("a", lambda u: F.flatten(F.transform(signals.polar(signals.complex_bins(u)), lambda z: F.array(z["magnitude"], z["phase"]))), "flatten(list_transform(range(1, len(v) // 2 + 1), lambda i: [sqrt(pow(v[2 * i - 1], 2) + pow(v[2 * i], 2)), atan2(v[2 * i], v[2 * i - 1])]))"),
    "sig_cartesian": ("a", lambda u: signals.bin_buffer(signals.cartesian(signals.polar(signals.complex_bins(u)))), "v"),
    "sig_mirrored": ("a", lambda u: signals.bin_buffer(signals.complex_bins(u, mirrored=True)), "list_concat(v, flatten(list_transform(range(1, len(v) // 2 - 1), lambda k: [v[len(v) - 1 - 2 * k], -v[len(v) - 2 * k]])))"),
    "sig_bin_frequencies": ("a", lambda u: signals.bin_frequencies(F.size(u), F.abs(F.get(u, F.lit(0))) * 1000), "list_transform(range(0, len(v)), lambda i: i * abs(v[1]) * 1000 / (len(v) - 1))"),
    "vec_pick": ("i", lambda u: stateful.first_exceeding(F.transform(u, F.abs), F.lit(0.37)), "list_min(list_filter(range(0, len(v)), lambda i: list_sum(list_transform(v[1:i + 1], lambda x: abs(x))) > 0.37 * list_sum(list_transform(v, lambda x: abs(x)))))"),
    "vec_constant": ("a", lambda u: F.concat(u, v.constant(3, 0.5), F.transform(F.array(F.lit(float("nan")), F.lit(2.0)), v.zero_if_nan)), "list_concat(v, [0.5, 0.5, 0.5, 0.0, 2.0])"),
    "vec_int_range": ("t", lambda u: F.concat(v.whole_numbers(F.lit(3), F.size(u)), v.whole_numbers(F.lit(5), F.lit(5))), "range(3, len(v))"),
}

PCM_SQL = "array_to_string(list_transform(v, lambda x: CAST(greatest(-{0}::DOUBLE, least({0}::DOUBLE - 1, round_even(x * {0}::DOUBLE, 0))) AS BIGINT) + {1}), ',')"
BACK_SQL = "array_to_string(list_transform(v, lambda x: printf('%.15f', greatest(-32768.0::DOUBLE, least(32767.0::DOUBLE, round_even(x * 32768.0::DOUBLE, 0))) / 32768.0::DOUBLE + 0.0)), ',')"


def pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = lambda c: F.array_join(c.cast("array<string>"), ",")
    back = F.transform(e.from_pcm_numbers(e.pcm_numbers(F.col("v"), 16), 16), lambda x: F.format_string("%.15f", x + 0.0))
    digest = F.lower(F.hex(e.pcm_bytes(F.col("v"), 24)))
    return rows(spark, sf_dir).select("vec_id", *[told(e.pcm_numbers(F.col("v"), n)).alias(f"bits_{n}") for n in (8, 16, 24, 32)], F.array_join(back, ",").alias("restored"), digest.alias("bytes_24"))


BYTES_24 = "array_to_string(list_transform(v, lambda x: printf('%02x%02x%02x', {0} & 255, ({0} >> 8) & 255, ({0} >> 16) & 255)), '')".format("((CAST(round_even(x * 8388608::DOUBLE, 0) AS BIGINT) + 16777216) & 16777215)")
PCM_QUERY = f"SELECT vec_id, {PCM_SQL.format(128, 128)} AS bits_8, {PCM_SQL.format(32768, 0)} AS bits_16, {PCM_SQL.format(8388608, 0)} AS bits_24, {PCM_SQL.format(2147483648, 0)} AS bits_32, {BACK_SQL} AS restored, {BYTES_24} AS bytes_24 FROM {SINGLE_FROM}"

# spectra: 16 samples to a frame, 8 to a hop, of signals padded by half a frame
SHORT = {"order": 16, "window": 16, "hop": 8, "bands": 6, "rate": 16000, "low": 300.0, "high": 7000.0, "features": 4}
HANN = "(0.5 - 0.5 * cos(2 * pi() * i / 15))"
FRAME = f"list_transform(range(0, 16), lambda i: p[f * 8 + i + 1] * {HANN})"
POWER_FROM = f"""
frames AS (SELECT vec_id, unnest(range(0, 9)) AS f, list_concat(list_transform(range(0, 8), lambda i: 0.0::DOUBLE), x, list_transform(range(0, 8), lambda i: 0.0::DOUBLE)) AS p FROM source),
weighted AS (SELECT vec_id, f, {FRAME} AS y FROM frames),
powers AS (SELECT vec_id, f, list_transform(range(0, 9), lambda k: pow(list_sum(list_transform(range(0, 16), lambda n: y[n + 1] * cos(2 * pi() * k * n / 16))), 2) + pow(list_sum(list_transform(range(0, 16), lambda n: y[n + 1] * sin(2 * pi() * k * n / 16))), 2)) AS power FROM weighted)"""
MEL = "(2595 * log10(1 + {} / 700.0))"
EDGES = f"list_transform(range(0, 8), lambda i: 700 * (pow(10, ({MEL.format('300.0')} + i * ({MEL.format('7000.0')} - {MEL.format('300.0')}) / 7) / 2595) - 1))"
MEL_FROM = f"""
edges AS (SELECT {EDGES} AS c),
banks AS (SELECT list_transform(range(1, 7), lambda b: list_transform(range(0, 9), lambda k: greatest(0.0, 1 - abs(k * 1000.0 - c[b + 1]) / ((c[b + 2] - c[b]) / 2)))) AS bank FROM edges),
mels AS (SELECT vec_id, f, list_transform(bank, lambda t: CASE WHEN list_sum(t) > 0 THEN list_sum(list_transform(range(1, 10), lambda k: t[k] * power[k])) / list_sum(t) ELSE 0.0 END) AS mel FROM powers, banks)"""
NUMBERS = "array_to_string(list_transform({}, lambda x: printf('%.4f', round(x, 4) + 0.0)), ',')"
AS_ROWS = "SELECT vec_id, array_to_string(list({} ORDER BY f), ';') AS value FROM {} GROUP BY vec_id"
POWER_SQL = f"WITH source AS (SELECT vec_id, v AS x FROM {SINGLE_FROM}), {POWER_FROM} {AS_ROWS.format(NUMBERS.format('power'), 'powers')}"
MEL_SQL = f"WITH source AS (SELECT vec_id, v AS x FROM {SINGLE_FROM}), {POWER_FROM}, {MEL_FROM} {AS_ROWS.format(NUMBERS.format('mel'), 'mels')}"
MFCC_SQL = f"""WITH source AS (SELECT vec_id, list_transform(v, lambda x, i: CASE WHEN i = 1 THEN x ELSE x - 0.97 * v[i - 1] END) AS x FROM {SINGLE_FROM}), {POWER_FROM}, {MEL_FROM},
told AS (SELECT vec_id, f, list_transform(mel, lambda m: CASE WHEN m <= 1e-10 THEN -100.0 ELSE 10 * log10(m) END) AS db FROM mels),
found AS (SELECT vec_id, f, list_transform(range(0, 4), lambda k: 2 * list_sum(list_transform(range(0, 6), lambda b: db[b + 1] * cos(pi() * k * (b + 0.5) / 6))) * (1 + 11 * sin(pi() * k / 22))) AS mfcc FROM told)
{AS_ROWS.format(NUMBERS.format('mfcc'), 'found')}"""


def spectra(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        told = lambda frame: F.array_join(F.transform(frame, lambda x: F.format_string("%.4f", F.round(x, 4) + 0.0)), ",")
        return rows(spark, sf_dir).select("vec_id", F.array_join(F.transform(signals.spectra(F.col("v"), kind, **SHORT), told), ";").alias("value"))

    return query


def window_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of windows of 8 places and as many more as a nation's key."""
    n = F.col("n_nationkey").cast("int")
    every = table(spark, sf_dir, "nation").select(n.alias("n"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), signals.windows(k, n + 8).alias("w")) for k in ("hann", "hann-sqrt", "hamming", "povey")])).alias("x"))
    return every.select("n", "x.kind", F.posexplode("x.w").alias("pos", "weight")).withColumn("weight", F.round("weight", 8) + 0.0)


WINDOW_SQL = """
WITH places AS (SELECT CAST(n_nationkey AS INTEGER) AS n, CAST(unnest(range(0, 8 + n_nationkey)) AS INTEGER) AS pos FROM nation),
hann AS (SELECT n, pos, 0.5 - 0.5 * cos(2 * pi() * pos / (7 + n)) AS h, 0.54 - 0.46 * cos(2 * pi() * pos / (7 + n)) AS g FROM places)
SELECT n, pos, kind, round(weight, 8) + 0.0 AS weight FROM (
  SELECT n, pos, 'hann' AS kind, h AS weight FROM hann UNION ALL SELECT n, pos, 'hann-sqrt', sqrt(greatest(h, 0)) FROM hann
  UNION ALL SELECT n, pos, 'hamming', g FROM hann UNION ALL SELECT n, pos, 'povey', pow(greatest(h, 0), 0.85) FROM hann)
"""


def filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of second-order sections at frequencies that rise with a nation's key."""
    kinds = {"lowpass": 3.0, "highpass": 3.0, "bandpass": 0.8, "notch": 0.8, "allpass": 0.8, "peaking": 0.8, "lowshelf": 1.0, "highshelf": 1.0}
    n = F.col("n_nationkey").cast("int")
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), signals.filter_sections(k, 16000.0, 200.0 + 250 * n, q, 4.0).alias("c")) for k, q in kinds.items()]))
    found = table(spark, sf_dir, "nation").select(n.alias("n"), every.alias("x")).select("n", "x.kind", "x.c.*")
    return found.select("n", "kind", *[(F.round(c, 8) + 0.0).alias(c) for c in ("b0", "b1", "b2", "a1", "a2")])


FILTER_SQL = """
WITH places AS (SELECT CAST(n_nationkey AS INTEGER) AS n, cos(pi() * (200.0 + 250 * n_nationkey) / 8000) AS c, sin(pi() * (200.0 + 250 * n_nationkey) / 8000) AS s, pow(10, 0.1) AS a FROM nation),
more AS (SELECT *, s / (2 * pow(10, 0.15)) AS p, s / 1.6 AS q, 2 * sqrt(a) * s / sqrt(2.0) AS r FROM places),
raw AS (
  SELECT n, 'lowpass' AS kind, (1 - c) / 2 AS b0, 1 - c AS b1, (1 - c) / 2 AS b2, 1 + p AS a0, -2 * c AS a1, 1 - p AS a2 FROM more
  UNION ALL SELECT n, 'highpass', (1 + c) / 2, -(1 + c), (1 + c) / 2, 1 + p, -2 * c, 1 - p FROM more
  UNION ALL SELECT n, 'bandpass', q, 0, -q, 1 + q, -2 * c, 1 - q FROM more
  UNION ALL SELECT n, 'notch', 1, -2 * c, 1, 1 + q, -2 * c, 1 - q FROM more
  UNION ALL SELECT n, 'allpass', 1 - q, -2 * c, 1 + q, 1 + q, -2 * c, 1 - q FROM more
  UNION ALL SELECT n, 'peaking', 1 + q * a, -2 * c, 1 - q * a, 1 + q / a, -2 * c, 1 - q / a FROM more
  UNION ALL SELECT n, 'lowshelf', a * (a + 1 - (a - 1) * c + r), 2 * a * (a - 1 - (a + 1) * c), a * (a + 1 - (a - 1) * c - r), a + 1 + (a - 1) * c + r, -2 * (a - 1 + (a + 1) * c), a + 1 + (a - 1) * c - r FROM more
  UNION ALL SELECT n, 'highshelf', a * (a + 1 + (a - 1) * c + r), -2 * a * (a - 1 + (a + 1) * c), a * (a + 1 + (a - 1) * c - r), a + 1 - (a - 1) * c + r, 2 * (a - 1 - (a + 1) * c), a + 1 - (a - 1) * c - r FROM more)
SELECT n, kind, round(b0 / a0, 8) + 0.0 AS b0, round(b1 / a0, 8) + 0.0 AS b1, round(b2 / a0, 8) + 0.0 AS b2, round(a1 / a0, 8) + 0.0 AS a1, round(a2 / a0, 8) + 0.0 AS a2 FROM raw
"""


def leb128(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") * 7919
    m = n - 40_000_000
    shown = table(spark, sf_dir, "events").select("event_id", e.encode_leb128(n, signed=False).alias("u"), e.encode_leb128(m).alias("z"))
    return shown.select("event_id", e.hexed(F.col("u")).alias("plain"), e.hexed(F.col("z")).alias("signed"), e.decode_leb128(F.col("u"), signed=False).alias("plain_back"), e.decode_leb128(F.col("z")).alias("signed_back"))


SEPTETS = "array_to_string(list_transform(range(0, {1}), lambda i: printf('%02x', (({0} >> CAST(7 * i AS BIGINT)) & 127) + CASE WHEN i < {1} - 1 THEN 128 ELSE 0 END)), '')"
LEB_SQL = f"""
SELECT event_id, {SEPTETS.format('n', 'a')} AS plain, {SEPTETS.format('m', 'b')} AS signed, n AS plain_back, m AS signed_back
FROM (SELECT event_id, n, m, list_filter(range(1, 9), lambda k: n < (1::BIGINT << CAST(7 * k AS BIGINT)))[1] AS a, list_filter(range(1, 9), lambda k: m >= -(1::BIGINT << CAST(7 * k - 1 AS BIGINT)) AND m < (1::BIGINT << CAST(7 * k - 1 AS BIGINT)))[1] AS b
  FROM (SELECT event_id, event_id * 7919 AS n, event_id * 7919 - 40000000 AS m FROM events))
"""


def little_endian(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") * 7919 - 40_000_000
    shown = table(spark, sf_dir, "events").select("event_id", *[e.to_little_endian(n, k).alias(f"b{k}") for k in (1, 2, 4)])
    numbers = [e.little_endian(F.col(f"b{k}"), 0, k, signed).alias(f"{'i' if signed else 'u'}{8 * k}") for k in (1, 2, 4) for signed in (False, True)]
    return shown.select("event_id", e.hexed(F.col("b4")).alias("bytes"), *numbers)


UNSIGNED = "((n + 4294967296) & {})"
LITTLE_SQL = "SELECT event_id, printf('%02x%02x%02x%02x', u & 255, (u >> 8) & 255, (u >> 16) & 255, (u >> 24) & 255) AS bytes, " + ", ".join(
    f"u & {(1 << bits) - 1} AS u{bits}, CASE WHEN (u & {(1 << bits) - 1}) >= {1 << (bits - 1)} THEN (u & {(1 << bits) - 1}) - {1 << bits} ELSE u & {(1 << bits) - 1} END AS i{bits}" for bits in (8, 16, 32)
) + " FROM (SELECT event_id, ((event_id * 7919 - 40000000) + 4294967296) & 4294967295 AS u FROM events)"


def murmur_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", e.murmur3_int(F.col("event_id").cast("int")).alias("value"))


ROTATED = "((({0}) << {1}) | (({0}) >> {2})) & 4294967295"
MURMUR_SQL = """
WITH k AS (SELECT event_id, (CAST(event_id AS HUGEINT) * 3432918353) % 4294967296 AS k FROM events),
r AS (SELECT event_id, (((k * 32768) % 4294967296 + k // 131072) * 461845907) % 4294967296 AS k FROM k),
h AS (SELECT event_id, xor(42::UBIGINT, CAST(k AS UBIGINT)) AS h FROM r),
s AS (SELECT event_id, ((CAST((h * 8192) % 4294967296 + h // 524288 AS HUGEINT) * 5) + 3864292196) % 4294967296 AS h FROM h),
a AS (SELECT event_id, xor(CAST(h AS UBIGINT), 4::UBIGINT) AS h FROM s),
b AS (SELECT event_id, (CAST(xor(h, h // 65536) AS HUGEINT) * 2246822507) % 4294967296 AS h FROM a),
c AS (SELECT event_id, (CAST(xor(CAST(h AS UBIGINT), CAST(h // 8192 AS UBIGINT)) AS HUGEINT) * 3266489909) % 4294967296 AS h FROM b)
SELECT event_id, CAST(xor(CAST(h AS UBIGINT), CAST(h // 65536 AS UBIGINT)) AS BIGINT) AS value FROM c
"""


def xorshift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first numbers of a generator seeded by each event."""
    first = table(spark, sf_dir, "events").select("event_id", randoms.following(randoms.seeded(F.col("event_id"))).alias("a"))
    second = first.withColumn("b", randoms.following(F.col("a")))
    return second.select("event_id", randoms.signed(F.col("a")).alias("number"), F.round(randoms.uniform(F.col("b")), 9).alias("uniform"), F.floor(randoms.uniform(F.col("b")) * 90 + 10).alias("whole"), F.round(randoms.uniform(F.col("a")) * 4 - 2, 8).alias("real"))


NEXT = "xor(xor(xor({0}, ({0} << 13) & 4294967295), xor({0}, ({0} << 13) & 4294967295) >> 17), (xor(xor({0}, ({0} << 13) & 4294967295), xor({0}, ({0} << 13) & 4294967295) >> 17) << 5) & 4294967295)"
XORSHIFT_SQL = f"""
WITH s AS (SELECT event_id, (3077908504 + event_id) & 4294967295 AS s FROM events), a AS (SELECT event_id, {NEXT.format('s')} AS a FROM s), b AS (SELECT event_id, a, {NEXT.format('a')} AS b FROM a)
SELECT event_id, CASE WHEN a >= 2147483648 THEN a - 4294967296 ELSE a END AS number, round(b / 4294967296.0::DOUBLE, 9) AS uniform, CAST(floor(b / 4294967296.0::DOUBLE * 90 + 10) AS BIGINT) AS whole, round(a / 4294967296.0::DOUBLE * 4 - 2, 8) AS real FROM b
"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", s.frames_in(x / 10, F.lit(12.0)).alias("frames"), F.round(s.decibels_to_power(x / 5 - 120), 8).alias("power"), F.round(s.duration(F.array_repeat(F.lit(0.0), F.floor(x).cast("int")), F.lit(16.0)), 6).alias("seconds"),
    )


FRAMES_SQL = "SELECT event_id, CASE WHEN value / 10 <= 12 THEN CAST(floor(12 / 0.02::DOUBLE) - floor(value / 10 / 0.02::DOUBLE) AS BIGINT) END AS frames, round(CASE WHEN value / 5 - 120 <= -100 THEN 0.0 ELSE pow(10, (value / 5 - 120) / 10) END, 8) AS power, round(floor(value) / 16, 6) AS seconds FROM events"


def weighted_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_sets.weighted_covariance(rows(spark, sf_dir).withColumn("weight", 1 / (1 + F.col("vec_id"))), "label", "v", "weight")
    return found.select("label", "i", "j", rounded(F.col("value")).alias("value"))


WEIGHTED_SQL = """
WITH x AS (SELECT vec_id, label, i - 1 AS pos, embedding[i]::DOUBLE AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(i))
SELECT a.label, CAST(a.pos AS INTEGER) AS i, CAST(b.pos AS INTEGER) AS j, round(CASE WHEN count(*) > 1 THEN sum(a.x * b.x / (1 + a.vec_id)) + CASE WHEN a.pos = b.pos THEN 1e-6 ELSE 0 END ELSE 0 END, 6) + 0.0 AS value
FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.pos <= b.pos GROUP BY a.label, a.pos, b.pos
"""


# alignments of each vector with that of the next id


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rows(spark, sf_dir)
    return found.select("vec_id", F.col("v").alias("a")).join(found.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("b")), "vec_id")


def warped(band: int | None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pairs = neighbours(spark, sf_dir)
        return pairs.select("vec_id", F.round(alignment.aligned(pairs, "a", "b", band=band)["cost"], 3).alias("cost"))

    return query


STEP = "abs(v[CAST({i} AS INTEGER)] - w[CAST({j} AS INTEGER)])::FLOAT"
ROWS = "list_transform(range(2, len(v) + 1), lambda i: [i::FLOAT])"
#: The first row and column but for the first pair are closed.
PAIR_SQL = f"""
SELECT vec_id, round(list_reduce(list_prepend(list_prepend(0::FLOAT, list_transform(range(2, len(w) + 1), lambda j: 'inf'::FLOAT)), {ROWS}),
  lambda p, x: list_reduce(list_prepend(['inf'::FLOAT], list_transform(range(2, len(w) + 1), lambda j: [j::FLOAT])),
    lambda r, y: list_append(r, {STEP.format(i='x[1]', j='y[1]')} + least(r[-1], p[CAST(y[1] AS INTEGER)], p[CAST(y[1] AS INTEGER) - 1]))))[-1]::DOUBLE, 3) AS cost
FROM {PAIR_FROM}
"""
#: Row i (from 0) meets the places start(i) to start(i) + 7, start(i) = least(56, greatest(0, i - 4)); c counts them from 1.
BAND_START = "CAST(least(56, greatest(0, {} - 4)) AS INTEGER)"
MOVED = f"({BAND_START.format('x[1] - 1')} - {BAND_START.format('x[1] - 2')})"
CELL = STEP.format(i="x[1]", j=f"{BAND_START.format('x[1] - 1')} + y[1]")
BANDED_SQL = f"""
SELECT vec_id, round(list_reduce(list_prepend(
    list_reduce(list_prepend([0::FLOAT], list_transform(range(2, 9), lambda j: [j::FLOAT])), lambda r, y: list_append(r, {STEP.format(i=1, j='y[1]')} + r[-1])), {ROWS}),
  lambda p, x: list_reduce(list_prepend([{STEP.format(i='x[1]', j=BAND_START.format('x[1] - 1') + ' + 1')} + CASE WHEN {MOVED} = 0 THEN p[1] ELSE least(p[1], p[2]) END], list_transform(range(2, 9), lambda j: [j::FLOAT])),
    lambda r, y: list_append(r, {CELL} + least(r[-1], p[CAST(y[1] AS INTEGER) + {MOVED} - 1], CASE WHEN y[1] + {MOVED} <= 8 THEN p[CAST(y[1] AS INTEGER) + {MOVED}] ELSE 'inf'::FLOAT END))))[8]::DOUBLE, 3) AS cost
FROM {PAIR_FROM}
"""


def cosine_warped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors read as 16 steps of four numbers."""
    pairs = neighbours(spark, sf_dir).select("vec_id", v.split_parts(F.col("a"), 4).alias("a"), v.split_parts(F.col("b"), 4).alias("b"))
    return pairs.select("vec_id", F.round(alignment.aligned(pairs, "a", "b", "cosine", band=16)["cost"], 3).alias("cost"))


COSINE = "(1 - greatest(-1.0, least(1.0, list_sum(list_transform(range(1, 5), lambda k: v[CAST(4 * {i} - 4 + k AS INTEGER)] * w[CAST(4 * {j} - 4 + k AS INTEGER)])) / (sqrt(list_sum(list_transform(range(1, 5), lambda k: pow(v[CAST(4 * {i} - 4 + k AS INTEGER)], 2)))) * sqrt(list_sum(list_transform(range(1, 5), lambda k: pow(w[CAST(4 * {j} - 4 + k AS INTEGER)], 2)))) + 1e-40))))::FLOAT"
COSINE_SQL = f"""
WITH c AS (SELECT vec_id, list_transform(range(1, 17), lambda i: list_transform(range(1, 17), lambda j: {COSINE.format(i='i', j='j')})) AS m FROM {PAIR_FROM})
SELECT vec_id, round(list_reduce(list_prepend(
    list_reduce(list_prepend([0::FLOAT], list_transform(range(2, 17), lambda j: [j::FLOAT])), lambda r, y: list_append(r, m[1][CAST(y[1] AS INTEGER)] + r[-1])), list_transform(range(2, 17), lambda i: [i::FLOAT])),
  lambda p, x: list_reduce(list_prepend([m[CAST(x[1] AS INTEGER)][1] + p[1]], list_transform(range(2, 17), lambda j: [j::FLOAT])),
    lambda r, y: list_append(r, m[CAST(x[1] AS INTEGER)][CAST(y[1] AS INTEGER)] + least(r[-1], p[CAST(y[1] AS INTEGER)], p[CAST(y[1] AS INTEGER) - 1]))))[-1]::DOUBLE, 3) AS cost FROM c
"""


def searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight numbers of each vector sought in the next one."""
    pairs = neighbours(spark, sf_dir).withColumn("a", F.slice("a", 1, 8))
    return pairs.select("vec_id", F.round(alignment.found_in(pairs, "a", "b")["cost"], 4).alias("cost"))


SEARCH_STEP = "abs(v[CAST({i} AS INTEGER)] - w[CAST({j} AS INTEGER)])"
SEARCH_SQL = f"""
SELECT vec_id, round(list_min(list_reduce(list_prepend(list_transform(w, lambda y: abs(v[1] - y)), list_transform(range(2, 9), lambda i: [i::DOUBLE])),
  lambda p, x: list_reduce(list_prepend([{SEARCH_STEP.format(i='x[1]', j=1)} + p[1]], list_transform(range(2, len(w) + 1), lambda j: [j::DOUBLE])),
    lambda r, y: list_append(r, {SEARCH_STEP.format(i='x[1]', j='y[1]')} + least(r[-1], p[CAST(y[1] AS INTEGER)], p[CAST(y[1] AS INTEGER) - 1]))))), 4) AS cost
FROM {PAIR_FROM}
"""


def mfcc_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two signals by way of their mfcc frames: features, then the warping path's cost."""
    found = alignment.aligned_signals(neighbours(spark, sf_dir), "vec_id", "a", "b", **SHORT)
    return found.select("vec_id", F.round("cost", 2).alias("cost"))


FRAMES_OF = MFCC_SQL[: MFCC_SQL.rindex("SELECT vec_id, array_to_string")]
MFCC_DTW_SQL = f"""{FRAMES_OF.rstrip()},
m AS (SELECT vec_id, list(mfcc ORDER BY f) AS m FROM found GROUP BY vec_id),
c AS (SELECT x.vec_id, list_transform(x.m, lambda p: list_transform(y.m, lambda q: sqrt(list_sum(list_transform(range(1, 5), lambda k: pow(p[k] - q[k], 2))))::FLOAT)) AS c FROM m x JOIN m y ON y.vec_id = x.vec_id + 1)
SELECT vec_id, round(list_reduce(list_prepend(list_prepend(0::FLOAT, list_transform(range(2, 10), lambda j: 'inf'::FLOAT)), list_transform(range(2, 10), lambda i: [i::FLOAT])),
  lambda p, x: list_reduce(list_prepend(['inf'::FLOAT], list_transform(range(2, 10), lambda j: [j::FLOAT])),
    lambda r, y: list_append(r, c[CAST(x[1] AS INTEGER)][CAST(y[1] AS INTEGER)] + least(r[-1], p[CAST(y[1] AS INTEGER)], p[CAST(y[1] AS INTEGER) - 1]))))[-1]::DOUBLE, 2) AS cost FROM c
"""


def edit_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", F.split("text", " ").alias("a"))
    pairs = items.join(items.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b")), "item_id")
    return pairs.select("item_id", alignment.edit_aligned(pairs, "a", "b", {("the", "and"): 0.5, ("of", "in"): 0.5})["cost"].alias("cost"))


PUT = "CASE WHEN a[CAST(x[1] AS INTEGER)] = b[CAST(y[1] AS INTEGER)] THEN 0.0 WHEN (a[CAST(x[1] AS INTEGER)], b[CAST(y[1] AS INTEGER)]) IN (('the', 'and'), ('and', 'the'), ('of', 'in'), ('in', 'of')) THEN 0.5 ELSE 1.0 END"
DIAGONAL, UP, LEFT = "p[CAST(y[1] AS INTEGER)]", "p[CAST(y[1] AS INTEGER) + 1]", "r[-1]"
EDIT_SQL = f"""
SELECT item_id, list_reduce(list_prepend(list_transform(range(0, len(b) + 1), lambda j: j::DOUBLE), list_transform(range(1, len(a) + 1), lambda i: [i::DOUBLE])),
  lambda p, x: list_reduce(list_prepend([x[1]], list_transform(range(1, len(b) + 1), lambda j: [j::DOUBLE])),
    lambda r, y: list_append(r, CASE WHEN {DIAGONAL} <= {UP} AND {DIAGONAL} <= {LEFT} THEN {DIAGONAL} + {PUT} WHEN {UP} <= {LEFT} THEN {UP} + 1 ELSE {LEFT} + 1 END)))[-1] AS cost
FROM (SELECT x.item_id, string_split(x.text, ' ') AS a, string_split(y.text, ' ') AS b FROM benchmark x JOIN benchmark y ON y.item_id = x.item_id + 1)
"""

OTHERS = {
    "sig_pcm": (pcm, PCM_QUERY), "sig_power_spectrum": (spectra("power"), POWER_SQL), "sig_mel_spectrum": (spectra("mel"), MEL_SQL), "sig_mfcc": (spectra("mfcc"), MFCC_SQL),
    "vec_window_weights": (window_weights, WINDOW_SQL), "sig_filter_coefficients": (filters, FILTER_SQL), "enc_leb128": (leb128, LEB_SQL), "enc_little_endian": (little_endian, LITTLE_SQL),
    "hash_murmur_int": (murmur_int, MURMUR_SQL), "rnd_xorshift": (xorshift, XORSHIFT_SQL), "time_frames": (frames, FRAMES_SQL), "vec_cov_weighted": (weighted_covariance, WEIGHTED_SQL),
    "dtw_pair": (warped(None), PAIR_SQL), "dtw_banded": (warped(8), BANDED_SQL), "dtw_cosine": (cosine_warped, COSINE_SQL), "dtw_search": (searched, SEARCH_SQL), "dtw_mfcc": (mfcc_aligned, MFCC_DTW_SQL), "txt_edit_phone": (edit_words, EDIT_SQL),
}


def queries() -> dict:
    found = {n: single(kind, expr) for n, (kind, expr, _) in SINGLE.items()}
    found |= {n: paired(kind, expr) for n, (kind, expr, _) in PAIRS.items()}
    return found | {n: q for n, (q, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    found = {n: f"SELECT vec_id, {OUT[kind][1].format(sql)} AS value FROM {SINGLE_FROM}" for n, (kind, _, sql) in SINGLE.items()}
    found |= {n: f"SELECT vec_id, {OUT[kind][1].format(sql)} AS value FROM {PAIR_FROM}" for n, (kind, _, sql) in PAIRS.items()}
    return found | {n: sql for n, (_, sql) in OTHERS.items()}
