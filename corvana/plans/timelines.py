"""Queries of the timeline, subtitle, signal, catalogue and config operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvana.functions import encodings, signals
from corvana.functions.texts import words as split_words
from corvana.operators import catalog, parts, stateful, subtitles
from corvana.operators import timeline as tl
from corvana.plans.islands import state_islands
from corvana.session import table

BASE = 1_704_067_200_000_000  # microseconds at the first of January 2024
THRESHOLD = 50.0
SECONDS = f"((epoch_us(ts) - {BASE}) / 1e6)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("t", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01', ts)") / 1e6)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return events(spark, sf_dir).select("event_id", (v - 100).alias("start_time"), (v - 100 + F.col("event_id") % 5).alias("end_time"), (v / 500).alias("confidence"))


ENTRIES = "(SELECT event_id, value - 100 AS start_time, value - 100 + event_id % 5 AS end_time, value / 500 AS confidence FROM events)"


def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = state_islands(events(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("value") >= THRESHOLD)
    return rows.groupBy("user_id", "island", "state").agg(F.min("t").alias("start_time"), F.max("t").alias("end_time"))


ISLANDS = f"""
flagged AS (SELECT user_id, {SECONDS} AS t, ts, event_id, coalesce(value >= {THRESHOLD}, false) AS state FROM events),
marked AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) <> state THEN 1 ELSE 0 END AS changed FROM flagged),
numbered AS (SELECT *, CAST(sum(changed) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS island FROM marked),
islands AS (SELECT user_id, island, state, min(t) AS start_time, max(t) AS end_time FROM numbered GROUP BY user_id, island, state)"""


def timed(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[(F.round(F.col(c) + 2e-8, 4) + 0.0).alias(c) for c in ("start_time", "end_time")])


TIMED = "round(start_time + 2e-8, 4) + 0.0 AS start_time, round(end_time + 2e-8, 4) + 0.0 AS end_time"


def shift(spark, sf_dir):
    return timed(tl.shift(entries(spark, sf_dir), 12.5), "event_id")


def scale(spark, sf_dir):
    return timed(tl.scale(entries(spark, sf_dir), 1.5), "event_id")


def rounding(spark, sf_dir):
    return tl.round_times(entries(spark, sf_dir), 1)


def extract(spark, sf_dir):
    """Lines that hold a word, and that word's rows in no such line's tree: of matching lines only the line."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    words = lines.select("doc_id", "i", F.posexplode(F.split("line", " ")).alias("j", "text"))
    tree = lines.select("doc_id", F.array("i").alias("path"), F.col("line").alias("text"), F.col("line").contains("that ").alias("hit"))
    tree = tree.union(words.select("doc_id", F.array("i", "j"), "text", F.col("text").isin("that", "and", "und")))
    found = tl.extract(tree, F.col("hit"))
    return found.groupBy("doc_id", F.size("path").alias("depth")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


EXTRACT_SQL = """
WITH lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
words AS (SELECT doc_id, unnest(string_split(line, ' ')) AS text FROM lines WHERE NOT contains(line, 'that '))
SELECT doc_id, 1 AS depth, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM lines WHERE contains(line, 'that ') GROUP BY doc_id
UNION ALL
SELECT doc_id, 2, count(*), CAST(sum(length(text)) AS BIGINT) FROM words WHERE text IN ('that', 'and', 'und') GROUP BY doc_id
"""


def numbered(spark, sf_dir):
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events(spark, sf_dir).withColumn("n", F.row_number().over(by) - 1)


NUMBERED = f"(SELECT *, {SECONDS} AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)"


def segments(spark, sf_dir):
    found = tl.frames_to_segments(numbered(spark, sf_dir).withColumn("p", F.col("value") / 500), "user_id", "n", "p", 0.25, 0.1)
    return timed(found, "user_id", "segment", "active")


SEGMENTS_SQL = f"""
WITH f AS (SELECT user_id, n, value / 500 >= 0.1 AS active FROM {NUMBERED}),
m AS (SELECT *, CASE WHEN lag(active) OVER (PARTITION BY user_id ORDER BY n) <> active THEN 1 ELSE 0 END AS changed FROM f),
s AS (SELECT *, CAST(sum(changed) OVER (PARTITION BY user_id ORDER BY n) AS BIGINT) AS segment FROM m)
SELECT user_id, segment, active, round(min(n) * 0.25 + 2e-8, 4) + 0.0 AS start_time, round((max(n) + 1) * 0.25 + 2e-8, 4) + 0.0 AS end_time FROM s GROUP BY user_id, segment, active
"""


def overlap_map(spark, sf_dir):
    cropped = numbered(spark, sf_dir).select("user_id", "event_id", (F.col("n") * 900.0).alias("start_time"), (F.col("n") * 900.0 + F.col("value") * 20).alias("end_time"))
    return timed(tl.uncropped(cropped, islands(spark, sf_dir).where("state"), "user_id", "event_id", "island", 3600.0), "user_id", "event_id")


OVERLAP_SQL = f"""
WITH {ISLANDS},
kept AS (SELECT *, coalesce(sum(end_time - start_time) OVER (PARTITION BY user_id ORDER BY island ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM islands WHERE state),
e AS (SELECT user_id, event_id, n * 900.0::DOUBLE AS s, n * 900.0::DOUBLE + value * 20 AS e FROM {NUMBERED}),
found AS (SELECT e.user_id, e.event_id, start_time + greatest(s, o) - o AS a, start_time + least(e, o + end_time - start_time) - o AS b,
  row_number() OVER (PARTITION BY e.user_id, e.event_id ORDER BY least(e, o + end_time - start_time) - greatest(s, o) DESC, island) AS r
  FROM e JOIN kept k ON k.user_id = e.user_id AND least(e, o + end_time - start_time) >= greatest(s, o)),
tail AS (SELECT user_id, arg_max(end_time, island) AS tail FROM kept GROUP BY user_id)
SELECT e.user_id, e.event_id, round(coalesce(a, tail, 0) + 2e-8, 4) + 0.0 AS start_time, round(coalesce(b, tail, 0) + 2e-8, 4) + 0.0 AS end_time
FROM e LEFT JOIN (SELECT * FROM found WHERE r = 1) f ON f.user_id = e.user_id AND f.event_id = e.event_id LEFT JOIN tail t ON t.user_id = e.user_id
"""


def interpolate(spark, sf_dir):
    words = islands(spark, sf_dir)
    source = words.withColumns({"start_time": F.col("start_time") * 0.5 + 1, "end_time": F.col("end_time") * 0.5 + 3})
    children = state_islands(events(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("value") >= THRESHOLD).select("user_id", "island", "event_id", F.col("t").alias("start_time"), (F.col("t") + 1).alias("end_time"))
    return timed(tl.interpolated(children, source, words, "user_id", "island"), "event_id")


INTERPOLATE_SQL = f"""
WITH {ISLANDS}
SELECT event_id,
  round(s0 + CASE WHEN end_time = start_time THEN 0 ELSE (t - start_time) / (end_time - start_time) END * (s1 - s0) + 2e-8, 4) + 0.0 AS start_time,
  round(s0 + CASE WHEN end_time = start_time THEN 0 ELSE (t + 1 - start_time) / (end_time - start_time) END * (s1 - s0) + 2e-8, 4) + 0.0 AS end_time
FROM (SELECT n.event_id, n.t, i.*, i.start_time * 0.5 + 1 AS s0, i.end_time * 0.5 + 3 AS s1 FROM numbered n JOIN islands i ON i.user_id = n.user_id AND i.island = n.island)
"""


def cue_extend(spark, sf_dir):
    return timed(tl.extended_cues(islands(spark, sf_dir), "user_id", ["island"], 3.0), "user_id", "island")


CUE_SQL = f"""
WITH {ISLANDS}
SELECT user_id, island, round(start_time + 2e-8, 4) + 0.0 AS start_time,
  round(coalesce(least(end_time + 3, lead(start_time) OVER (PARTITION BY user_id ORDER BY island)), end_time) + 2e-8, 4) + 0.0 AS end_time
FROM (SELECT user_id, island, start_time, end_time FROM islands)
"""
# least() leaves nulls out in DuckDB, so the last cue needs its own branch
CUE_SQL = CUE_SQL.replace("coalesce(least(end_time + 3, lead(start_time) OVER (PARTITION BY user_id ORDER BY island)), end_time)", "CASE WHEN lead(start_time) OVER w IS NULL THEN end_time ELSE least(end_time + 3, lead(start_time) OVER w) END").rstrip() + "\nWINDOW w AS (PARTITION BY user_id ORDER BY island)\n"


def paths(spark, sf_dir):
    return numbered(spark, sf_dir).select("user_id", F.floor(F.col("n") / 3).alias("source"), F.floor((F.col("n") * 2) / 3).alias("dest"))


def path_compact(spark, sf_dir):
    return tl.compact_path(paths(spark, sf_dir), "user_id")


def path_mapped(spark, sf_dir):
    frames = numbered(spark, sf_dir).select("user_id", "event_id", F.col("n"))
    return tl.mapped_frames(frames, tl.compact_path(paths(spark, sf_dir), "user_id"), "user_id", "n", "last").select("event_id", "mapped")


COMPACT = f"(SELECT user_id, n // 3 AS source, min(n * 2 // 3) AS first, max(n * 2 // 3) AS last FROM {NUMBERED} GROUP BY user_id, n // 3)"
MAPPED_SQL = f"SELECT e.event_id, c.last AS mapped FROM {NUMBERED} e JOIN (SELECT user_id, max(source) AS high FROM {COMPACT} GROUP BY user_id) h USING (user_id) JOIN {COMPACT} c ON c.user_id = e.user_id AND c.source = least(e.n, h.high)"


def word_offsets(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("n", "word"))
    return tl.joined_offsets(words, "item_id", "n", "word").select("item_id", "n", "word", "offset")


OFFSETS_SQL = """
SELECT item_id, CAST(i - 1 AS INTEGER) AS n, w[i] AS word, CAST(coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x) + 1)), 0) AS BIGINT) AS offset
FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark))
"""


def sentences(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", r"[ \n]+")).alias("n", "word"))
    words = words.withColumns({"start_time": F.when(F.col("n") % 7 != 3, F.col("n") * 0.5), "end_time": F.when(F.col("n") % 7 != 3, F.col("n") * 0.5 + 0.25)})
    found = tl.words_to_sentences(words, "item_id", "n", F.col("word").rlike(r"[.?!]$"), F.col("word").endswith("!"))
    return timed(found, "item_id", "segment", "sentence", "text")


SENTENCES_SQL = f"""
WITH w AS (SELECT item_id, i - 1 AS n, l[i] AS word, CASE WHEN (i - 1) % 7 <> 3 THEN (i - 1) * 0.5::DOUBLE END AS s, CASE WHEN (i - 1) % 7 <> 3 THEN (i - 1) * 0.5::DOUBLE + 0.25 END AS e
  FROM (SELECT item_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT item_id, regexp_split_to_array(text, '[ \\n]+') AS l FROM benchmark))),
k AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(word, '[.?!]$') THEN 1 ELSE 0 END) OVER b, 0) AS sentence, coalesce(sum(CASE WHEN ends_with(word, '!') THEN 1 ELSE 0 END) OVER b, 0) AS segment,
  coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY n ROWS UNBOUNDED PRECEDING), 0) AS known
  FROM w WINDOW b AS (PARTITION BY item_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT item_id, CAST(segment AS BIGINT) AS segment, CAST(sentence AS BIGINT) AS sentence, string_agg(word, ' ' ORDER BY n) AS text,
  round(coalesce(min(s), min(known)) + 2e-8, 4) + 0.0 AS start_time, round(coalesce(max(e), max(known)) + 2e-8, 4) + 0.0 AS end_time
FROM k GROUP BY item_id, segment, sentence
"""


def srt(spark, sf_dir, kind="srt"):
    cues = islands(spark, sf_dir).withColumn("lines", F.array(F.when(F.col("state"), "active").otherwise("at  rest"), F.col("island").cast("string")))
    return subtitles.rendered(cues, "user_id", "island", "lines", kind)


def srt_render(spark, sf_dir):
    return srt(spark, sf_dir).select("user_id", F.md5("subtitles").alias("digest"))


def srt_parse(spark, sf_dir):
    return subtitles.cues(srt(spark, sf_dir), "user_id", "subtitles").select("user_id", "cue", F.round("start_time", 3).alias("start_time"), F.round("end_time", 3).alias("end_time"), "text")


Z = "lpad(CAST({} AS VARCHAR), 2, '0')"
SHOWN = lambda c: f"lpad(CAST({c} // 3600000 AS VARCHAR), CAST(greatest(2, length(CAST({c} // 3600000 AS VARCHAR))) AS INTEGER), '0') || ':' || {Z.format(f'{c} // 60000 % 60')} || ':' || {Z.format(f'{c} // 1000 % 60')} || ',' || lpad(CAST({c} % 1000 AS VARCHAR), 3, '0')"
CUES = f"(SELECT user_id, island, CASE WHEN state THEN 'active' ELSE 'at  rest' END AS word, CAST(floor(start_time * 1000 + 1e-6) AS BIGINT) AS a, CAST(floor(end_time * 1000 + 1e-6) AS BIGINT) AS b FROM islands)"
SRT_SQL = f"WITH {ISLANDS} SELECT user_id, md5(string_agg((island + 1) || chr(10) || {SHOWN('a')} || ' --> ' || {SHOWN('b')} || chr(10) || word || chr(10) || island || chr(10) || chr(10), '' ORDER BY island)) AS digest FROM {CUES} GROUP BY user_id"
PARSE_SQL = f"WITH {ISLANDS} SELECT user_id, island AS cue, round(a / 1000, 3) AS start_time, round(b / 1000, 3) AS end_time, replace(word, '  ', ' ') || ' ' || island AS text FROM {CUES}"


def decaying_peak(spark, sf_dir):
    found = stateful.decaying_peak(events(spark, sf_dir), "user_id", ["ts", "event_id"], "value", 1.5)
    return found.select("event_id", (F.round("peak", 6) + 0.0).alias("peak"))


PEAK_SQL = f"SELECT event_id, round(greatest(0, max(value + (n + 1) * 1.5::DOUBLE) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING)) - (n + 1) * 1.5::DOUBLE, 6) + 0.0 AS peak FROM {NUMBERED}"


def gate(spark, sf_dir):
    active = events(spark, sf_dir).withColumn("active", F.col("value") > 150)
    return stateful.gate_extended(active, "user_id", ["ts", "event_id"], "active", 4).select("event_id", "active")


GATE_SQL = "SELECT event_id, max(value > 150) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS active FROM events"


def folded(fold):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = stateful.folded(events(spark, sf_dir).select("user_id", "event_id", "ts", "value"), "user_id", ["ts", "event_id"], "value", fold)
        return found.select("event_id", (F.round(F.col("y") + 1e-9, 4) + 0.0).alias("value"))

    return query


VALUES = "(SELECT list(event_id ORDER BY ts, event_id) AS ids, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id)"


def fold_sql(first: str, step: str, keep: int) -> str:
    """A fold in SQL: the accumulator's first values are the state, the rest the outputs."""
    return f"SELECT event_id, round(y + 1e-9, 4) + 0.0 AS value FROM (SELECT unnest(ids) AS event_id, unnest(list_reduce(list_prepend({first}, list_transform(v, lambda x: [x])), lambda a, x: {step})[{keep + 1}:]) AS y FROM {VALUES})"


EMA = "a[1] + (x[1] - a[1]) * CASE WHEN x[1] > a[1] THEN 0.4 ELSE 0.05 END"
EMA_SQL = fold_sql("[0::DOUBLE]", f"list_append(list_prepend({EMA}, a[2:]), {EMA})", 1)
COEFFICIENTS = signals.filter_coefficients("lowpass", 1000.0, 100.0, 0.7071)
#: The same by the equaliser cookbook's formulas: w = 0.2 pi, alpha = sin(w) / (2 * 10^(q / 20)).
COS, ALPHA = "cos(pi() / 5)", "(sin(pi() / 5) / (2 * pow(10, 0.7071 / 20)))"
BIQUAD = f"((1 - {COS}) / 2 * x[1] + (1 - {COS}) * a[3] + (1 - {COS}) / 2 * a[4] + 2 * {COS} * a[1] - (1 - {ALPHA}) * a[2]) / (1 + {ALPHA})"
BIQUAD_SQL = fold_sql("[0::DOUBLE, 0, 0, 0]", f"list_append(list_concat([{BIQUAD}, a[1], x[1], a[3]], a[5:]), {BIQUAD})", 4)
LOUD = "greatest(1e-10, a[1] + (x[1] * x[1] - a[1]) * CASE WHEN x[1] * x[1] > a[1] THEN 0.3 ELSE 0.1 END)"
LOUD_SQL = fold_sql("[1e-5::DOUBLE]", f"list_append(list_prepend({LOUD}, a[2:]), greatest(-100.0, 10 * log10({LOUD})))", 1)


def config(spark, sf_dir):
    """Flat keys of the JSON settings, in dotted form."""
    pairs = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.explode(pairs).alias("key", "value")).select("event_id", F.concat(F.lit("props."), "key").alias("key"), "value")


CONFIG_SQL = "SELECT event_id, 'props.' || k AS key, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)"


def voice_catalogue(spark, sf_dir):
    """Suppliers as voices: the nation gives languages and dialects."""
    n = F.col("s_nationkey")
    languages = F.when(n % 3 == 0, F.array(F.lit("en"), F.lit("en-US"))).when(n % 3 == 1, F.array(F.lit("de"), F.lit("de-DE"))).otherwise(F.array(F.lit("fr")))
    gender = F.when(n % 4 == 0, "unknown").when(n % 4 == 1, "female").otherwise("male")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name"), languages.alias("languages"), gender.alias("gender"))


def catalog_voice(spark, sf_dir):
    return catalog.voices(voice_catalogue(spark, sf_dir), "fr-CA", "female", "supplier").select("ord", "name", "gender")


def catalog_best(spark, sf_dir):
    return catalog.best_voice(catalog.voices(voice_catalogue(spark, sf_dir), "de"), "de").select("ord", "name")


def catalog_languages(spark, sf_dir):
    return catalog.voice_languages(voice_catalogue(spark, sf_dir))


def catalog_versions(spark, sf_dir):
    """Suppliers as packages, a third of them with a version in their name."""
    n = F.col("s_suppkey")
    name = F.when(n % 3 == 0, F.concat("s_name", F.lit("-20240"), (n % 900 + 100).cast("string"))).when(n % 3 == 1, F.concat("s_name", F.lit("-20240101_"), n.cast("string"))).otherwise(F.concat(F.lit("voice-"), (n % 2).cast("string")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", catalog.version_tag(name).alias("tag"), catalog.versioned(name, {"voice-1": "20231212"}, "20230718").alias("versioned"))


VERSIONS_SQL = """
SELECT s_suppkey, nullif(regexp_extract(name, '^.*-([0-9]{8}(?:_[0-9]+)?)$', 1), '') AS tag,
  CASE WHEN regexp_matches(name, '-[0-9]{8}(_[0-9]+)?$') THEN name WHEN name = 'voice-1' THEN name || '-20231212' ELSE name || '-20230718' END AS versioned
FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_name || '-20240' || (s_suppkey % 900 + 100) WHEN 1 THEN s_name || '-20240101_' || s_suppkey ELSE 'voice-' || (s_suppkey % 2) END AS name FROM supplier)
"""
VOICES = "(SELECT s_suppkey AS ord, s_name AS name, CASE s_nationkey % 3 WHEN 0 THEN ['en', 'en-US'] WHEN 1 THEN ['de', 'de-DE'] ELSE ['fr'] END AS languages, CASE s_nationkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'female' ELSE 'male' END AS gender FROM supplier)"


def lang_topk(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", catalog.detected(F.col("text")).alias("language"))


COUNTS = """
len(list_filter(w, lambda x: x IN ('der', 'die', 'und', 'den', 'von', 'zu', 'das', 'mit', 'sich', 'ist'))) AS de,
len(list_filter(w, lambda x: x IN ('the', 'of', 'and', 'to', 'that', 'is', 'was', 'for', 'with', 'this'))) AS en,
len(list_filter(w, lambda x: x IN ('el', 'los', 'las', 'del', 'una', 'por', 'con', 'para', 'es', 'como'))) AS es,
len(list_filter(w, lambda x: x IN ('le', 'les', 'des', 'est', 'une', 'dans', 'du', 'pour', 'et', 'sur'))) AS fr"""
LANG_SQL = f"""
SELECT doc_id, CASE WHEN greatest(de, en, es, fr) = 0 THEN 'en' WHEN de = greatest(de, en, es, fr) THEN 'de' WHEN en = greatest(de, en, es, fr) THEN 'en' WHEN es = greatest(de, en, es, fr) THEN 'es' ELSE 'fr' END AS language
FROM (SELECT doc_id, {COUNTS} FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^\\p{{L}}]+') AS w FROM documents))
"""
LEXICON = [
    ("the", 0, "ði", None, None, ["a", "is", "on"], None, 0), ("the", 1, "ðə", None, None, None, None, 0), ("of", 0, "ɒv", ["that"], None, None, None, 0),
    ("of", 1, "əv", None, None, None, ["the"], 0), ("of", 2, "ɔv", None, None, None, None, 0), ("die", 0, "diː", None, None, None, None, 1),
]
LEXICON_TYPE = "word string, candidate int, pronunciation string, preceded_by array<string>, not_preceded_by array<string>, followed_by array<string>, not_followed_by array<string>, priority int"


def lex_lookup(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(split_words(F.col("text"))).alias("n", "word"))
    lexicon = spark.createDataFrame(LEXICON, LEXICON_TYPE)
    return catalog.lexicon_matches(words, lexicon, ["conv_id", "turn"], "n", "word").where("pronunciation is not null").groupBy("conv_id", "turn", "pronunciation").agg(F.count("*").alias("uses"))


LEX_SQL = """
WITH w AS (SELECT conv_id, turn, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS word FROM (SELECT conv_id, turn, regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}]+(?:[''’][\\p{L}\\p{M}\\p{N}]+)*|[^\\s\\p{L}\\p{M}\\p{N}]') AS l FROM conversations)),
a AS (SELECT conv_id, turn, lower(word) AS word, coalesce(lower(lag(word) OVER x), '') AS b, coalesce(lower(lead(word) OVER x), '') AS f FROM w WINDOW x AS (PARTITION BY conv_id, turn ORDER BY n)),
p AS (SELECT conv_id, turn, CASE WHEN word = 'the' THEN CASE WHEN f IN ('a', 'is', 'on') THEN 'ði' ELSE 'ðə' END
  WHEN word = 'of' THEN CASE WHEN b = 'that' THEN 'ɒv' WHEN f <> 'the' THEN 'əv' ELSE 'ɔv' END WHEN word = 'die' THEN 'diː' END AS pronunciation FROM a)
SELECT conv_id, turn, pronunciation, count(*) AS uses FROM p WHERE pronunciation IS NOT NULL GROUP BY conv_id, turn, pronunciation
"""


def deflate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", encodings.deflate_metrics("text").alias("m")).select("doc_id", "m.raw", "m.deflated", "m.ratio")


def murmur_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", encodings.murmur3_text("text").alias("hash"))


def asof(spark, sf_dir):
    """Each event with the latest purchase of its user not after it."""
    e = events(spark, sf_dir).select("user_id", "event_id", "t", "event_type")
    found = tl.nearest_times(e, e.where("event_type = 'purchase'").select("user_id", F.col("t").alias("other")), "user_id", "t", "other")
    return found.select("event_id", "matched")


ASOF_SQL = f"""
WITH e AS (SELECT user_id, event_id, {SECONDS} AS t, event_type FROM events)
SELECT e.event_id, p.t AS matched FROM e ASOF LEFT JOIN (SELECT DISTINCT user_id, t FROM e WHERE event_type = 'purchase') p ON p.user_id = e.user_id AND p.t <= e.t
"""



QUERIES = {
    "timeline_shift": (shift, f"SELECT event_id, round(greatest(start_time + 12.5, 0) + 2e-8, 4) + 0.0 AS start_time, round(greatest(end_time + 12.5, 0) + 2e-8, 4) + 0.0 AS end_time FROM {ENTRIES}"),
    "timeline_scale": (scale, f"SELECT event_id, round(start_time * 1.5 + 2e-8, 4) + 0.0 AS start_time, round(end_time * 1.5 + 2e-8, 4) + 0.0 AS end_time FROM {ENTRIES}"),
    "timeline_round": (rounding, f"SELECT event_id, floor(start_time * 10.0::DOUBLE + 0.5) / 10.0::DOUBLE AS start_time, floor(end_time * 10.0::DOUBLE + 0.5) / 10.0::DOUBLE AS end_time, floor(confidence * 10.0::DOUBLE + 0.5) / 10.0::DOUBLE AS confidence FROM {ENTRIES}"),
    "timeline_extract": (extract, EXTRACT_SQL),
    "timeline_segments": (segments, SEGMENTS_SQL),
    "timeline_overlap_map": (overlap_map, OVERLAP_SQL),
    "timeline_interpolate": (interpolate, INTERPOLATE_SQL),
    "timeline_sentences": (sentences, SENTENCES_SQL),
    "timeline_asof": (asof, ASOF_SQL),
    "cue_extend": (cue_extend, CUE_SQL),
    "path_compact": (path_compact, f"SELECT * FROM {COMPACT}"),
    "path_mapped": (path_mapped, MAPPED_SQL),
    "txt_word_offsets": (word_offsets, OFFSETS_SQL),
    "srt_render": (srt_render, SRT_SQL),
    "srt_parse_roundtrip": (srt_parse, PARSE_SQL),
    "sig_decaying_peak": (decaying_peak, PEAK_SQL),
    "sig_gate": (gate, GATE_SQL),
    "sig_ema_asym": (folded(parts.Smoother(0.4, 0.05)), EMA_SQL),
    "sig_biquad": (folded(parts.Cascade(COEFFICIENTS)), BIQUAD_SQL),
    "sig_loudness": (folded(stateful.loudness(0.3, 0.1)), LOUD_SQL),
    "cfg_flatten": (config, CONFIG_SQL),
    "catalog_voice": (catalog_voice, f"SELECT ord, name, gender FROM {VOICES} WHERE list_contains(languages, 'fr') AND gender IN ('female', 'unknown')"),
    "catalog_best": (catalog_best, f"SELECT ord, name FROM {VOICES} WHERE list_contains(languages, 'de') ORDER BY list_contains(languages, 'de-DE') DESC, ord LIMIT 1"),
    "catalog_languages": (catalog_languages, f"SELECT language, min(ord) AS first FROM (SELECT ord, unnest(languages) AS language FROM {VOICES}) GROUP BY language"),
    "catalog_versions": (catalog_versions, VERSIONS_SQL),
    "lang_topk": (lang_topk, LANG_SQL),
    "lex_lookup": (lex_lookup, LEX_SQL),
    "txt_compress_ratio": (deflate, None),
    "hash_murmur_text": (murmur_text, None),
}


def queries() -> dict:
    return {n: q for n, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in QUERIES.items() if sql}
