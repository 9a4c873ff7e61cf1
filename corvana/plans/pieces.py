"""Queries of texts in fragments, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvana.functions import fragments as f
from corvana.functions.texts import CURRENCIES, masked_enders
from corvana.session import table
from corvana.sources.lexicons import lexicon_entries

MOST = 90


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, each followed by a sentence with years, decades, ranges and amounts of its own."""
    n = F.col("doc_id")
    number = lambda least, span: (F.lit(least) + n % span).cast("string")
    sentence = F.concat(
        F.lit(" In "), number(1000, 1100), F.lit(" or the "), number(100, 110), F.lit("0s, "), number(1800, 99), F.lit("-"), number(1900, 120), F.lit("-"), number(2001, 9),
        F.lit(" since "), number(1700, 77), F.lit("–"), number(1800, 55), F.lit(": $"), number(1, 900), F.lit(".5 million, "), number(1, 50), F.lit("€ and £"), number(3, 40), F.lit(" for a "), number(1, 9999),
    )
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat("text", sentence).alias("text"))


SPOKEN = """(SELECT doc_id, lang, text || ' In ' || (1000 + doc_id % 1100) || ' or the ' || (100 + doc_id % 110) || '0s, ' || (1800 + doc_id % 99) || '-' || (1900 + doc_id % 120) || '-' || (2001 + doc_id % 9)
  || ' since ' || (1700 + doc_id % 77) || '–' || (1800 + doc_id % 55) || ': $' || (1 + doc_id % 900) || '.5 million, ' || (1 + doc_id % 50) || '€ and £' || (3 + doc_id % 40) || ' for a ' || (1 + doc_id % 9999) AS text FROM documents)"""


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spoken(spark, sf_dir).withColumn("f", f.normalized_fragments(f.spoken_words(F.col("text")), F.col("lang")))
    return found.select("doc_id", F.size("f").alias("n"), *[F.md5(F.array_join(F.col(f"f.{c}").cast("array<string>"), "|")).alias(c) for c in ("normalized", "reference", "first")])


YEAR = "CASE WHEN {0}[3] <> '0' AND {0}[1:2] <> '00' THEN {0}[1:2] || ' ' || {0}[3:4] WHEN {0}[2] <> '0' AND {0}[3] = '0' AND {0}[4] <> '0' THEN {0}[1:2] || ' oh ' || {0}[4] ELSE {0} END"
DECADE = "CASE WHEN {0}[3:4] <> '00' THEN {0}[1:2] || ' ' || {0}[3:4] || 's' WHEN {0}[2] <> '0' THEN {0}[1:2] || ' hundreds' ELSE {0} END"
NAMES = "map {" + ", ".join(f"'{sign}': '{name}'" for sign, name in CURRENCIES.items()) + "}"
listed = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
NORMALIZED_SQL = f"""
WITH words AS (
  SELECT doc_id, lang, unnest(w) AS w, unnest(range(0, len(w))) AS i FROM (SELECT doc_id, lang, regexp_extract_all(text, '{f.SPOKEN_WORD.replace("'", "''")}') AS w FROM {SPOKEN})
), visible AS (
  SELECT *, lead(w, 1, '') OVER o AS next, lead(w, 2, '') OVER o AS third, coalesce(regexp_full_match(lead(w) OVER o, '\\s+'), false) AS spaced FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT doc_id, lang, w, spaced, next, third, row_number() OVER o - 1 AS n, lead(w, 1, '') OVER o AS after, lead(w, 2, '') OVER o AS behind
  FROM visible WHERE NOT regexp_full_match(w, '\\s+') WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), fits AS (
  SELECT *, CASE WHEN lang <> 'en' THEN '' WHEN lower(w) IN {listed(f.YEAR_CUES)} AND spaced AND regexp_matches(after, '^[0-9]{{4}}$') THEN 'year'
      WHEN lower(w) IN {listed(f.DECADE_CUES)} AND spaced AND regexp_matches(after, '^[0-9]{{3}}0s$') THEN 'decade'
      WHEN regexp_full_match(w || next || third, '[0-9]{{4}}[-–][0-9]{{4}}') THEN 'range'
      WHEN regexp_full_match(w, '[{f.SIGNS}][0-9][0-9,.]*') THEN CASE WHEN lower(after) IN {listed(f.SCALES)} THEN 'scaled' ELSE 'before' END
      WHEN regexp_full_match(w, '[0-9][0-9,.]*[{f.SIGNS}]') THEN 'behind' ELSE '' END AS kind
  FROM numbered
), free AS (
  SELECT *, kind = 'range' AND coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY n), '') <> 'year' AS ranges FROM fits
), chains AS (
  SELECT *, n - 2 * row_number() OVER (PARTITION BY doc_id, n % 2 ORDER BY n) AS chain FROM free WHERE ranges
), kept AS (
  SELECT doc_id, n FROM (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id, n % 2, chain ORDER BY n) AS place FROM chains) WHERE place % 2 = 1
), told AS (
  SELECT t.*, CASE WHEN t.kind = 'range' THEN CASE WHEN k.n IS NULL THEN '' ELSE 'range' END ELSE t.kind END AS rule FROM free t LEFT JOIN kept k ON k.doc_id = t.doc_id AND k.n = t.n
), around AS (
  SELECT *, lag(rule, 1, '') OVER o AS one, lag(rule, 2, '') OVER o AS two FROM told WINDOW o AS (PARTITION BY doc_id ORDER BY n)
), said AS (
  SELECT doc_id, n, CASE WHEN rule = 'scaled' THEN w || ' ' || after ELSE w END AS reference,
    CASE WHEN one = 'year' OR rule = 'range' OR two = 'range' THEN {YEAR.format('w')} WHEN one = 'decade' THEN {DECADE.format('w')} WHEN one = 'range' THEN 'to'
      WHEN rule = 'scaled' THEN w[2:] || ' ' || after || ' ' || {NAMES}[w[1]] WHEN rule = 'before' THEN w[2:] || ' ' || {NAMES}[w[1]] WHEN rule = 'behind' THEN w[:-2] || ' ' || {NAMES}[w[-1]] ELSE w END AS normalized
  FROM around WHERE one <> 'scaled'
)
SELECT d.doc_id, CAST(count(n) AS INTEGER) AS n, md5(coalesce(string_agg(normalized, '|' ORDER BY n), '')) AS normalized, md5(coalesce(string_agg(reference, '|' ORDER BY n), '')) AS reference, md5(coalesce(string_agg(n::VARCHAR, '|' ORDER BY n), '')) AS first
FROM documents d LEFT JOIN said USING (doc_id) GROUP BY d.doc_id
"""


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("f", f.fragments(F.col("text"), MOST))
    return docs.select("doc_id", F.size("f").alias("n"), F.array_max(F.transform("f", lambda x: F.length(x["text"]))).alias("longest"), F.md5(F.array_join(F.transform("f", lambda x: x["text"]), "|")).alias("pieces"), F.md5(F.array_join(F.transform("f", f.last_segment), "|")).alias("lasts"))


# Each word with the length of the phrase and of the sentence that it begins (0 elsewhere); a fold over them.
CUT = "list_filter(string_split(regexp_replace({0}, '({1})', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"
SENTENCE_END = r"[。？！]+|[.?!…]+[\"''”’)\]]*\s+"
PHRASE_END = r"[、，،；：]+\s*|[,;:—]+\s+"
WORDS = r"[\p{L}\p{M}\p{N}]+(?:[''’][\p{L}\p{M}\p{N}]+)*|\s+|[^\s\p{L}\p{M}\p{N}]"
S_FITS, P_FITS = f"x[3] > 0 AND a[2] + x[3] <= {MOST}", f"x[2] > 0 AND (CASE WHEN x[3] > 0 THEN 0 ELSE a[2] END) + x[2] <= {MOST}"
PASSED = "x[3] = 0 AND (a[3] = 1 OR (x[2] = 0 AND a[3] = 2))"
ALONE = "CASE WHEN x[2] > 0 THEN 0 ELSE a[2] END"
USED = f"CASE WHEN {PASSED} THEN a[2] WHEN {S_FITS} THEN a[2] + x[3] WHEN x[3] > 0 AND x[3] <= {MOST} THEN x[3] WHEN {P_FITS} THEN (CASE WHEN x[3] > 0 THEN 0 ELSE a[2] END) + x[2] WHEN x[2] > 0 AND x[2] <= {MOST} THEN x[2] WHEN {ALONE} + x[1] <= {MOST} THEN {ALONE} + x[1] ELSE x[1] END"
SKIP = f"CASE WHEN {PASSED} THEN a[3] WHEN x[3] > 0 AND x[3] <= {MOST} THEN 1 WHEN x[2] > 0 AND x[2] <= {MOST} THEN 2 ELSE 0 END"
OPENS = f"a[2] > 0 AND NOT ({PASSED}) AND NOT ({S_FITS}) AND (x[3] > 0 OR (x[2] > 0 AND NOT ({P_FITS})) OR (x[2] = 0 AND a[2] + x[1] > {MOST}))"
FOLD = f"list_concat([a[1] + x[1], {USED}, {SKIP}, CASE WHEN {PASSED} THEN a[4] ELSE a[1] END], CASE WHEN {OPENS} THEN list_concat(a[5:], [a[1], a[4]]) ELSE a[5:] END)"
SPLIT_SQL = f"""
WITH words AS (
  SELECT doc_id, text, flatten(list_transform({CUT.format('text', SENTENCE_END)}, lambda s: flatten(list_transform({CUT.format('s', PHRASE_END)}, lambda p, j: list_transform(regexp_extract_all(p, '{WORDS}'), lambda w, k: [length(w), CASE WHEN k = 1 THEN length(p) ELSE 0 END, CASE WHEN k = 1 AND j = 1 THEN length(s) ELSE 0 END]))))) AS w
  FROM documents
), folded AS (
  SELECT doc_id, text, list_reduce(list_prepend([0::BIGINT, 0, 0, 0], w), lambda a, x: {FOLD}) AS a FROM words
), ends AS (
  SELECT doc_id, text, CASE WHEN a[1] > 0 THEN list_concat(a[5:], [a[1], a[4]]) ELSE [] END AS e FROM folded
), pieces AS (
  SELECT doc_id, list_transform(range(0, len(e) // 2), lambda n: text[(CASE WHEN n = 0 THEN 0 ELSE e[2 * n - 1] END) + 1:e[2 * n + 1]]) AS f, list_transform(range(0, len(e) // 2), lambda n: text[e[2 * n + 2] + 1:e[2 * n + 1]]) AS l FROM ends
)
SELECT doc_id, CAST(len(f) AS INTEGER) AS n, CAST(list_max(list_transform(f, lambda x: length(x))) AS INTEGER) AS longest, md5(array_to_string(f, '|')) AS pieces, md5(array_to_string(l, '|')) AS lasts FROM pieces
"""

def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", masked_enders(F.col("text")).alias("m"))
    return docs.select("doc_id", F.md5("m").alias("masked"))


MASKED_SQL = """
SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(text, '\\s+|\\S+'), lambda w: CASE WHEN regexp_matches(w, '[\\p{L}\\p{N}]') THEN regexp_replace(w[:-2], '[.。?？!！|]', '_', 'g') || w[-1:] ELSE w END), '')) AS masked FROM documents
"""


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon in JSON made of the parts' names, as a table: some words have one entry, some two, in two files."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("w"), F.col("p_partkey") % 400).alias("w"), F.col("p_partkey") % 3 == 0)
    part = part.toDF("n", "w", "two")
    entry = lambda tail: F.struct(F.struct(F.create_map(F.lit("en-us"), F.concat("w", F.lit(tail))).alias("espeak")).alias("pronunciation"), F.array(F.lit("the")).alias("precededBy"), F.array(F.lit("of")).alias("notSucceededBy"))
    text = F.when(F.col("two"), F.to_json(F.array(entry(" a"), entry(" b")))).otherwise(F.to_json(entry(" c")))
    words = part.groupBy((F.col("n") % 2).cast("int").alias("priority"), "w").agg(F.max_by(text, "n").alias("t"))  # a word has one value in a file
    body = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), "w", F.lit('":'), "t"))), ",")
    files = words.groupBy("priority").agg(F.concat(F.lit('{"de":{"x":{}},"en":{'), body, F.lit("}}")).alias("json"))
    found = lexicon_entries(files, "en", "en-us")
    return found.select("word", "candidate", "pronunciation", F.array_join("preceded_by", ",").alias("preceded"), F.array_join("not_followed_by", ",").alias("banned"), "priority")


LEXICON_SQL = """
WITH words AS (
  SELECT CAST(p_partkey % 2 AS INTEGER) AS priority, 'w' || (p_partkey % 400) AS word, arg_max(p_partkey % 3 = 0, p_partkey) AS two FROM part GROUP BY ALL
)
SELECT word, CAST(n AS INTEGER) AS candidate, word || ' ' || CASE WHEN NOT two THEN 'c' WHEN n = 0 THEN 'a' ELSE 'b' END AS pronunciation, 'the' AS preceded, 'of' AS banned, priority FROM words, (VALUES (0), (1)) AS t(n) WHERE n = 0 OR two
"""

QUERIES = {"txt_masked": (masked, MASKED_SQL), "lex_file": (lexicon, LEXICON_SQL), "txt_normalized": (normalized, NORMALIZED_SQL), "txt_fragments": (split, SPLIT_SQL)}


def queries() -> dict:
    return {n: q for n, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in QUERIES.items()}
