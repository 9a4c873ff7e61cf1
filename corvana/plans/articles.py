"""Queries of languages by profiles and of pages by section, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvana.functions import sections as sec
from corvana.operators import languages
from corvana.session import table

SAMPLE, KEPT = 300, 200


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, by profiles of 300 others."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    known = languages.profiles(languages.sampled(docs, "doc_id", "text", "lang", SAMPLE), KEPT)
    return languages.detected(docs, "doc_id", "text", known).select("doc_id", "language", F.round("probability", 9).alias("probability"))


GRAMS = "flatten(list_transform(list_distinct(regexp_extract_all(lower(text), '\\p{L}+')), lambda w: list_transform(range(1, length(w) + 1), lambda i: (' ' || w || ' ')[i:i + 2])))"
DETECTED_SQL = f"""
WITH sample AS (
  SELECT lang, {GRAMS} AS g FROM (SELECT * FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT {SAMPLE})
), profile AS (
  SELECT lang, gram, {KEPT + 1} - row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS weight FROM (SELECT lang, gram, count(*) AS n FROM (SELECT lang, unnest(g) AS gram FROM sample) GROUP BY lang, gram)
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) <= {KEPT}
), scores AS (
  SELECT doc_id, p.lang, sum(weight) AS score FROM (SELECT doc_id, unnest({GRAMS}) AS gram FROM documents) d JOIN profile p USING (gram) GROUP BY doc_id, p.lang
), shares AS (
  SELECT doc_id, lang, score / sum(score) OVER (PARTITION BY doc_id) AS probability FROM scores
), best AS (
  SELECT * FROM shares QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY probability DESC, lang) = 1
)
SELECT d.doc_id, coalesce(b.lang, 'en') AS language, round(coalesce(b.probability, 0), 9) AS probability FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id AND b.probability >= {languages.LEAST}
"""


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.explode(sec.sections(F.col("html"))).alias("s"))
    return pages.select("page_id", "s.section", "s.level", "s.title", "s.parent", F.array_join("s.path", " > ").alias("path"), F.md5("s.text").alias("text"), F.length("s.text").alias("n_chars"))


def plain_sql(x: str) -> str:
    x = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for name, sign in sec.REFERENCES.items():
        x = f"replace({x}, '{name}', '{sign.replace(chr(39), chr(39) * 2)}')"
    white = "[\\s\\v\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+"
    return f"regexp_replace(regexp_replace({x}, '{white}', ' ', 'g'), '^ | $', '', 'g')"


END = "(?is)^<h[1-6][\\s>].*?</h[1-6]\\s*>"
SECTIONS_SQL = f"""
WITH RECURSIVE pieces AS (
  SELECT page_id, string_split(regexp_replace(regexp_replace(replace(html, chr(1), ' '), '{sec.HIDDEN}', ' ', 'g'), '{sec.HEADING}', chr(1) || '\\1', 'g'), chr(1)) AS p FROM pages
), one AS (
  SELECT page_id, unnest(p) AS piece, unnest(range(0, len(p))) AS section FROM pieces
), told AS (
  SELECT page_id, section, CASE WHEN section = 0 THEN 0 ELSE CAST(piece[3] AS INTEGER) END AS level, CASE WHEN section = 0 THEN '' ELSE {plain_sql(f"CASE WHEN regexp_matches(piece, '{END}') THEN regexp_extract(piece, '{END}') ELSE piece END")} END AS title,
    CASE WHEN section > 0 AND NOT regexp_matches(piece, '{END}') THEN '' ELSE {plain_sql(f"regexp_replace(piece, '{END}', ' ')")} END AS text FROM one
), parents AS (
  SELECT a.page_id, a.section, a.level, a.title, a.text, coalesce(max(b.section), -1) AS parent FROM told a LEFT JOIN told b ON b.page_id = a.page_id AND b.section < a.section AND b.level < a.level GROUP BY ALL
), climbed AS (
  SELECT page_id, section, parent AS above, title AS path FROM parents
  UNION ALL
  SELECT c.page_id, c.section, p.parent, p.title || ' > ' || c.path FROM climbed c JOIN parents p ON p.page_id = c.page_id AND p.section = c.above WHERE c.above > 0
)
SELECT page_id, CAST(section AS INTEGER) AS section, level, title, CAST(parent AS INTEGER) AS parent, path, md5(text) AS text, CAST(length(text) AS INTEGER) AS n_chars FROM parents JOIN climbed USING (page_id, section) WHERE above <= 0
"""

QUERIES = {"lang_profiles": (detected, DETECTED_SQL), "page_sections": (sections, SECTIONS_SQL)}


def queries() -> dict:
    return {n: q for n, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in QUERIES.items()}
