"""Queries over a catalogue of voices, contextual lexicon lookup, and language choice by evidence."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvana.functions.texts import DEFAULT_DIALECTS, short_language_code
from corvana.functions.vectors import let

# Frequent words of four languages.
EVIDENCE = {
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "ist"], "en": ["the", "of", "and", "to", "that", "is", "was", "for", "with", "this"],
    "es": ["el", "los", "las", "del", "una", "por", "con", "para", "es", "como"], "fr": ["le", "les", "des", "est", "une", "dans", "du", "pour", "et", "sur"],
}


def voices(df: DataFrame, language: str | None = None, gender: str | None = None, name: str | None = None) -> DataFrame:
    """Voices (name, languages, gender, ...) of a language, gender and name pattern.

    If none has a language code with a dash, its short code is asked for; an unknown gender always
    passes; a pattern of several words may stand anywhere in a name, one word begins a word of it.
    """
    found = df
    if language:
        exact = F.array_contains("languages", language)
        short = language.split("-")[0].lower()
        if "-" in language:
            anywhere = df.agg(F.coalesce(F.bool_or(exact), F.lit(False)).alias("any")).withColumnRenamed("any", "has_exact")
            found = found.crossJoin(F.broadcast(anywhere)).where(F.when(F.col("has_exact"), exact).otherwise(F.array_contains("languages", short))).drop("has_exact")  # a single row is broadcast
        else:
            found = found.where(exact)
    if gender:
        found = found.where((F.col("gender") == gender) | (F.col("gender") == "unknown") | F.col("gender").isNull())
    if name:
        pattern = name.strip().lower()
        anywhere = len(re.findall(r"\w+", pattern)) > 1
        low = F.lower("name")
        found = found.where(low.contains(pattern) if anywhere else low.rlike(rf"(^|\W){re.escape(pattern)}"))
    return found


def best_voice(df: DataFrame, language: str | None = None, order: str = "ord") -> DataFrame:
    """The first voice, or the first that speaks the language's default dialect."""
    dialect = DEFAULT_DIALECTS.get(language or "", language or "")
    return df.withColumn("default", F.array_contains("languages", dialect)).orderBy(F.desc("default"), order).limit(1).drop("default")


def voice_languages(df: DataFrame, order: str = "ord") -> DataFrame:
    """Distinct language codes with the place of the first voice that has each."""
    return df.select(order, F.explode("languages").alias("language")).groupBy("language").agg(F.min(order).alias("first"))


VERSION = r"^.*-([0-9]{8}(?:_[0-9]+)?)$"


def version_tag(name: Column) -> Column:
    """The date, and the number after it if any, at the end of a package's name; null if it has none."""
    return F.when(name.rlike(VERSION), F.regexp_extract(name, VERSION, 1))


def versioned(name: Column, tags: dict[str, str], default: str) -> Column:
    """A package's name with its version: its own, the listed one or the default."""
    listed = F.create_map(*[F.lit(x) for pair in tags.items() for x in pair])[name] if tags else F.lit(None).cast("string")
    return F.when(version_tag(name).isNotNull(), name).otherwise(F.concat(name, F.lit("-"), F.coalesce(listed, F.lit(default))))


def lexicon_matches(words: DataFrame, lexicon: DataFrame, key: list[str], order: str, word: str) -> DataFrame:
    """words with the pronunciation that a contextual lexicon gives.

    lexicon: (word, candidate, pronunciation, preceded_by, not_preceded_by, followed_by,
    not_followed_by, priority). Of the highest priority's candidates the first whose context holds
    wins, else its last. Words without an entry have a null pronunciation.
    """
    by = Window.partitionBy(*key).orderBy(order)
    around = words.withColumns({"before": F.lower(F.lag(word).over(by)), "after": F.lower(F.lead(word).over(by)), "low": F.lower(word)})
    entries = lexicon.withColumnRenamed("word", "low")
    joined = around.join(entries, "low", "left")
    has = lambda wanted, c: F.col(wanted).isNull() | F.array_contains(wanted, F.coalesce(c, F.lit("")))
    lacks = lambda banned, c: F.col(banned).isNull() | ~F.array_contains(banned, F.coalesce(c, F.lit("")))
    fits = has("preceded_by", F.col("before")) & lacks("not_preceded_by", F.col("before")) & has("followed_by", F.col("after")) & lacks("not_followed_by", F.col("after"))
    rank = F.struct((-F.coalesce("priority", F.lit(0))).alias("p"), F.when(fits, F.col("candidate")).otherwise(1_000_000 - F.coalesce("candidate", F.lit(0))).alias("c"))
    return joined.groupBy(*key, order).agg(F.first(word).alias(word), F.min_by("pronunciation", rank).alias("pronunciation"))


def language_scores(text: Column) -> Column:
    """(language, probability) by each language's share of the frequent words found, likeliest first."""
    words = F.split(F.lower(text), r"[^\p{L}]+")

    def hits(found: Column, own: list[str]) -> Column:
        return F.size(F.filter(found, lambda w: w.isin(own)))

    def scored(counts: Column) -> Column:
        total = F.aggregate(counts, F.lit(0), lambda a, n: a + n)
        names = F.array(*map(F.lit, EVIDENCE))
        rows = F.zip_with(counts, names, lambda n, lang: F.struct((-F.when(total == 0, 0.0).otherwise(n / F.when(total != 0, total))).alias("p"), lang.alias("language")))
        return F.transform(F.array_sort(rows), lambda s: F.struct(s["language"].alias("language"), (-s["p"]).alias("probability")))

    return let(let(words, lambda w: F.array(*[hits(w, own) for own in EVIDENCE.values()])), scored)


def detected(text: Column, least: float = 0.05, default: str = "en") -> Column:
    top = F.get(language_scores(text), F.lit(0))
    return F.when(top["probability"] >= least, top["language"]).otherwise(default)


def supports(language: Column, listed: list[str]) -> Column:
    return short_language_code(language).isin(listed)
