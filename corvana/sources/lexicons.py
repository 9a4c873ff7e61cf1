"""Pronunciation lexicons in JSON as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "array<string>"
ENTRY = f"struct<pos:{WORDS},case:string,pronunciation:struct<espeak:map<string,string>,sapi:map<string,string>>,precededBy:{WORDS},notPrecededBy:{WORDS},followedBy:{WORDS},notFollowedBy:{WORDS},succeededBy:{WORDS},notSucceededBy:{WORDS}>"


def lexicon_entries(files: DataFrame, language: str, dialect: str | None = None, alphabet: str = "espeak") -> DataFrame:
    """(word, candidate, pronunciation, preceded_by, not_preceded_by, followed_by, not_followed_by, priority) of lexicon files, for catalog.lexicon_matches().

    files: (priority, json); of several files that of the highest priority wins. A file maps language codes to
    words and these to one entry or a list of them; candidates are numbered in a list's order. The
    pronunciation is that of the dialect, else of the language itself. The older names of the two following lists are read as
    well. Entries without a pronunciation in the alphabet give no row.
    """
    words = files.select("priority", F.explode(F.from_json("json", "map<string,map<string,string>>")).alias("code", "words")).where(F.col("code") == language)
    entries = words.select("priority", F.explode("words").alias("word", "entry")).select("priority", "word", F.posexplode(F.from_json("entry", f"array<{ENTRY}>")).alias("candidate", "e"))
    said = F.col(f"e.pronunciation.{alphabet}")
    pronunciation = F.coalesce(said[dialect], said[language]) if dialect else said[language]
    return entries.select(
        F.lower("word").alias("word"), "candidate", pronunciation.alias("pronunciation"), F.col("e.precededBy").alias("preceded_by"), F.col("e.notPrecededBy").alias("not_preceded_by"),
        F.coalesce("e.followedBy", "e.succeededBy").alias("followed_by"), F.coalesce("e.notFollowedBy", "e.notSucceededBy").alias("not_followed_by"), "priority",
    ).where("pronunciation is not null")


def read_lexicons(spark: SparkSession, paths: list[str], language: str, dialect: str | None = None, alphabet: str = "espeak") -> DataFrame:
    """lexicon_entries() of the files at these paths, the last of which wins."""
    files = None
    for n, path in enumerate(paths):
        one = spark.read.text(path, wholetext=True).select(F.lit(n).alias("priority"), F.col("value").alias("json"))
        files = one if files is None else files.unionByName(one)
    if files is None:
        raise ValueError("no lexicon is named")
    return lexicon_entries(files, language, dialect, alphabet)
