"""Language detection by profiles of letter trigrams, learnt from a bounded sample of texts whose language is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_ROWS = 1_000  # bound of the sample that profiles are learnt from
KEPT = 300  # trigrams of a profile
LEAST = 0.05  # a probability under it tells nothing


def trigrams(text: Column) -> Column:
    """The trigrams of a text's different words in lower case, each word with a blank at both ends, repeats included."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1))
    return F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substr(F.concat(F.lit(" "), w, F.lit(" ")), i, F.lit(3)))))


def sampled(df: DataFrame, key: str, text: str, language: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, language) of at most `rows` rows with a known language, those whose key has the least hash."""
    return df.where(F.col(text).isNotNull() & F.col(language).isNotNull()).orderBy(F.md5(F.col(key).cast("string")), key).limit(rows).select(F.col(text).alias("text"), F.col(language).alias("language"))


def profiles(sample: DataFrame, kept: int = KEPT) -> DataFrame:
    """(language, gram, weight): the most frequent trigrams of each language; the first weighs `kept`, the last 1, equal counts go by the gram."""
    counts = sample.select("language", F.explode(trigrams(F.col("text"))).alias("gram")).groupBy("language", "gram").agg(F.count("*").alias("n"))
    order = Window.partitionBy("language").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= kept).select("language", "gram", (kept + 1 - F.col("rank")).alias("weight"))


def language_scores(df: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """(key, language, probability): the share of each language in the weights of a text's trigrams; no row for a language without any.

    Profiles are KEPT rows for each language of a bounded sample, so they are broadcast; weights are summed in each task before anything is
    shuffled, and no text is.
    """
    grams = df.select(key, F.explode(trigrams(F.col(text))).alias("gram"))
    scores = grams.join(F.broadcast(known), "gram").groupBy(key, "language").agg(F.sum("weight").alias("score"))
    return scores.select(key, "language", (F.col("score") / F.sum("score").over(Window.partitionBy(key))).alias("probability"))


def detected(df: DataFrame, key: str, text: str, known: DataFrame, default: str = "en", least: float = LEAST) -> DataFrame:
    """(key, language, probability) of the likeliest language of each key, ties to the first code; the default with 0 where there is none of at least `least`."""
    order = Window.partitionBy(key).orderBy(F.desc("probability"), "language")
    first = language_scores(df, key, text, known).withColumn("place", F.row_number().over(order)).where("place = 1").where(F.col("probability") >= least)
    found = df.select(key).distinct().join(first.select(F.col(key).alias("of"), "language", "probability"), F.col(key).eqNullSafe(F.col("of")), "left")
    return found.select(key, F.coalesce("language", F.lit(default)).alias("language"), F.coalesce("probability", F.lit(0.0)).alias("probability"))
