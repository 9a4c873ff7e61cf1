"""Event streams of speech engines to timelines. Input order is a column; each key's events stay together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TICKS = 1e7  # in a second

def word_boundaries(events: DataFrame, kind: str = "WordBoundary") -> DataFrame:
    """Word events with ticks as seconds: start_time and end_time."""
    return events.where(F.col("kind") == kind).withColumns({"start_time": F.col("offset_ticks") / TICKS, "end_time": (F.col("offset_ticks") + F.col("duration_ticks")) / TICKS})


def words_with_phones(events: DataFrame, key: str, order: str, total: str) -> DataFrame:
    """Words of an ordered stream of word and phone events: a word ends where the next begins, the last at the total, or with its last phone if later.

    Phones before any word belong to none and are left out.
    """
    by = Window.partitionBy(key).orderBy(order)
    marked = events.withColumn("word_no", F.sum((F.col("kind") == "word").cast("int")).over(by)).where("word_no > 0")
    phones = F.filter(F.transform(F.array_sort(F.collect_list(F.struct(order, "kind", "text"))), lambda s: F.when(s["kind"] == "phone", s["text"])), lambda p: p.isNotNull())  # bounded by a word
    words = marked.groupBy(key, "word_no").agg(F.first(F.when(F.col("kind") == "word", F.col("text")), ignorenulls=True).alias("word"), F.min("time").alias("start_time"), F.max("time").alias("last"), phones.alias("phones"), F.first(total).alias("total"))
    following = F.lead("start_time").over(Window.partitionBy(key).orderBy("word_no"))
    return words.withColumn("end_time", F.greatest("last", F.coalesce(following, F.col("total")))).drop("last", "total")


def trace_events(df: DataFrame, key: str, trace: str) -> DataFrame:
    """(key, n, name, start_time, end_time) of blank-separated name:seconds tokens; an event starts where the one before ended."""
    tokens = df.select(key, F.posexplode(F.filter(F.split(trace, r"\s+"), lambda t: t.contains(":"))).alias("n", "token"))
    by = Window.partitionBy(key).orderBy("n")
    ended = tokens.withColumn("end_time", F.substring_index("token", ":", -1).cast("double"))
    return ended.select(key, "n", F.regexp_replace("token", ":[^:]*$", "").alias("name"), F.coalesce(F.lag("end_time").over(by), F.lit(0.0)).alias("start_time"), "end_time")


LOG_LINE = r"^\[(\d+):(\d+):(\d+)\.(\d+)\s*-->\s*(\d+):(\d+):(\d+)\.(\d+)\](.*)$"


def logged_entries(df: DataFrame, key: str, lines: str) -> DataFrame:
    """(key, entry, text, start_time, end_time) of bracketed time ranges; a text without a leading blank continues the entry before."""
    rows = df.select(key, F.posexplode(lines).alias("n", "line")).where(F.col("line").rlike(LOG_LINE))
    part = lambda n: F.regexp_extract("line", LOG_LINE, n).cast("double")
    at = lambda n: part(n) * 3600 + part(n + 1) * 60 + part(n + 2) + part(n + 3) / 1000
    text = F.regexp_extract("line", LOG_LINE, 9)
    after = F.regexp_replace(text, r"^ {2}", " ")
    by = Window.partitionBy(key).orderBy("n")
    begins = F.when(F.row_number().over(by) == 1, 0).otherwise(after.startswith(" ").cast("int"))
    marked = rows.withColumns({"text": after, "s": at(1), "e": at(5)}).withColumn("entry", F.sum(begins).over(by))
    joined = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda s: s["text"]), ""))
    return marked.groupBy(key, "entry").agg(joined.alias("text"), F.min("s").alias("start_time"), F.max("e").alias("end_time"))


def path_to_tokens(path: DataFrame, key: str, start: str, end: str, frame: float = 0.02) -> DataFrame:
    """Times of tokens from a path (source: token, dest: frame): a token starts at its first frame and ends where the next starts, the last at the end."""
    firsts = path.groupBy(key, "source").agg(F.min("dest").alias("dest"), F.first(start).alias("a"), F.first(end).alias("b"))
    at = firsts.withColumn("start_time", F.greatest(F.col("a"), F.col("a") + F.col("dest") * frame))
    following = F.lead("start_time").over(Window.partitionBy(key).orderBy("source"))
    return at.withColumn("end_time", F.coalesce(following, F.col("b"))).select(key, "source", "start_time", "end_time")


def greedy_words(frames: DataFrame, key: str, order: str, token: str, seconds: float, blank: str = "_", gap: str = " ", again: str = "2") -> DataFrame:
    """Words of a frame-wise best token stream: repeats collapse, blanks drop, a mark doubles the letter before, gaps part words."""
    by = Window.partitionBy(key).orderBy(order)
    fresh = frames.withColumn("before", F.lag(token).over(by)).where((F.col("before").isNull() | (F.col("before") != F.col(token))) & (F.col(token) != blank))
    letters = fresh.withColumn("letter", F.when(F.col(token) == again, F.last(F.when(~F.col(token).isin(again, gap), F.col(token)), ignorenulls=True).over(by)).otherwise(F.col(token)))
    marked = letters.withColumn("word_no", F.sum((F.col(token) == gap).cast("int")).over(by)).where(F.col(token) != gap)
    word = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "letter"))), lambda s: s["letter"]), "")
    return marked.groupBy(key, "word_no").agg(word.alias("word"), (F.min(order) * seconds).alias("start_time"), ((F.max(order) + 1) * seconds).alias("end_time"))


def phrases_to_sentences(phrases: DataFrame, key: str, order: str, breaker: str) -> DataFrame:
    """Phrases numbered by sentence: a full stop, question or exclamation mark ends one."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return phrases.withColumn("sentence", F.coalesce(F.sum(F.col(breaker).isin(".", "?", "!").cast("int")).over(before), F.lit(0)))


def token_kind(token: Column, end_of_text: int, first_language: int, languages: int, first_timestamp: int) -> Column:
    """text, language, timestamp or special, by the ranges of token ids."""
    return F.when(token < end_of_text, "text").when(token >= first_timestamp, "timestamp").when(token.between(first_language, first_language + languages - 1), "language").otherwise("special")


def suppressed_tokens(vocabulary: DataFrame, allowed: list[str], token: str = "token") -> DataFrame:
    """Tokens without letters or digits that aren't allowed punctuation."""
    return vocabulary.where(~F.col(token).rlike(r"[\p{L}\p{N}]") & ~F.trim(F.col(token)).isin(allowed))


TOKEN = "struct<id:int,text:string,p:double,t_dtw:long,offsets:struct<`from`:long,`to`:long>>"
RESULT = f"struct<result:struct<language:string>,transcription:array<struct<offsets:struct<`from`:long,`to`:long>,tokens:array<{TOKEN}>>>>"
BEGIN = "[_BEG_]"


def result_tokens(df: DataFrame, key: str, json: str, total: str | None = None) -> DataFrame:
    """(key, language, segment, token, id, text, start_time, end_time, confidence) of recognisers' results in JSON, in seconds.

    Offsets are milliseconds. A token without offsets stands at the end of the last one before it that has any, also
    across segments, at 0 if none has. Where a segment opens with a begin mark at offset 0, its tokens and those
    of all segments after it, up to the next such, are moved by the segment's own start. total: a column with the whole duration; if it is given, tokens start at their aligned
    hundredths of a second instead, at 0 if these are negative, and end where the next token of the segment starts, the last at the total.
    Null or broken JSON has no tokens.
    """
    kept = [F.col(total).cast("double").alias("total")] if total else []
    parsed = df.select(key, *kept, F.from_json(F.col(json), RESULT).alias("r")).where("r is not null")
    segments = parsed.select(key, *(["total"] if total else []), F.col("r.result.language").alias("language"), F.posexplode("r.transcription").alias("segment", "s"))
    tokens = segments.select("*", F.posexplode("s.tokens").alias("token", "t"))
    by = Window.partitionBy(key).orderBy("segment", "token").rowsBetween(Window.unboundedPreceding, 0)  # one result's tokens: they came in one row
    known = F.coalesce(F.last("t.offsets.to", ignorenulls=True).over(by), F.lit(0))
    offset = lambda c: F.when(F.col("t.offsets").isNull(), known).otherwise(F.col(f"t.offsets.{c}"))
    opens = (F.col("token") == 0) & (F.col("t.text") == BEGIN) & (offset("from") == 0)
    shift = F.coalesce(F.last(F.when(opens, F.col("s.offsets.from") / 1000), ignorenulls=True).over(by), F.lit(0.0))
    if total:
        following = F.lead("t.t_dtw").over(Window.partitionBy(key, "segment").orderBy("token"))
        start, end = F.greatest(F.col("t.t_dtw") / 100, F.lit(0.0)), F.coalesce(following / 100, F.col("total"))
    else:
        start, end = offset("from") / 1000, offset("to") / 1000
    return tokens.select(key, "language", "segment", "token", F.col("t.id").alias("id"), F.col("t.text").alias("text"), (start + shift).alias("start_time"), (end + shift).alias("end_time"), F.col("t.p").alias("confidence"))


def result_timeline(tokens: DataFrame, key: str) -> DataFrame:
    """(key, segment, word, text, start_time, end_time, confidence, tokens) of result_tokens(): words of their visible tokens.

    A token that begins with a blank opens a word, as does the first of a segment; marks in square brackets are left
    out. A word's confidence is its tokens' mean; tokens: their structs in order.
    """
    visible = tokens.where(~F.col("text").rlike(r"^\[_.*\]$"))
    by = Window.partitionBy(key, "segment").orderBy("token")
    opens = (F.row_number().over(by) == 1) | F.col("text").rlike(r"^\s")
    words = visible.withColumn("opens", opens.cast("int")).withColumn("word", F.sum("opens").over(by) - 1)
    held = F.array_sort(F.collect_list(F.struct("token", "id", "text", "start_time", "end_time", "confidence")))  # bounded by a word
    found = words.groupBy(key, "segment", "word").agg(held.alias("tokens"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.avg("confidence").alias("confidence"))
    text = F.trim(F.array_join(F.transform("tokens", lambda t: t["text"]), ""))
    return found.select(key, "segment", "word", text.alias("text"), "start_time", "end_time", "confidence", "tokens")
