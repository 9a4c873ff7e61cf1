"""Subtitle texts to cues and back, with column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvana.functions.encodings import unescape_html
from corvana.functions.texts import collapse, trim
from corvana.functions.times import format_hms, format_ms

WITH_HOURS = r"^(\d+):(\d+):(\d+)[.,](\d+)\s*-->\s*(\d+):(\d+):(\d+)[.,](\d+)"
WITHOUT_HOURS = r"^(\d+):(\d+)[.,](\d+)\s*-->\s*(\d+):(\d+)[.,](\d+)"


def time_range(line: Column) -> Column:
    """(start_time, end_time) of a cue's line of times, hours or none; null for other lines. The last group counts thousandths."""
    part = lambda pattern, n: F.regexp_extract(line, pattern, n).cast("double")
    h = lambda n: part(WITH_HOURS, n) * 3600 + part(WITH_HOURS, n + 1) * 60 + part(WITH_HOURS, n + 2) + part(WITH_HOURS, n + 3) / 1000
    m = lambda n: part(WITHOUT_HOURS, n) * 60 + part(WITHOUT_HOURS, n + 1) + part(WITHOUT_HOURS, n + 2) / 1000
    both = lambda f, second: F.struct(f(1).alias("start_time"), f(second).alias("end_time"))
    return F.when(line.rlike(WITH_HOURS), both(h, 5)).when(line.rlike(WITHOUT_HOURS), both(m, 4))


def without_markup(s: Column) -> Column:
    return trim(collapse(unescape_html(F.regexp_replace(s, "<[^>]*>", ""))))


def cues(df: DataFrame, key: str, text: str, markup: bool = False) -> DataFrame:
    """(key, cue, start_time, end_time, text): a line of times opens a cue, whose lines run to the next blank one."""
    lines = df.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("n", "line")).withColumn("line", trim(F.col("line")))
    by = Window.partitionBy(key).orderBy("n")
    opened = lines.withColumn("times", time_range(F.col("line"))).withColumn("cue", F.sum(F.col("times").isNotNull().cast("int")).over(by))
    blank = F.sum((F.col("line") == "").cast("int")).over(Window.partitionBy(key, "cue").orderBy("n"))
    body = opened.withColumn("blank", blank).where("cue > 0 and blank = 0")
    shown = F.when(F.col("times").isNull(), F.struct("n", "line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda s: s["line"]), " ")  # bounded by a cue's lines
    found = body.groupBy(key, "cue").agg(F.first("times", ignorenulls=True).alias("times"), joined.alias("text"))
    return found.select(key, (F.col("cue") - 1).alias("cue"), "times.start_time", "times.end_time", (F.col("text") if markup else without_markup(F.col("text"))).alias("text"))


def cue_text(number: Column, start: Column, end: Column, lines: Column, kind: str = "srt") -> Column:
    """One cue: its number (srt only), its times, its lines and a blank one."""
    decimal = "," if kind == "srt" else "."
    times = F.concat(format_hms(start, decimal), F.lit(" --> "), format_hms(end, decimal))
    head = [number.cast("string")] if kind == "srt" else []
    return F.concat(F.array_join(F.concat(F.array(*head, times), F.transform(lines, trim)), "\n"), F.lit("\n\n"))


def rendered(df: DataFrame, key: str, order: str, lines: str, kind: str = "srt") -> DataFrame:
    """(key, subtitles): the cues of each key as one text."""
    number = F.row_number().over(Window.partitionBy(key).orderBy(order))
    text = df.withColumn("number", number).withColumn("cue", cue_text(F.col("number"), F.col("start_time"), F.col("end_time"), F.col(lines), kind))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "cue"))), lambda s: s["cue"]), "")  # one output text
    head = "" if kind == "srt" else "WEBVTT\nKind: captions\n\n"
    return text.groupBy(key).agg(F.concat(F.lit(head), whole).alias("subtitles"))


def wrapped(words: Column, width: int = 42, separators: str = ",;:") -> Column:
    """Words packed into lines no wider than width, a longer word alone; past half the width a separator ends a line."""
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def step(a: Column, w: Column) -> Column:
        longer = F.when(a["line"] == "", w).otherwise(F.concat(a["line"], F.lit(" "), w))
        full = (F.length(longer) > width) & (a["line"] != "")
        broken = (F.length(a["line"]) * 2 >= width) & F.substring(a["line"], -1, 1).isin(list(separators))
        turn = full | broken
        return F.struct(F.when(turn, F.array_append(a["lines"], a["line"])).otherwise(a["lines"]).alias("lines"), F.when(turn, w).otherwise(longer).alias("line"))

    return F.aggregate(words, start, step, lambda a: F.when(a["line"] == "", a["lines"]).otherwise(F.array_append(a["lines"], a["line"])))


__all__ = ["cue_text", "cues", "format_ms", "rendered", "time_range", "without_markup", "wrapped"]
