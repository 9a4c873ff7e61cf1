"""Operators over flat timelines: rows (key, path, type, text, start_time, end_time, ...) in seconds.

path is an array of places, one for each level, so the order of paths is document order and a
row's ancestors are its path's beginnings. Null times stay null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvana.functions.vectors import round_half_up
from corvana.operators.parts import MOST, Latest, in_parts, is_long

TIMES = ("start_time", "end_time")


def shift(df: DataFrame, seconds: float) -> DataFrame:
    """Times moved, but never below 0."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.col(c) + seconds, F.lit(0.0))) for c in TIMES})


def scale(df: DataFrame, factor: float) -> DataFrame:
    return df.withColumns({c: F.col(c) * factor for c in TIMES})


def round_times(df: DataFrame, digits: int = 2, columns: tuple[str, ...] = (*TIMES, "confidence")) -> DataFrame:
    """The given digits at every level."""
    return df.withColumns({c: round_half_up(F.col(c), digits) for c in columns if c in df.columns})


def extract(df: DataFrame, keep: Column, key: str = "doc_id", path: str = "path") -> DataFrame:
    """Rows that match and have no ancestor that matches: an anti-join on the ancestors' paths."""
    found = df.where(keep)
    above = F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda n: F.slice(path, F.lit(1), n))
    deep = found.where(F.size(path) > 1).select(F.col(key), F.col(path), F.explode(above).alias("above"))
    tops = found.select(F.col(key).alias("top_key"), F.col(path).alias("top_path"))
    hidden = deep.join(tops, (F.col(key) == F.col("top_key")) & (F.col("above") == F.col("top_path")), "left_semi").select(key, path).distinct()
    return found.join(hidden, [key, path], "left_anti")


def frames_to_segments(df: DataFrame, key: str, frame_no: str, probability: str, seconds: float, threshold: float) -> DataFrame:
    """Segments of frames on one side of the threshold; a frame lasts the given seconds. One shuffle."""
    by = Window.partitionBy(key).orderBy(frame_no)
    active = F.coalesce(F.col(probability) >= threshold, F.lit(False))
    flagged = df.withColumn("active", active)
    changed = F.coalesce((F.lag("active").over(by) != F.col("active")).cast("int"), F.lit(0))
    numbered = flagged.withColumn("changed", changed).withColumn("segment", F.sum("changed").over(by))
    return numbered.groupBy(key, "segment", "active").agg((F.min(frame_no) * seconds).alias("start_time"), ((F.max(frame_no) + 1) * seconds).alias("end_time"))


def cropped_offsets(uncrop: DataFrame, key: str, order: str) -> DataFrame:
    """The kept intervals with their place in the cropped time: offset and offset_end."""
    by = Window.partitionBy(key).orderBy(order)
    length = F.col("end_time") - F.col("start_time")
    before = F.coalesce(F.sum(length).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return uncrop.select(key, F.col(order).alias("ord"), F.col("start_time").alias("kept_start"), F.col("end_time").alias("kept_end"), before.alias("offset"), (before + length).alias("offset_end"))


def uncropped(entries: DataFrame, uncrop: DataFrame, key: str, entry_id: str, order: str, bucket: float) -> DataFrame:
    """Entries of cropped time in source time: within the kept interval of largest overlap, the first of equals.

    Entries past the end map to the last interval's end, those of a key without intervals to 0. The
    interval join meets on time buckets of the given length, so a long key isn't compared pairwise.
    """
    last = F.greatest("start_time", "end_time")
    cells = lambda a, b: F.sequence(F.floor(a / bucket), F.floor(b / bucket))
    offsets = cropped_offsets(uncrop, key, order)
    left = entries.select(key, entry_id, F.col("start_time").alias("s"), last.alias("e"))
    spread = left.withColumn("cell", F.explode(cells(F.col("s"), F.col("e"))))
    kept = offsets.withColumn("cell", F.explode(cells(F.col("offset"), F.col("offset_end"))))
    low, high = F.greatest("s", "offset"), F.least("e", "offset_end")
    found = spread.join(kept, [key, "cell"]).where(high >= low).select(key, entry_id, "ord", (high - low).alias("overlap"), (F.col("kept_start") + low - F.col("offset")).alias("a"), (F.col("kept_start") + high - F.col("offset")).alias("b"))
    best = found.groupBy(key, entry_id).agg(F.min_by(F.struct("a", "b"), F.struct((-F.col("overlap")).alias("o"), "ord")).alias("m"))
    tail = offsets.groupBy(key).agg(F.max_by("kept_end", "ord").alias("tail"))
    joined = left.join(best, [key, entry_id], "left").join(tail, key, "left")
    return joined.select(key, entry_id, F.coalesce("m.a", "tail", F.lit(0.0)).alias("start_time"), F.coalesce("m.b", "tail", F.lit(0.0)).alias("end_time"))


def interpolated(children: DataFrame, source: DataFrame, reference: DataFrame, key: str, place: str) -> DataFrame:
    """Children of reference words in the time of the source word at the same place; a word without length maps to its start."""
    s = source.select(key, place, F.col("start_time").alias("s0"), F.col("end_time").alias("s1"))
    r = reference.select(key, place, F.col("start_time").alias("r0"), F.col("end_time").alias("r1"))
    joined = children.join(s, [key, place]).join(r, [key, place])
    length = F.col("r1") - F.col("r0")
    at = lambda c: F.col("s0") + F.when(length == 0, 0.0).otherwise((F.col(c) - F.col("r0")) / F.when(length != 0, length)) * (F.col("s1") - F.col("s0"))
    return joined.withColumns({c: at(c) for c in TIMES}).drop("s0", "s1", "r0", "r1")


def extended_cues(cues: DataFrame, key: str, order: list[str], added: float = 3.0, total: str | None = None) -> DataFrame:
    """Each cue's end later by at most the added seconds, up to the next cue's start; the last one's up to a total, if there is one."""
    following = F.lead("start_time").over(Window.partitionBy(key).orderBy(*order))
    limit = F.coalesce(following, F.col(total)) if total else following
    return cues.withColumn("end_time", F.when(limit.isNotNull(), F.least(F.col("end_time") + added, limit)).otherwise(F.col("end_time")))


def compact_path(path: DataFrame, key: str) -> DataFrame:
    return path.groupBy(key, "source").agg(F.min("dest").alias("first"), F.max("dest").alias("last"))


def mapped_frames(frames: DataFrame, compacted: DataFrame, key: str, frame: str, kind: str = "first") -> DataFrame:
    """The frame's first or last place in the other sequence, clipped to the path's range; 0 for an empty path."""
    span = compacted.groupBy(key).agg(F.min("source").alias("low"), F.max("source").alias("high"))
    clipped = frames.join(span, key, "left").withColumn("source", F.greatest("low", F.least("high", frame)))
    return clipped.join(compacted.select(key, "source", F.col(kind).alias("mapped")), [key, "source"], "left").withColumn("mapped", F.coalesce("mapped", F.lit(0))).drop("low", "high", "source")


def joined_offsets(words: DataFrame, key: str, order: str, word: str) -> DataFrame:
    """Each word's place in the words joined by single blanks (one after the last, too)."""
    by = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return words.withColumn("offset", F.coalesce(F.sum(F.length(word) + 1).over(by), F.lit(0)))


def words_to_sentences(words: DataFrame, key: str, order: str, ends_sentence: Column, ends_segment: Column) -> DataFrame:
    """Word rows with sentence and segment numbers, and each sentence's text and times; words without times take the last known one."""
    by = Window.partitionBy(key).orderBy(order)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    known = F.last("end_time", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    rows = words.withColumns({
        "sentence": F.coalesce(F.sum(ends_sentence.cast("int")).over(before), F.lit(0)),
        "segment": F.coalesce(F.sum(ends_segment.cast("int")).over(before), F.lit(0)),
        "known": F.coalesce(known, F.lit(0.0)),
    })
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda s: s[c]), " ")  # noqa: E731  bounded by a sentence
    return rows.groupBy(key, "segment", "sentence").agg(ordered("word").alias("text"), F.coalesce(F.min("start_time"), F.min("known")).alias("start_time"), F.coalesce(F.max("end_time"), F.max("known")).alias("end_time"))


def tokens_to_words(tokens: DataFrame, key: str, order: str) -> DataFrame:
    """Words of neighbouring tokens: a token that begins with a blank, or follows or is punctuation (but joiners within words), begins a new one.

    A word's confidence is the mean of its tokens'.
    """
    by = Window.partitionBy(key).orderBy(order)
    separator = F.col("token").rlike(r"^\s") | (F.col("token").rlike(r"^\p{P}+$") & ~F.col("token").isin("'", "’", "-", ".", "_"))
    starts = F.when(F.row_number().over(by) == 1, 0).otherwise((separator | F.lag(F.col("token").rlike(r"\p{P}$") & ~F.col("token").rlike(r"['’\-._]$"), 1, False).over(by)).cast("int"))
    rows = tokens.withColumn("word_no", F.sum(starts).over(by))
    text = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "token"))), lambda s: s["token"]), ""))  # bounded by a word
    return rows.groupBy(key, "word_no").agg(text.alias("word"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.avg("confidence").alias("confidence"))


def nearest_times(left: DataFrame, right: DataFrame, key: str, time: str, other: str, most: int = MOST) -> DataFrame:
    """As-of join: for each left time the latest right time not after it, by one sort of both.

    Times are numbers. Where a key has more than `most` rows, the latest time is handed from part to part instead of
    being looked for in one task.
    """
    both = left.select(key, F.col(time).alias("t"), F.lit(1).alias("side"), F.struct(*left.columns).alias("row")).unionByName(right.select(key, F.col(other).alias("t"), F.lit(0).alias("side")), allowMissingColumns=True)
    if is_long(both.select(key), key, most):
        seen = in_parts(both.where("t is not null"), key, ["t", "side"], ["side", "t"], Latest("matched")).withColumn("matched", F.nanvl("matched", F.lit(None).cast("double")))
        seen = seen.unionByName(both.where("t is null").withColumn("matched", F.lit(None).cast("double")))
        seen = seen.withColumn("matched", F.col("matched").cast(right.schema[other].dataType))
    else:
        by = Window.partitionBy(key).orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
        seen = both.withColumn("matched", F.last(F.when(F.col("side") == 0, F.col("t")), ignorenulls=True).over(by))
    return seen.where("side = 1").select("row.*", "matched")
