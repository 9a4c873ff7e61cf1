"""Models by name: engines that need weights or a service plug in here; the deterministic parts around them are ours.

An engine is a function from an Arrow batch to an Arrow batch. Nothing here imitates an engine's
output: a name without a registered engine is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Engine = Callable[[pa.RecordBatch], pa.RecordBatch]

# Kinds of engines and the columns that each reads and gives.
KINDS = {
    "synthesis": ("id long, text string, language string, voice string", "id long, sample_rate int, channels array<array<float>>, timeline string"),
    "recognition": ("id long, sample_rate int, channels array<array<float>>, language string", "id long, transcript string, timeline string"),
    "alignment": ("id long, sample_rate int, channels array<array<float>>, transcript string", "id long, timeline string"),
    "text_translation": ("id long, text string, source string, target string", "id long, pairs array<struct<source_text:string,translated_text:string>>"),
    "speech_translation": ("id long, sample_rate int, channels array<array<float>>, target string", "id long, transcript string, timeline string"),
    "text_language_detection": ("id long, text string", "id long, results array<struct<language:string,probability:double>>"),
    "speech_language_detection": ("id long, sample_rate int, channels array<array<float>>", "id long, results array<struct<language:string,probability:double>>"),
    "voice_activity_detection": ("id long, sample_rate int, channels array<array<float>>", "id long, frame_seconds double, probabilities array<double>"),
    "denoising": ("id long, sample_rate int, channels array<array<float>>", "id long, sample_rate int, channels array<array<float>>"),
    "source_separation": ("id long, sample_rate int, channels array<array<float>>", "id long, sample_rate int, channels array<array<float>>"),
    "embeddings": ("id long, text string", "id long, embeddings array<array<float>>"),
}
ENGINES: dict[tuple[str, str], Engine] = {}


def register(kind: str, name: str, engine: Engine) -> None:
    if kind not in KINDS:
        raise ValueError(f"unknown kind of engine {kind!r}")
    ENGINES[kind, name] = engine


def engines(kind: str | None = None) -> list[tuple[str, str]]:
    return sorted(k for k in ENGINES if kind in (None, k[0]))


def apply(df: DataFrame, kind: str, name: str) -> DataFrame:
    """The engine over df's columns of that kind."""
    if (kind, name) not in ENGINES:
        raise ValueError(f"no engine {name!r} is registered for {kind}")
    reads, gives = KINDS[kind]
    engine = ENGINES[kind, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield engine(batch)

    columns = [F.col(part.split()[0]) for part in split_top(reads)]
    return df.select(*columns).mapInArrow(run, gives)


def split_top(ddl: str) -> list[str]:
    """The columns of a schema text, split at commas outside angle brackets."""
    out, depth, at = [], 0, 0
    for n, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[at:n].strip())
            at = n + 1
    return [*out, ddl[at:].strip()]


def averaged_by_language(parts: DataFrame, key: str) -> DataFrame:
    """(key, language, probability): results of parts averaged by language, with rank 1 for the likeliest."""
    flat = parts.select(key, F.inline("results"))
    mean = flat.groupBy(key, "language").agg(F.avg("probability").alias("probability"))
    return mean.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("probability"), "language")))


def hop_windows(df: DataFrame, seconds: str, window: float = 30.0, hop: float = 25.0) -> DataFrame:
    """A row for each part of each signal: part, start_time, end_time; up to the first part that is cut short."""
    n = F.greatest(F.ceil((F.col(seconds) - window) / hop), F.lit(0)).cast("int")
    parts = F.when(F.col(seconds) > 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    rows = df.withColumn("part", F.explode(parts))
    return rows.withColumns({"start_time": F.col("part") * hop, "end_time": F.least(F.col("part") * hop + window, F.col(seconds))})
