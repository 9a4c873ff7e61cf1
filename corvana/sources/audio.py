"""Wave and NIST-headed speech files as Spark data sources; whole files, texts and settings by Spark's own readers."""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvana.functions.encodings import from_pcm, to_pcm

AUDIO = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("sample_rate", T.IntegerType()),
    T.StructField("channels", T.ArrayType(T.ArrayType(T.FloatType()))), T.StructField("error", T.StringType()),
])
NIST = b"NIST_1A\n"


def read_wave(data: bytes) -> tuple[int, list[list[float]]]:
    """Sample rate and channels of whole-number PCM."""
    with wave.open(io.BytesIO(data)) as f:
        n, bits = f.getnchannels(), 8 * f.getsampwidth()
        samples = from_pcm(f.readframes(f.getnframes()), bits)
        return f.getframerate(), [samples[c::n].astype(np.float32).tolist() for c in range(n)]


def write_wave(rate: int, channels: list, bits: int = 16) -> bytes:
    """Channels of unequal length end with the shortest."""
    n = min(map(len, channels), default=0)
    flat = np.stack([np.asarray(c[:n], np.float64) for c in channels], axis=1).ravel() if channels else np.zeros(0)
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(max(1, len(channels)))
        f.setsampwidth(bits // 8)
        f.setframerate(rate)
        f.writeframes(to_pcm(flat, bits))
    return out.getvalue()


def read_nist(data: bytes) -> tuple[int, list[list[float]]]:
    """A header of 1024 bytes, then 16-bit samples of one channel at 16 kHz."""
    if not data.startswith(NIST):
        raise ValueError("no NIST header")
    return 16000, [from_pcm(data[1024 : len(data) // 2 * 2], 16).astype(np.float32).tolist()]


def decoded(batches):
    for batch in batches:
        rows = []
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            try:
                rate, channels = read_nist(data) if data.startswith(NIST) else read_wave(data)
                rows.append({"path": path, "sample_rate": rate, "channels": channels, "error": None})
            except (ValueError, EOFError, wave.Error) as e:
                rows.append({"path": path, "sample_rate": None, "channels": None, "error": str(e) or type(e).__name__})
        kind = pa.schema([("path", pa.string()), ("sample_rate", pa.int32()), ("channels", pa.list_(pa.list_(pa.float32()))), ("error", pa.string())])
        yield pa.RecordBatch.from_pylist(rows, schema=kind)


def read_audio(spark: SparkSession, path: str, pattern: str = "*.wav", recursive: bool = True) -> DataFrame:
    """(path, sample_rate, channels, error) of each file, whatever the store; a file that can't be read has an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", "content").mapInArrow(decoded, AUDIO)


def read_texts(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, text) of each whole file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes, recent): recent if written within the last day."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), (F.col("modificationTime") >= F.current_timestamp() - F.expr("INTERVAL 1 DAY")).alias("recent"))


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """(section, key, value) of INI-like files: # begins a comment, empty values are left out, the last of equal keys wins."""
    lines = read_texts(spark, path).select("path", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line")).withColumn("line", F.trim("line"))
    by = Window.partitionBy("path").orderBy("n")
    section = F.last(F.when(F.col("line").rlike(r"^\[.*\]$"), F.regexp_extract("line", r"^\[(.*)\]$", 1)), ignorenulls=True).over(by)
    pairs = lines.withColumn("section", section).where("line like '%=%' and line not like '#%' and line not like '[%'")
    split = pairs.select("path", "n", F.coalesce("section", F.lit("")).alias("section"), F.trim(F.substring_index("line", "=", 1)).alias("key"), F.trim(F.expr("substring(line, instr(line, '=') + 1)")).alias("value"))
    return split.where("value <> ''").groupBy("section", "key").agg(F.max_by("value", F.struct("path", "n")).alias("value"))
