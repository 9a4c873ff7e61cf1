"""The queries of the subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import functools
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvana.llm import bpe, chat, html_extract, mixing, nearest, negatives, quality, repeats, search, secret_scan, simhash, toxicity, treaps
from corvana.session import table

Query = Callable[[SparkSession, str], DataFrame]

#: The vocabulary file is a parameter of the operator; it is present on each machine.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

#: The target mix, in parts of their sum; sources that aren't listed share the rest.
WEIGHTS = {"src0": 30, "src1": 15, "src2": 15, "src3": 10, "src4": 10}
OTHER_WEIGHT = 20
BLOCK_ROWS = 16


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"), WEIGHTS, OTHER_WEIGHT, BLOCK_ROWS)


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), VOCABULARY))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


#: Schemas of the tools whose calls are checked.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
}


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat(table(spark, sf_dir, "conversations"), TOOLS)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, seen = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.verdicts(toxicity.score(seen, model))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op10_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(table(spark, sf_dir, "documents"), F.col("doc_id") % 50 == 0)


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treaps.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(*negatives.anchors_and_labels(table(spark, sf_dir, "embeddings")))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, seen = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.verdicts(quality.score(seen, model))


def ship(spark: SparkSession) -> None:
    """Gives the executors the package, which the kernels are imported from there, once for each context."""
    sc = spark.sparkContext
    if not getattr(sc, "_corvana_shipped", False):
        root = Path(__file__).resolve().parents[2]
        where = tempfile.mkdtemp(prefix="corvana-")
        shutil.copytree(root / "corvana", f"{where}/lib/corvana", ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(f"{where}/corvana", "zip", f"{where}/lib"))  # Spark's own file server hands it out
        sc._corvana_shipped = True


def shipped(query: Query) -> Query:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {f.__name__: shipped(f) for f in (op1_mixing, op2_nearest, op3_bpe, op4_secrets, op5_simhash, op6_chat, op7_html, op8_toxicity, op9_repeats, op10_search, op11_ranked, op12_negatives, op13_quality)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.oracle(WEIGHTS, OTHER_WEIGHT, BLOCK_ROWS), "op2_nearest": nearest.oracle(), "op6_chat": chat.ORACLE_SQL, "op10_search": search.oracle(), "op11_ranked": treaps.oracle(), "op12_negatives": negatives.oracle()}
