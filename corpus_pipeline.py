"""A training-data pipeline: reject toxic documents, keep one of near-duplicates, mask secrets, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. From the mixing stage on, mix_position goes with each row.

In every stage a null text is like an empty one, texts are taken whole, rows without an id and
repeated rows are rows of their own unless said otherwise, an empty table gives an empty one, and
further columns of docs are left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corvana.llm import bpe, mixing, registry, secret_scan, shingles, simhash, toxicity
from corvana.session import remove, shared_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores under the threshold of a model fitted on docs and their labels. Rows of one text share their fate."""
    registry.ship(spark)
    docs = docs.select(*COLUMNS)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: that of the smallest doc_id.

    Linked are fingerprints of at most 3 differing bits, found by pigeonring chains as in op5, and texts of a Jaccard
    similarity of 0.8 in 5-word shingles, which mostly differ in more bits; components are of both.

    A component without any id keeps one; of texts that share the smallest id that of the least hash
    stays, of equal rows one. Texts without words are one component.
    """
    registry.ship(spark)
    docs = docs.select(*COLUMNS)
    return shingles.keep_first(docs, classes=simhash.text_classes(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in the text and n_chars counted anew; a null text stays null."""
    registry.ship(spark)
    return secret_scan.redact(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix, with their mix_position. Ties of doc_id go by the rows' hash."""
    registry.ship(spark)
    mixed = mixing.mix(docs.select(*COLUMNS), registry.WEIGHTS, registry.OTHER_WEIGHT, registry.BLOCK_ROWS)
    return mixed.select(*COLUMNS, "mix_position").orderBy("mix_position")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the digests of ids and decoded text."""
    registry.ship(spark)
    keep = tuple(c for c in ("mix_position",) if c in docs.columns)
    return bpe.digests(bpe.encode(docs, registry.VOCABULARY, keep=keep), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: The stages fit a classifier and run kernels that SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents; each stage's rows are written to the shared folder and read again, and go when the next stage's are there."""
    docs = table(spark, sf_dir, "documents")
    where = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs.write.parquet(f"{where}/{n}")
            docs = spark.read.parquet(f"{where}/{n}")
            if n:
                remove(spark, f"{where}/{n - 1}")
    return docs
