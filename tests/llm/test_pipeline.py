"""Each stage on a small fixture, and all of them one after the other."""

import hashlib

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as p
from corvana.llm import registry, secret_scan

COPY = "one line that stands in several documents and is long enough to count"


@pytest.fixture()
def folder(spark, tmp_path):
    docs = [(n, f"document number {n} tells of {n * 7} things and {n * 13} more, {'abcdefgh'[n % 8] * 5} at the end", "en", f"src{n % 6}", 0) for n in range(60)]
    docs += [(100 + n, COPY, "en", "src1", 0) for n in range(5)]
    docs += [(200 + n, f"such a worthless idiot and pathetic loser number {n}, moron", "en", "src2", 0) for n in range(12)]
    docs += [(300, "the password=abcdef123 is here", None, None, None), (301, None, "en", "src0", 0), (None, "no number for this one", "en", "src9", 0), (302, "", "en", "src0", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(n, 0, 0) for n in range(60)] + [(200 + n, 1, 1) for n in range(12)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = p.drop_toxic(spark, docs, folder)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert not [i for i in ids if i is not None and 200 <= i < 300] and len(ids) == docs.count() - 12
    unique = p.drop_near_duplicates(spark, docs, folder)
    assert unique.columns == docs.columns
    ids = [r.doc_id for r in unique.collect()]
    assert 100 in ids and not {101, 102, 103, 104} & set(ids)
    assert 301 in ids and 302 not in ids  # both without words
    masked = p.mask_secrets(spark, docs, folder)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    for r in masked.collect():
        assert not secret_scan.base_spans(r.text or "") and (r.text is None or r.n_chars == len(r.text))
    mixed = p.mix_sources(spark, docs, folder)
    assert set(docs.columns) <= set(mixed.columns) and mixed.count() == docs.count()
    order = [r.mix_position for r in mixed.collect()]
    assert order == sorted(order) and len(set(order)) == len(order)


def test_run(spark, folder):
    rows = p.run(spark, folder).collect()
    library = Tokenizer.from_file(registry.VOCABULARY)
    library.no_truncation()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = {r.doc_id: r for r in rows}
    assert 100 in found and 101 not in found and not [i for i in found if i is not None and 200 <= i < 300]
    for i in (0, 7, 100, None):
        ids = library.encode(docs[i], add_special_tokens=False).ids
        assert found[i].ids == ids and found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert found[300].ids != library.encode(docs[300], add_special_tokens=False).ids
    assert len({r.mix_position for r in rows}) == len(rows)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
