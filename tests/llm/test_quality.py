"""Statistics by segments, the summed equations and the calibration against plain computations, held-out accuracy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvana.llm import quality as s
from corvana.session import table


def test_held_out_accuracy(spark, medium):
    docs, labels = table(spark, medium, "documents"), table(spark, medium, "labels")
    model, seen = s.fit(docs, labels)
    found = s.verdicts(s.score(seen, model)).join(labels, "doc_id").where("held_out").toPandas()
    assert found.score.between(0, 1).all() and len(found) > 80
    assert (found.predicted == found.quality).mean() >= 0.95
    assert (found.predicted == (found.score >= 0.7)).all()


def test_labels_of_held_out_rows_have_no_influence(spark, small):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    turned = labels.withColumn("quality", F.when(s.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [{r.doc_id: r.score for r in s.score(seen, model).collect()} for model, seen in (s.fit(docs, labels), s.fit(docs.withColumn("lang", F.lit("x")), turned))]
    assert scores[0] == scores[1] and len(scores[0]) == docs.count()


def test_equations_and_features(spark):
    """Sums over many tasks are those of one matrix; the features' products come near the Gaussian kernel."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, s.N_STATISTICS))
    df = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(x)], "id long, x binary").repartition(7)
    summed = s.summed(df, lambda batch: (m := s.matrix(batch.column("x"), s.N_STATISTICS)).T @ m, s.N_STATISTICS, s.N_STATISTICS)
    assert np.allclose(summed, x.T @ x)
    model = s.Model(np.zeros(s.N_STATISTICS), np.ones(s.N_STATISTICS), np.zeros(s.FEATURES + 1), (np.zeros(1), np.zeros(1)))
    z = model.features(x * 0.3)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) * 0.09 / (2 * s.WIDTH**2 * s.N_STATISTICS))
    assert np.abs(z @ z.T - kernel).mean() < 0.05


def test_pools_are_isotonic():
    rng = np.random.default_rng(2)
    at, n = np.arange(60.0), rng.integers(1, 9, 60).astype(float)
    ones = np.floor(n * np.clip(np.arange(60) / 60 + rng.normal(size=60) * 0.3, 0, 1))
    centre, level = s.pooled(at, n, ones)
    assert (np.diff(centre) > 0).all() and (np.diff(level) >= 0).all() and 0 < level[0] and level[-1] < 1
    # brute force: the isotonic mean at each place is the largest over left ends of the least mean over right ends
    mean = [max(min(ones[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    assert len(centre) == len(set(np.round(mean, 12)))


def test_segments_add_up(monkeypatch):
    text = ("Some words,, here!! and HERE été | again again\n" * 400).encode()
    whole = s.statistics(text)
    parts = list(s.segments(text, 1000))
    assert b"".join(parts) == text and all(len(p) <= 1000 for p in parts)
    assert list(s.segments(b"x" * 2500, 1000)) == [b"x" * 1000, b"x" * 1000, b"x" * 500]
    monkeypatch.setattr(s, "SEGMENT", 1000)
    assert np.allclose(whole[: len(s.KINDS)], s.statistics(text)[: len(s.KINDS)])
    assert np.isfinite(s.statistics(None)).all() and (s.statistics(None) == s.statistics(b"")).all()


@pytest.mark.parametrize("known", [[], [(1, 1, 1)], [(1, 1, 1), (3, 1, 0), (None, 0, 1), (4, None, 1), (1, 0, 1)]])
def test_rows(spark, known):
    docs = spark.createDataFrame([(1, "a good text.", 5), (1, "another", 5), (2, "", 5), (3, None, 5), (None, "x" * 200_000, 5), (4, "!!! $$$", 5)], "doc_id long, text string, score int")
    model, seen = s.fit(docs, spark.createDataFrame(known, "doc_id long, quality int, text int"))
    found = s.verdicts(s.score(seen, model)).collect()
    assert len(found) == 6 and all(0 <= r.score <= 1 for r in found)
    assert {r.held_out for r in found if r.doc_id is None} == {False}
    model, seen = s.fit(docs.limit(0), spark.createDataFrame(known, "doc_id long, quality int, text int"))
    assert s.score(seen, model).count() == 0
