"""Resampling against sums of sines and plain loops, parts against the whole; merged trees; languages; sections."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvana.functions import sections, trees
from corvana.operators import languages, resampling
from corvana.session import table


@pytest.mark.parametrize(("new", "old"), [(3, 2), (2, 3), (48000, 44100), (1, 1), (5, 1), (1, 4)])
def test_sines_keep_their_form(spark, new, old):
    n = 2000
    cycles = 0.02  # a sample, far below every limit here
    x = np.sin(2 * np.pi * cycles * np.arange(n))
    y = np.array(spark.createDataFrame([(x.tolist(),)], "x array<double>").select(resampling.resampled(F.col("x"), new, old)).first()[0])
    assert len(y) == -(-n * new // old)
    at = np.arange(len(y)) * old / new
    inner = (at > 100) & (at < n - 100)
    assert np.abs(y - np.sin(2 * np.pi * cycles * at))[inner].max() < 2e-3


def test_high_tones_go_when_the_rate_falls(spark):
    x = np.sin(2 * np.pi * 0.4 * np.arange(3000))
    y = np.array(spark.createDataFrame([(x.tolist(),)], "x array<double>").select(resampling.resampled(F.col("x"), 1, 4)).first()[0])
    assert np.abs(y[50:-50]).max() < 0.02


@pytest.mark.parametrize(("new", "old"), [(3, 2), (3, 7), (16000, 11025)])
def test_parts_are_the_whole(spark, new, old):
    rng = np.random.default_rng(4)
    rows, wholes = [], {}
    for key in (1, 2, None):
        sizes = [0, 1, 2, 90, 0, 5, 300, 3, 1, 1, 40] if key != 2 else [7]
        parts = [rng.normal(size=n) for n in sizes]
        wholes[key] = np.concatenate(parts)
        rows += [(key, n, p.tolist()) for n, p in enumerate(parts)]
    rows.append((1, 99, None))
    df = spark.createDataFrame(rows, "key long, part int, x array<double>").repartition(5)
    found = {}
    for r in resampling.resampled_parts(df, "key", "part", "x", new, old, taps=5).collect():
        found.setdefault(r.key, []).append((r.part, r.x))
    up, down = resampling.reduced(new, old)
    for key, x in wholes.items():
        got = sorted(found[key], key=lambda p: p[0])
        assert len(got) == sum(r[0] == key for r in rows)
        assert (key != 1) or got[-1][1] is None
        joined = np.concatenate([np.array(p[1], float) for p in got if p[1] is not None])
        assert np.allclose(joined, resampling.outputs(x, 0, 0, len(x), up, down, resampling.phase_weights(up, down, 5)), rtol=0, atol=1e-12)


def drawn(rng, depth=0):
    kind = rng.random()
    if depth < 4 and kind < 0.6:
        return {rng.choice("abcd"): drawn(rng, depth + 1) for _ in range(rng.randint(0, 3))}
    return rng.choice([1, 2.5, "x", None, [1, {"a": 2}], True, {}])


def recursive(base, extension):
    if not isinstance(base, dict) or not isinstance(extension, dict):
        return extension
    return {k: recursive(base[k], extension[k]) if k in base and k in extension else (extension if k in extension else base)[k] for k in [*base, *(k for k in extension if k not in base)]}


def test_trees_against_recursion(spark):
    rng = random.Random(8)
    pairs = [(drawn(rng), drawn(rng)) for _ in range(400)]
    df = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(pairs)] + [(1000, None, "{}"), (1001, '{"a":1}', None), (1002, None, None)], "id long, a string, b string")
    found = {r.id: r.m for r in df.select("id", trees.merged(F.col("a"), F.col("b")).alias("m")).collect()}
    for i, (a, b) in enumerate(pairs):
        before = json.dumps(a)
        assert json.loads(found[i]) == recursive(a, b) == trees.over(a, b)
        assert json.dumps(a) == before  # the base isn't changed
    assert found[1000] == "{}" and found[1001] == '{"a":1}' and found[1002] is None


def test_languages_of_other_texts(spark, medium):
    docs = table(spark, medium, "documents").select("doc_id", "text", "lang")
    sample = languages.sampled(docs, "doc_id", "text", "lang", 300)
    known = languages.profiles(sample)
    assert known.count() <= 300 * known.select("language").distinct().count()
    found = languages.detected(docs, "doc_id", "text", known).join(docs, "doc_id").join(sample.select("text").distinct(), "text", "left_anti").collect()
    assert len(found) > 500
    assert sum(r.language == r.lang for r in found) / len(found) >= 0.98


def test_no_language(spark):
    known = spark.createDataFrame([("de", " de", 2), ("en", " th", 2)], "language string, gram string, weight int")
    df = spark.createDataFrame([(1, "The the thing"), (2, "123"), (3, None), (4, ""), (5, "de the"), (None, "der")], "id long, text string")
    found = {r.id: (r.language, r.probability) for r in languages.detected(df, "id", "text", known, default="xx").collect()}
    assert found == {1: ("en", 1.0), 2: ("xx", 0.0), 3: ("xx", 0.0), 4: ("xx", 0.0), 5: ("de", 0.5), None: ("de", 1.0)}


def test_sections_tree(spark):
    html = (
        "<head><title>no</title></head><p>Lead &amp; more</p><!-- <h1>hidden</h1> --><h2 id=a>First <b>one</b></h2>text<h4>Deep</h4>d<h3>Less</h3>l"
        "<script>var x='<h1>';</script><H1>Top</H1>t<h2>Under</h2><p>a &lt;b&gt;</p><h2>Open"
    )
    df = spark.createDataFrame([(1, html), (2, ""), (3, None), (4, "<h3>only</h3>")], "id long, html string")
    found = {r.id: r.s for r in df.select("id", sections.sections(F.col("html")).alias("s")).collect()}
    assert [tuple(x) for x in found[1]] == [
        (0, 0, "", -1, [], "Lead & more"), (1, 2, "First one", 0, ["First one"], "text"), (2, 4, "Deep", 1, ["First one", "Deep"], "d"), (3, 3, "Less", 1, ["First one", "Less"], "l"),
        (4, 1, "Top", 0, ["Top"], "t"), (5, 2, "Under", 4, ["Top", "Under"], "a <b>"), (6, 2, "Open", 4, ["Top", "Open"], ""),
    ]
    assert [tuple(x) for x in found[2]] == [(0, 0, "", -1, [], "")] and found[3] is None
    assert [x.title for x in found[4]] == ["", "only"]
