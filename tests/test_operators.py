"""Timeline, subtitle, alignment, catalogue, model, source and streaming operators on small fixtures."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvana.operators import alignment as al
from corvana.operators import catalog, models, stateful, subtitles
from corvana.operators import timeline as tl
from corvana.plans import timelines
from corvana.sources import audio
from corvana.streaming import states


def test_timeline(spark):
    df = spark.createDataFrame([(1, [0], "segment", 1.0, 2.0), (1, [0, 0], "word", 1.0, 1.5), (1, [1, 0], "word", None, 3.0)], "doc_id long, path array<int>, type string, start_time double, end_time double")
    assert [(r.start_time, r.end_time) for r in tl.shift(df, -1.2).collect()] == [(0.0, 0.8), (0.0, 0.30000000000000004), (None, 1.8)]
    assert sorted(r.path for r in tl.extract(df, F.lit(True)).collect()) == [[0], [1, 0]]
    assert sorted(r.path for r in tl.extract(df, F.col("type") == "word").collect()) == [[0, 0], [1, 0]]
    assert tl.round_times(tl.scale(df, 0.333), 1).first().end_time == 0.7


def test_uncropped(spark):
    kept = spark.createDataFrame([(1, 0, 10.0, 12.0), (1, 1, 20.0, 21.0)], "k long, ord int, start_time double, end_time double")
    entries = spark.createDataFrame([(1, 0, 0.5, 1.0), (1, 1, 1.0, 3.0), (1, 2, 5.0, 6.0), (1, 3, 2.0, 2.0), (1, 4, 1.5, 0.5), (2, 5, 1.0, 2.0)], "k long, id long, start_time double, end_time double")
    got = {r.id: (r.start_time, r.end_time) for r in tl.uncropped(entries, kept, "k", "id", "ord", 0.7).collect()}
    assert got == {0: (10.5, 11.0), 1: (11.0, 12.0), 2: (21.0, 21.0), 3: (12.0, 12.0), 4: (11.5, 11.5), 5: (0.0, 0.0)}


def test_subtitles(spark):
    text = "WEBVTT\n\n00:01.5 --> 00:02.000\nHello <i>you</i>\n &amp; me\n\nnote\n\n01:00:00,250 --> 01:00:01,000\r\nBye"
    df = spark.createDataFrame([(1, text), (2, ""), (3, "no cue")], "id long, text string")
    got = [(r.id, r.cue, r.start_time, r.end_time, r.text) for r in subtitles.cues(df, "id", "text").orderBy("cue").collect()]
    assert got == [(1, 0, 1.005, 2.0, "Hello you & me"), (1, 1, 3600.25, 3601.0, "Bye")]
    words = F.split(F.lit("one two three, four five six seven"), " ")
    lines = spark.range(1).select(subtitles.wrapped(words, 16).alias("x")).first().x
    assert lines == ["one two three,", "four five six", "seven"] and all(len(x) <= 16 for x in lines)


def brute_dtw(a, b):
    n, m = len(a), len(b)
    d = np.full((n, m), np.inf)
    for i, j in itertools.product(range(n), range(m)):
        if i == j == 0:
            d[0, 0] = 0
            continue
        d[i, j] = abs(a[i] - b[j]) + min(d[i - 1, j] if i else np.inf, d[i, j - 1] if j else np.inf, d[i - 1, j - 1] if i and j else np.inf)
    return d[-1, -1]


def test_dtw():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.integers(0, 9, rng.integers(2, 12)).astype(float), rng.integers(0, 9, rng.integers(2, 12)).astype(float)
        cost, path = al.dtw(a, b, band=len(b))
        assert cost == brute_dtw(a, b)
        assert path[0] == (0, 0) and path[-1] == (len(a) - 1, len(b) - 1)
        assert all(0 <= y[0] - x[0] <= 1 and 0 <= y[1] - x[1] <= 1 for x, y in itertools.pairwise(path))
        assert al.dtw(a, a)[0] == 0
    assert al.dtw([], [1.0]) == (0.0, [])
    assert al.dtw([1.0], [1.0, 2.0], band=2)[0] == 1.0
    assert al.dtw(np.zeros((3, 2)), np.zeros((3, 2)), "cosine")[0] == 2.0
    assert al.dtw_passes(np.arange(50.0), np.arange(60.0) * 49 / 59, [40, 10])[1][-1] == (49, 59)
    assert al.dtw_memory_mb(1000, 1000, 100) == 0.4


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_edit_alignment():
    for a in itertools.product("abc", repeat=3):
        for b in itertools.chain(itertools.product("abc", repeat=2), itertools.product("abc", repeat=4)):
            assert al.edit_alignment(list(a), list(b))[0] == levenshtein(a, b)
    assert al.edit_alignment([], list("ab")) == (2.0, [(-1, 0), (-1, 1)])
    assert al.edit_alignment(["a"], ["e", "a"], {("a", "e"): 0.5})[0] == 1.5


def test_alignment_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [1.0, 2.0]), (2, None, [1.0]), (3, [], [1.0])], "id long, a array<double>, b array<double>")
    got = df.select("id", al.aligned(df, "a", "b", band=2).alias("r")).orderBy("id").collect()
    assert got[0].r.cost == 0.0 and [tuple(p) for p in got[0].r.path] == [(0, 0), (1, 1)]
    assert got[1].r.cost is None and got[2].r.cost == 0.0


def test_catalogue(spark):
    rows = [(0, "Anna B", ["en", "en-US"], "female"), (1, "Bob", ["en"], "male"), (2, "Carl-Ann", ["de"], "unknown")]
    df = spark.createDataFrame(rows, "ord int, name string, languages array<string>, gender string")
    names = lambda d: [r.name for r in d.orderBy("ord").collect()]
    assert names(catalog.voices(df, "en-GB")) == ["Anna B", "Bob"] and names(catalog.voices(df, "en-US")) == ["Anna B"]
    assert names(catalog.voices(df, gender="male")) == ["Bob", "Carl-Ann"]
    assert names(catalog.voices(df, name="ann")) == ["Anna B", "Carl-Ann"] and names(catalog.voices(df, name="nna b")) == ["Anna B"]
    assert names(catalog.best_voice(df, "en")) == ["Anna B"]


def test_stateful(spark):
    rows = [(1, n, float(x)) for n, x in enumerate([5, 1, 1, 9, 0, 0])]
    df = spark.createDataFrame(rows, "k long, n int, x double")
    assert [r.peak for r in stateful.decaying_peak(df, "k", ["n"], "x", 1.5).orderBy("n").collect()] == [5.0, 3.5, 2.0, 9.0, 7.5, 6.0]
    found = stateful.folded(df, "k", ["n"], "x", stateful.smoothing(0.5, 0.1)).orderBy("n").collect()
    assert [r.y for r in found][:2] == [2.5, 2.35] and len(found) == df.count()
    odd = spark.createDataFrame([(1, 0, 4.0), (1, 1, None), (1, 2, 4.0), (None, 0, 2.0)], "k int, n int, x double")
    assert sorted([r.y for r in stateful.folded(odd, "k", ["n"], "x", stateful.smoothing(0.5, 0.5)).collect()], key=str) == [1.0, 2.0, 3.0, None]
    assert spark.range(1).select(stateful.first_exceeding(F.array(F.lit(1.0), F.lit(1.0)), F.lit(0.6)).alias("i")).first().i == 1


def test_models(spark):
    with pytest.raises(ValueError):
        models.apply(spark.range(1), "text_language_detection", "none")
    models.register("text_language_detection", "lengths", lambda b: b.from_arrays([b.column(0), __import__("pyarrow").array([[{"language": "en", "probability": len(t) / 10}] for t in b.column(1).to_pylist()])], names=["id", "results"]))
    df = spark.createDataFrame([(1, "abc"), (1, "a")], "id long, text string")
    got = models.averaged_by_language(models.apply(df, "text_language_detection", "lengths"), "id").first()
    assert got.language == "en" and abs(got.probability - 0.2) < 1e-9
    parts = models.hop_windows(spark.createDataFrame([(1, 60.0), (2, 0.0), (3, 10.0)], "id long, s double"), "s").collect()
    assert [(r.id, r.part, r.end_time) for r in parts] == [(1, 0, 30.0), (1, 1, 55.0), (1, 2, 60.0), (3, 0, 10.0)]


def test_sources(spark, tmp_path):
    wave = audio.write_wave(8000, [[0.0, 0.5, -0.5], [0.25, 0.0]])
    (tmp_path / "a.wav").write_bytes(wave)
    (tmp_path / "b.wav").write_bytes(audio.NIST + bytes(1016) + (16384).to_bytes(2, "little"))
    (tmp_path / "c.wav").write_bytes(b"junk")
    (tmp_path / "s.ini").write_text("x=1\n[p]\n# no\nk = v=w\nempty=\nk=last\n")
    got = {r.path[-5:]: r for r in audio.read_audio(spark, str(tmp_path)).collect()}
    assert got["a.wav"].sample_rate == 8000 and got["a.wav"].channels == [[0.0, 0.5], [0.25, 0.0]]
    assert got["b.wav"].channels == [[0.5]] and got["c.wav"].error
    settings = {(r.section, r.key): r.value for r in audio.read_settings(spark, f"{tmp_path}/s.ini").collect()}
    assert settings == {("", "x"): "1", ("p", "k"): "last"}
    assert audio.file_digests(spark, str(tmp_path)).where("recent").count() == 4


def test_streams(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value").orderBy("ts", "event_id")
    rows = events.collect()
    for n in range(2):  # two files, one after the other
        spark.createDataFrame(rows[n * 500 : (n + 1) * 500], events.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}.parquet")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = states.stream_islands(stream, 50.0).writeStream.format("memory").queryName("islands").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    batch = timelines.islands(spark, small)
    closed = {(r.user_id, r.island, r.state) for r in spark.table("islands").collect()}
    every = {(r.user_id, r.island, r.state) for r in batch.collect()}
    last = {(r.user_id, r.n) for r in batch.groupBy("user_id").agg(F.max("island").alias("n")).collect()}
    assert closed == {x for x in every if (x[0], x[1]) not in last}
    text = states.ChunkedUtf8()
    data = "aé日😀".encode()
    assert "".join(text.add(data[i : i + 1]) for i in range(len(data))) + text.end() == "aé日😀"


def test_aligned_signals(spark):
    """A signal and the same one after a pause: behind the pause the path keeps its length."""
    rng = np.random.default_rng(2)
    parts = [rng.normal(0, 0.3, 1200), np.sin(np.arange(1200) * 0.9), rng.normal(0, 0.05, 1200), np.sin(np.arange(1200) * 0.3)]
    sound = np.concatenate(parts)
    later = np.concatenate([np.zeros(1600), sound])
    df = spark.createDataFrame([(1, sound.tolist(), later.tolist()), (2, None, [0.0] * 800)], "k int, a array<double>, b array<double>")
    got = {r.k: r for r in al.aligned_signals(df, "k", "a", "b", rate=8000, high=3500.0).collect()}
    path = got[1].path
    assert got[2].cost is None and got[2].path is None and got[1].cost > 0
    assert (path[0].source, path[0].dest) == (0.0, 0.0) and abs(path[-1].dest - path[-1].source - 0.2) < 0.03
    assert abs(np.median([p.dest - p.source for p in path if p.source > 0.2]) - 0.2) < 0.05
