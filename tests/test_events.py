"""Event streams on small fixtures."""

from pyspark.sql import functions as F

from corvana.functions import phones as p
from corvana.operators import events as e


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_words(spark):
    df = spark.createDataFrame([(1, 0, "phone", "x", 0.0), (1, 1, "word", "Hi", 0.1), (1, 2, "phone", "h", 0.1), (1, 3, "phone", "ai", 0.2), (1, 4, "word", "you", 0.5)], "k long, n int, kind string, text string, time double")
    got = rows(e.words_with_phones(df.withColumn("total", F.lit(1.0)), "k", "n", "total").select("word", "start_time", "end_time", "phones"), "start_time")
    assert got == [("Hi", 0.1, 0.5, ["h", "ai"]), ("you", 0.5, 1.0, [])]
    ticks = spark.createDataFrame([("WordBoundary", 10_000_000, 5_000_000), ("Other", 0, 0)], "kind string, offset_ticks long, duration_ticks long")
    assert rows(e.word_boundaries(ticks).select("start_time", "end_time"), "start_time") == [(1.0, 1.5)]


def test_lines(spark):
    df = spark.createDataFrame([(1, "pau:0.2 h:0.3 ai:0.55", ["[00:00:01.000 --> 00:00:02.500]   Hello", "[00:00:02.500 --> 00:00:03.000]  wor", "[00:00:03.000 --> 00:00:03.250]ld", "noise"])], "k long, trace string, lines array<string>")
    assert rows(e.trace_events(df, "k", "trace").select("name", "start_time", "end_time"), "end_time") == [("pau", 0.0, 0.2), ("h", 0.2, 0.3), ("ai", 0.3, 0.55)]
    assert rows(e.logged_entries(df, "k", "lines").select("text", "start_time", "end_time"), "start_time") == [("Hello", 1.0, 2.5), ("world", 2.5, 3.25)]


def test_tokens(spark):
    frames = spark.createDataFrame([(1, n, t) for n, t in enumerate("_hhe_l2oo  _wo_")], "k long, n int, token string")
    assert [r[0] for r in rows(e.greedy_words(frames, "k", "n", "token", 0.1).select("word", "start_time"), "start_time")] == ["hello", "wo"]
    path = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 1, 5)], "k long, source int, dest int").withColumns({"a": F.lit(10.0), "b": F.lit(11.0)})
    assert rows(e.path_to_tokens(path, "k", "a", "b").select("start_time", "end_time"), "start_time") == [(10.0, 10.1), (10.1, 11.0)]
    phrases = spark.createDataFrame([(1, 0, ","), (1, 1, "."), (1, 2, "!")], "k long, n int, b string")
    assert [r.sentence for r in e.phrases_to_sentences(phrases, "k", "n", "b").orderBy("n").collect()] == [0, 0, 1]
    kinds = spark.createDataFrame([(5,), (100,), (103,), (200,)], "t int").select(e.token_kind(F.col("t"), 100, 102, 10, 150).alias("x"))
    assert [r.x for r in kinds.collect()] == ["text", "special", "language", "timestamp"]
    words = spark.createDataFrame([(" a",), ("!!",), (",",)], "token string")
    assert [r.token for r in e.suppressed_tokens(words, [","]).collect()] == ["!!"]
    found = spark.range(1).select(*[f(F.lit(x)).alias(f"c{n}") for n, (f, x) in enumerate([(p.arpabet_to_ipa, "ah"), (p.arpabet_to_ipa, "Ah0"), (p.arpabet_to_ipa, "ah9"), (p.timit_to_ipa, "b"), (p.ipa_to_timit, "tʃ"), (p.ipa_word_to_timit, "kæt"), (p.ipa_word_to_timit, "k?")])]).first()
    assert list(found) == ["ʌ", "ə", None, "", ["tcl", "ch"], ["kcl", "k", "ae", "tcl", "t"], None]
